"""Texts of names and formats across modules, in calls of clients, from small projects with what is known of each."""

import pytest

from tracewell.operators import python_facts as P
from tracewell.operators import python_graph as G
from tracewell.operators import texts as T
from tracewell.sources import python_texts as S

FILES = {
    "net/__init__.py": "",
    "net/config.py": (
        "import os\nROOT = 'https://shop.example'\nV2 = ROOT + '/v2'\nAGAIN = V2\nPAGE = '{root}/pages/{page}'\nTYPED: str = f'{ROOT}/typed'\nOPEN = os.environ['OPEN']\n"
        "TWICE = 'https://no.example'\nTWICE += '/more'\nif OPEN:\n    EITHER = 'https://no.example'\nelse:\n    EITHER = 'https://no.example'\nSWITCHED = 'https://no.example'\nPATCHED = 'https://no.example'\nSET = 'https://no.example'\n"
        "LEFT = RIGHT + '/'\nRIGHT = LEFT + '/'\nclass Paths:\n    base = '/class'\n    whole = base + '/whole'\ndef switch():\n    global SWITCHED\n    SWITCHED = 1\n"
    ),
    "net/named.py": "NAMED = 'https://no.example'\nglobals()['NAMED'] = 'https://other.example'\ndef here():\n    KEPT = '/kept'\n    return KEPT\n",
    "net/all.py": "from net.config import *\n",
    "use.py": (
        "import httpx, requests as r\nfrom requests import Session\nfrom net import config, named\nfrom net.config import *\nfrom net.config import PAGE as P, Paths\nfrom net.all import V2 as far\n"
        "config.PATCHED = 'https://other.example'\nsetattr(config, 'SET', 1)\nclient = httpx.Client(base_url=config.V2)\n"
        "def plus(k):\n    r.get(V2 + '/plus/' + str(k))\n"
        "def text(k):\n    r.get(f'{config.AGAIN}/text/{k}/{k!r}')\n"
        "def star(k):\n    r.get(f'{far}/star')\n"
        "def percent(k):\n    r.post('%s/percent/%d' % (V2, k))\n"
        "def one(k):\n    r.post('%s/one' % V2)\n"
        "def keyed(k):\n    r.post('%(v)s/keyed/%(k)05d' % {'v': V2, 'k': k})\n"
        "def formats(k):\n    r.put(P.format(root=ROOT, page=k))\n"
        "def places(k):\n    r.put('{0}/places/{1:04d}/{0!r}'.format(V2, k))\n"
        "def nested(k):\n    r.put('{}/x/{}'.format('%s/nested' % V2, k))\n"
        "def starred(*k):\n    r.put('{}/starred'.format(*k))\n"
        "def missing():\n    r.put('%s/missing/%s' % V2)\n"
        "def stray():\n    r.put('%q' % V2)\n"
        "def local(k):\n    url = f'{V2}/local/{k}'\n    r.get(url)\n"
        "def loop(k):\n    url = V2\n    for x in k:\n        url = url + x\n    r.get(url)\n"
        "def grown(k):\n    url = url + '/grown'\n    r.get(url)\n"
        "def parameter(V2):\n    r.get(V2 + '/parameter')\n"
        "def lambdas():\n    return lambda V2: r.get(V2 + '/lambda')\n"
        "def inner():\n    url = V2 + '/inner'\n    def deep():\n        r.get(url)\n    def other():\n        nonlocal_ = url\n        r.head(nonlocal_)\n"
        "def changed():\n    url = V2 + '/changed'\n    def deep():\n        nonlocal url\n        url = 1\n    r.get(url)\n"
        "def classes():\n    r.get(f'{ROOT}{Paths.whole}')\n"
        "def typed():\n    r.get(TYPED)\n"
        "def keyword(k):\n    r.get(url=f'{V2}/keyword')\n    r.request('PATCH', url=ROOT + '/asked')\n    r.request(method='PUT', url=ROOT + '/asked')\n"
        "def chain():\n    r.get(V2 + '/chain').json(ROOT)\n"
        "def tail():\n    r.get(V2.strip() + '/tail')\n"
        "def open_():\n    r.get(OPEN + '/x')\n"
        "def twice():\n    r.get(TWICE + '/x')\n"
        "def either():\n    r.get(EITHER + '/x')\n"
        "def switched():\n    r.get(SWITCHED + '/x')\n"
        "def patched():\n    r.get(config.PATCHED + '/x')\n"
        "def set_():\n    r.get(config.SET + '/x')\n"
        "def cycle():\n    r.get(LEFT + '/x')\n"
        "def namespace():\n    r.get(named.NAMED + '/x')\n"
        "def based(k):\n    client.get(f'/based/{k}')\n    s = Session()\n    s.get(ROOT + '/session')\n"
    ),
}

HOST = "shop.example"


def read(spark, files):
    raw = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary").transform(S.text_facts).cache()
    return raw, G.module_bindings(raw, G.definitions(raw)), T.arguments(raw).cache()


@pytest.fixture(scope="module")
def project(spark):
    return read(spark, FILES)


def test_urls_of_calls(project):
    raw, bindings, texts = project
    got = [(r.id.split("#")[1], r.method, r.template, r.anchor, r.authority) for r in P.client_calls(raw, bindings, texts).collect()]
    root = lambda name, template, method="GET": (name, method, template, "root", HOST)
    unknown = lambda name, template="/x", method="GET": (name, method, template, "base", None)
    want = [
        root("plus", "/v2/plus/{}"),
        root("text", "/v2/text/{}/{}"),
        root("star", "/v2/star"),
        root("percent", "/v2/percent/{}", "POST"),
        root("one", "/v2/one", "POST"),
        root("keyed", "/v2/keyed/{}", "POST"),
        root("formats", "/pages/{}", "PUT"),
        root("places", "/v2/places/{}/{}", "PUT"),
        root("nested", "/v2/nested/x/{}", "PUT"),
        unknown("starred", "/starred", "PUT"),
        root("missing", "/v2/missing/{}", "PUT"),
        unknown("stray", None, "PUT"),
        root("local", "/v2/local/{}"),
        unknown("loop", None),
        unknown("grown", None),
        unknown("parameter", "/parameter"),
        unknown("lambdas", "/lambda"),
        root("inner.deep", "/v2/inner"),
        root("inner.other", "/v2/inner", "HEAD"),
        unknown("changed", None),
        root("classes", "/class/whole"),
        root("typed", "/typed"),
        root("keyword", "/v2/keyword"),
        root("keyword", "/asked", "PATCH"),
        root("keyword", "/asked", None),
        root("chain", "/v2/chain"),
        unknown("tail", "/tail"),
        *map(unknown, ("open_", "twice", "either", "switched", "patched", "set_", "cycle", "namespace")),
    ]
    assert set(got) == set(want) and len(got) == len(want)


def test_urls_of_clients(project):
    raw, bindings, texts = project
    got = {(r.id.split("#")[1], r.method, r.template, r.anchor, r.authority) for r in P.session_calls(raw, bindings, texts=texts).collect()}
    assert got == {("based", "GET", "/v2/based/{}", "root", HOST), ("based", "GET", "/session", "root", HOST)}
    bases = {(r.name, r.base, r.base_known) for r in P.client_objects(raw, bindings, texts).collect()}
    assert bases == {("client", "https://shop.example/v2", True), ("s", None, True)}


def test_without_texts_names_are_values(project):
    raw, bindings, _ = project
    got = {r.id.split("#")[1]: r.template for r in P.client_calls(raw, bindings).collect()}
    assert got["plus"] == "/plus/{}" and got["local"] is None and got["formats"] is None


def test_parts_and_characters_are_bounded(spark):
    """A name that is asked for many times is put together once; a text of too many parts or characters is one value."""
    chain = "".join(f"U{k} = f'{{U{k - 1}}}{{U{k - 1}}}{{U{k - 1}}}'\n" for k in range(1, 7))
    many, few = "{E}" * T.MOST_PARTS, "{E}" * (T.MOST_PARTS - 2)
    code = f"import requests\nE = ''\nU0 = '/a'\n{chain}MANY = f'/items{many}'\nFEW = f'/items{few}'\nPAD = '{'b' * 40_000}'\n"
    host = "https://h.example"
    asked = {"power": f"'{host}' + U6", "many": f"'{host}' + MANY", "few": f"'{host}' + FEW", "wide": f"f'{host}/q?k={{PAD}}{{PAD}}'", "within": f"f'{host}/q?k={{PAD}}'", "repeated": f"'{host}{{0}}{{0}}'.format(PAD)"}
    code += "".join(f"def {k}():\n    requests.get({e})\n" for k, e in asked.items())
    raw, bindings, texts = read(spark, {"a.py": code})
    got = {r.id.split("#")[1]: r.template for r in P.client_calls(raw, bindings, texts).collect()}
    assert got == {"power": "/a" * 3**6, "many": None, "few": "/items", "wide": None, "within": "/q", "repeated": None}
    assert T.settled(raw).groupBy("node").count().where("count > 1").isEmpty()


def test_no_texts(spark):
    raw, bindings, texts = read(spark, {"a.py": "x = 1\n", "b.py": "def (:\n", "c.py": ""})
    assert texts.isEmpty() and P.client_calls(raw, bindings, texts).isEmpty()
