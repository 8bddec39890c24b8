"""Calls of client objects, from a small project with what is known of each call."""

import pytest

from tracewell.operators import python_facts as P
from tracewell.operators import python_graph as G
from tracewell.sources import python_sources as S

FILES = {
    "api.py": "import requests, httpx\nsession = requests.Session()\nv1 = httpx.Client(base_url='https://api.example.com/v1/')\nboth = httpx.Client()\nboth = requests.Session()\nodd = requests.Session()\nodd = None\n",
    "use.py": (
        "import httpx, aiohttp, os\nfrom api import session, v1 as client, odd\nfrom requests import Session as S\n"
        "def module(k):\n    session.get('https://a.example/x')\n    client.post(f'/items/{k}')\n    client.get('https://other.example/y')\n    session.get('/relative')\n    odd.get('https://no.example/')\n"
        "def local():\n    with httpx.Client(base_url=os.environ['BASE']) as c:\n        c.request('put', 'things/1')\n        c.stream('GET', '/s')\n"
        "def shadowed(session):\n    session.get('https://no.example/')\n"
        "async def later():\n    async with aiohttp.ClientSession('https://aio.example/') as s:\n        await s.get('/a')\n        await s.get('https://b.example/c')\n    async with aiohttp.ClientSession() as t:\n        await t.delete('https://b.example/d')\n        await t.get('/e')\n"
        "def outer():\n    s = S()\n    def inner():\n        return s.head('http://h/in')\n    return inner\n"
        "class Api:\n    def __init__(self, base):\n        self.http = httpx.AsyncClient(base_url='https://c.example')\n        self.some = httpx.Client()\n        self.open: httpx.Client = httpx.Client(base_url=base)\n"
        "    def reset(self):\n        self.some = None\n"
        "    async def load(self, k):\n        await self.http.get(f'/k/{k}/z')\n        self.some.get('https://no.example/')\n        self.open.patch('/p')\n        self.other.get('https://no.example/')\n"
        "def functions():\n    httpx.stream('GET', 'https://f.example/1')\n    aiohttp.request('POST', 'https://f.example/2')\n"
    ),
}


@pytest.fixture(scope="module")
def project(spark):
    raw = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary").transform(S.facts).cache()
    return raw, G.module_bindings(raw, G.definitions(raw))


def test_objects(project):
    got = {(r.owner.split("#")[1], r.name): (r.library, r.base, r.base_known) for r in P.client_objects(*project).collect()}
    assert got == {
        ("<module>", "session"): ("requests", None, True),
        ("<module>", "v1"): ("httpx", "https://api.example.com/v1/", True),
        ("local", "c"): ("httpx", None, False),
        ("later", "s"): ("aiohttp", "https://aio.example/", True),
        ("later", "t"): ("aiohttp", None, True),
        ("outer", "s"): ("requests", None, True),
        ("Api", "self.http"): ("httpx", "https://c.example", True),
        ("Api", "self.open"): ("httpx", None, False),
    }


def test_calls(project):
    got = {(r.id.split("#")[1], r.method, r.template, r.anchor, r.authority) for r in P.session_calls(*project, (3, 12)).collect()}
    assert got == {
        ("module", "GET", "/x", "root", "a.example"),
        ("module", "POST", "/v1/items/{}", "root", "api.example.com"),
        ("module", "GET", "/y", "root", "other.example"),
        ("module", "GET", None, "base", None),
        ("local", "PUT", "/things/1", "base", None),
        ("local", "GET", "/s", "base", None),
        ("later", "GET", "/a", "root", "aio.example"),
        ("later", "GET", None, "base", None),
        ("later", "DELETE", "/d", "root", "b.example"),
        ("outer.inner", "HEAD", "/in", "root", "h"),
        ("Api.load", "GET", "/k/{}/z", "root", "c.example"),
        ("Api.load", "PATCH", "/p", "base", None),
    }


def test_functions(project):
    got = {(r.method, r.template, r.authority) for r in P.client_calls(*project).collect()}
    assert got == {("GET", "/1", "f.example"), ("POST", "/2", "f.example")}
