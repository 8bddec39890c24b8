"""Queries over Python sources. The sources are written from the star-schema tables, so that SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import patterns
from tracewell.operators import catalog, models, texts, value_flow
from tracewell.operators import python_facts as P
from tracewell.operators import python_graph as G
from tracewell.sources import manifests, python_flow, python_texts
from tracewell.sources import python_sources as S
from tracewell.sources.entity_graph import dealt, table
from tracewell.storage import materialize

MOST_FILES = 2_000  # fixed value: files that one task parses, so that those of a small table aren't one task's


def _class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base module for each nation, and a module for each supplier with a class under its nation's and a function that makes one."""
    nation = table(spark, sf_dir, "nation").select(F.format_string("n%d/base.py", "n_nationkey").alias("path"), F.format_string("class Base%d:\n    def run(self):\n        return self.step()\n    def step(self):\n        return %d\n", "n_nationkey", "n_nationkey").alias("text"))
    own = F.when(F.col("s_suppkey") % 2 == 0, F.lit("    def step(self):\n        return super().step()\n")).otherwise(F.lit("    pass\n"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.format_string("s%d.py", "s_suppkey").alias("path"),
        F.concat(F.format_string("from n%d.base import Base%d as B\nimport os\n\nclass S%d(B):\n", "s_nationkey", "s_nationkey", "s_suppkey"), own, F.format_string("\ndef make():\n    S%d()\n    os.getcwd()\n    nowhere()\n", "s_suppkey")).alias("text"),
    )
    return nation.unionByName(supplier).select("path", F.encode("text", "UTF-8").alias("content"))


def python_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _ = G.graph(S.facts(_class_files(spark, sf_dir)))
    return edges.select("source", "target", F.array_join("kinds", ",").alias("kinds"), "evidence")


PYTHON_GRAPH_SQL = """WITH s AS (SELECT 's' || s_suppkey || '.py#' AS p, 'S' || s_suppkey AS c, 'n' || s_nationkey || '/base.py#Base' || s_nationkey AS b, s_suppkey % 2 = 0 AS own FROM supplier)
  SELECT p || c AS source, b AS target, 'inherit' AS kinds, 'direct' AS evidence FROM s
  UNION ALL SELECT p || 'make', p || c, 'new', 'direct' FROM s
  UNION ALL SELECT 'n' || n_nationkey || '/base.py#Base' || n_nationkey || '.run', 'n' || n_nationkey || '/base.py#Base' || n_nationkey || '.step', 'call', 'direct' FROM nation
  UNION ALL SELECT p || c || '.step', b || '.step', 'call', 'direct' FROM s WHERE own
  UNION ALL SELECT b || '.run', p || c || '.step', 'call', 'candidate' FROM s WHERE own"""


def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, outcomes = G.graph(S.facts(_class_files(spark, sf_dir)))
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


PYTHON_CALLS_SQL = """WITH t AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS own, (SELECT count(*) FROM nation) AS n,
    (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_suppkey % 2 = 0) AS partial)
  SELECT * FROM (SELECT 'resolved' AS status, s + own + n - partial AS n FROM t UNION ALL SELECT 'external', s + own FROM t UNION ALL SELECT 'unresolved', s FROM t UNION ALL SELECT 'partial', partial FROM t) WHERE n > 0"""


def _hinted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store and two classes under it for each nation; for each supplier, functions whose parameters and results are annotated in four ways, by an outside class, or not."""
    n = "s_nationkey"
    stores = table(spark, sf_dir, "nation").select(F.format_string("n%d.py", "n_nationkey").alias("path"), F.format_string("class Store%d:\n    def save(self, x):\n        return x\nclass Left%d(Store%d):\n    def save(self, x):\n        return x\nclass Right%d(Store%d):\n    pass\n", *["n_nationkey"] * 5).alias("text"))
    hint = F.element_at(F.array(*map(F.lit, ("T", "Optional[T]", "'T'", "None | T"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    head = F.format_string("import decimal\nfrom typing import Optional\nfrom n%d import Store%d as T, Left%d as L\n", n, n, n)
    rest = "def give() -> 'Optional[L]':\n    return L()\ndef got():\n    y = give()\n    y.save(2)\ndef outer(d: decimal.Decimal):\n    d.sqrt()\ndef unknown(v):\n    v.save(3)\n"
    users = table(spark, sf_dir, "supplier").select(F.format_string("s%d.py", "s_suppkey").alias("path"), F.concat(head, F.format_string("def take(x: %s):\n    x.save(1)\n", hint), F.lit(rest)).alias("text"))
    return stores.unionByName(users).select("path", F.encode("text", "UTF-8").alias("content"))


def hinted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _ = G.graph(S.facts(_hinted_files(spark, sf_dir)))
    return edges.select("source", "target", F.array_join("kinds", ",").alias("kinds"), "evidence")


HINTED_EDGES_SQL = """WITH s AS (SELECT 's' || s_suppkey || '.py#' AS p, 'n' || s_nationkey || '.py#' AS n, s_nationkey AS k FROM supplier), b AS (SELECT 'n' || n_nationkey || '.py#' AS n, n_nationkey AS k FROM nation)
  SELECT n || 'Left' || k AS source, n || 'Store' || k AS target, 'inherit' AS kinds, 'direct' AS evidence FROM b
  UNION ALL SELECT n || 'Right' || k, n || 'Store' || k, 'inherit', 'direct' FROM b
  UNION ALL SELECT p || 'take', n || 'Store' || k || '.save', 'call', 'direct' FROM s
  UNION ALL SELECT p || 'take', n || 'Left' || k || '.save', 'call', 'candidate' FROM s
  UNION ALL SELECT p || 'give', n || 'Left' || k, 'new', 'direct' FROM s
  UNION ALL SELECT p || 'got', p || 'give', 'call', 'direct' FROM s
  UNION ALL SELECT p || 'got', n || 'Left' || k || '.save', 'call', 'direct' FROM s"""


def hinted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, outcomes = G.graph(S.facts(_hinted_files(spark, sf_dir)))
    return outcomes.groupBy("node", "status").agg(F.count("*").alias("n"))


HINTED_CALLS_SQL = """SELECT 's' || s_suppkey || '.py#' || f AS node, status, CAST(c AS BIGINT) AS n
  FROM supplier, (VALUES ('take', 'partial', 1), ('give', 'resolved', 1), ('got', 'resolved', 2), ('outer', 'external', 1), ('unknown', 'unresolved', 1)) v(f, status, c)"""


def _service_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores for each nation, and a service for each supplier that is given one of them, or either for every third; every fifth is handed on as a value."""
    store = "class Store%d:\n    def save(self, x):\n        return x\nclass Left%d(Store%d):\n    def save(self, x):\n        return x\nclass Right%d(Store%d):\n    pass\n"
    stores = table(spark, sf_dir, "nation").select(F.format_string("n%d.py", "n_nationkey").alias("path"), F.format_string(store, *["n_nationkey"] * 5).alias("text"))
    k, n = "s_suppkey", "s_nationkey"
    service = F.format_string("from n%d import Left%d as L, Right%d as R\nclass Service%d:\n    def __init__(self, store, label=None):\n        self.store = store\n    def run(self, x):\n        return self.store.save(x)\ndef make():\n    return Service%d(L())\ndef main():\n    make().run(1)\n", n, n, n, k, k)
    other = F.when(F.col(k) % 3 == 0, F.format_string("def other():\n    Service%d(store=R())\n", k)).otherwise(F.lit(""))
    handed = F.when(F.col(k) % 5 == 0, F.format_string("known = [Service%d]\n", k)).otherwise(F.lit(""))
    services = table(spark, sf_dir, "supplier").select(F.format_string("s%d.py", k).alias("path"), F.concat(service, other, handed).alias("text"))
    return stores.unionByName(services).select("path", F.encode("text", "UTF-8").alias("content"))


def bound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = dealt(_service_files(spark, sf_dir), MOST_FILES)
    return value_flow.bound_edges(python_flow.flow_facts(files)).select("source", "target", "kind").distinct()


BOUND_SQL = """WITH s AS (SELECT 's' || s_suppkey || '.py#' AS p, 'Service' || s_suppkey AS c, 'n' || s_nationkey || '.py#' AS n, s_nationkey AS k, s_suppkey AS i FROM supplier)
  SELECT p || 'main' AS source, p || c || '.run' AS target, 'call' AS kind FROM s
  UNION ALL SELECT p || c || '.run', n || 'Left' || k || '.save', 'call' FROM s WHERE i % 5 <> 0
  UNION ALL SELECT p || c || '.run', n || 'Store' || k || '.save', 'call' FROM s WHERE i % 3 = 0 AND i % 5 <> 0"""


def _raw(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = materialize(S.facts(files), "raw-facts")
    defs = materialize(G.definitions(raw), "definitions")
    return raw, defs, materialize(G.module_bindings(raw, defs), "bindings")


def flask_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blueprint for each nation, registered on one application, with a rule for each of its suppliers."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    rule = F.format_string("@bp.route('/s%d/<int:k>', methods=['get', 'POST'])\ndef f%d(k):\n    return ''\n", "s_suppkey", "s_suppkey")
    rules = supplier.groupBy("s_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", rule.alias("r")))), lambda x: x["r"]), "").alias("rules"))
    blue = nation.join(rules, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.format_string("web/n%d.py", "n_nationkey").alias("path"), F.concat(F.format_string("from flask import Blueprint\nbp = Blueprint('n', __name__, url_prefix='/nation%d')\n", "n_nationkey"), F.coalesce("rules", F.lit(""))).alias("text"))
    line = F.format_string("from web.n%d import bp as b%d\napp.register_blueprint(b%d)\n", "n_nationkey", "n_nationkey", "n_nationkey")
    app = nation.agg(F.concat(F.lit("from flask import Flask\napp = Flask(__name__)\n"), F.array_join(F.sort_array(F.collect_list(line)), "")).alias("text")).select(F.lit("web/app.py").alias("path"), "text")
    raw, _, bindings = _raw(blue.unionByName(app).select("path", F.encode("text", "UTF-8").alias("content")))
    return P.flask_routes(raw, bindings).select("method", "template", "id", "constraints")


FLASK_SQL = "SELECT m AS method, '/nation' || s_nationkey || '/s' || s_suppkey || '/{}' AS template, 'web/n' || s_nationkey || '.py#f' || s_suppkey AS id, '2:int' AS constraints FROM supplier, (VALUES ('GET'), ('POST')) v(m)"


def django_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A urlconf that includes one for each nation, which has a path for each of its suppliers."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    listed = lambda column, entry: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(column, entry.alias("e")))), lambda x: x["e"]), ", ")
    inner = supplier.groupBy("s_nationkey").agg(listed("s_suppkey", F.format_string("path('s%d/<slug:k>/', views.show)", "s_suppkey")).alias("items"))
    urls_ = inner.select(F.format_string("app/n%d.py", "s_nationkey").alias("path"), F.concat(F.lit("from django.urls import path\nfrom app import views\nurlpatterns = ["), "items", F.lit("]\n")).alias("text"))
    outer = nation.agg(listed("n_nationkey", F.format_string("path('n%d/', include('app.n%d'))", "n_nationkey", "n_nationkey")).alias("items")).select(F.lit("app/urls.py").alias("path"), F.concat(F.lit("from django.urls import path, include\nurlpatterns = ["), "items", F.lit("]\n")).alias("text"))
    views = nation.limit(1).select(F.lit("app/views.py").alias("path"), F.lit("def show(request, k):\n    pass\n").alias("text"))
    raw, _, bindings = _raw(urls_.unionByName(outer).unionByName(views).select("path", F.encode("text", "UTF-8").alias("content")))
    return P.django_routes(raw, bindings, "app.urls")


DJANGO_SQL = "SELECT '/n' || s_nationkey || '/s' || s_suppkey || '/{}/' AS template, 'app/views.py#show' AS id, '2:slug' AS constraints, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS ordinal FROM supplier"


def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each page that requests its url, every third with a value as host."""
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^(https?://)[^/]*", "$1{host}")).otherwise(F.col("url"))
    text = F.concat(F.lit("import requests\ndef go(host):\n    requests.get("), F.when(F.col("page_id") % 3 == 0, F.lit("f")).otherwise(F.lit("")), F.lit("'"), url, F.lit("')\n"))
    files = table(spark, sf_dir, "pages").select(F.format_string("c%d.py", "page_id").alias("path"), F.encode(text, "UTF-8").alias("content"))
    raw, _, bindings = _raw(files)
    return P.client_calls(raw, bindings).select("method", "template", "anchor", "authority", "id")


CLIENT_SQL = """SELECT 'GET' AS method, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS template, CASE WHEN page_id % 3 = 0 THEN 'base' ELSE 'root' END AS anchor,
  CASE WHEN page_id % 3 <> 0 THEN lower(regexp_extract(url, '://([^/?#]*)', 1)) END AS authority, 'c' || page_id || '.py#go' AS id FROM pages"""


def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client for each nation, with a base for even ones, that its suppliers' modules import; a client of their own for odd suppliers."""
    base = F.when(F.col("n_nationkey") % 2 == 0, F.format_string("base_url='https://N%d.example/v%d'", "n_nationkey", "n_nationkey")).otherwise(F.lit("base_url=where()"))
    clients = table(spark, sf_dir, "nation").select(F.format_string("net/n%d.py", "n_nationkey").alias("path"), F.concat(F.lit("import httpx\nclient = httpx.Client("), base, F.lit(")\n")).alias("text"))
    own = F.when(F.col("s_suppkey") % 2 == 1, F.format_string("class Box:\n    def __init__(self):\n        self.s = requests.Session()\n    def go(self, k):\n        self.s.put(f'https://own.example/b%d/{k}')\n", "s_suppkey")).otherwise(F.lit(""))
    use = F.concat(F.format_string("import requests\nfrom net.n%d import client as c\ndef load(k):\n    return c.get('/s%d/a')\n", "s_nationkey", "s_suppkey"), own)
    uses = table(spark, sf_dir, "supplier").select(F.format_string("s%d.py", "s_suppkey").alias("path"), use.alias("text"))
    raw, _, bindings = _raw(clients.unionByName(uses).select("path", F.encode("text", "UTF-8").alias("content")))
    return P.session_calls(raw, bindings).select("method", "template", "anchor", "authority", "id")


SESSION_SQL = """SELECT 'GET' AS method, CASE WHEN s_nationkey % 2 = 0 THEN '/v' || s_nationkey ELSE '' END || '/s' || s_suppkey || '/a' AS template, CASE WHEN s_nationkey % 2 = 0 THEN 'root' ELSE 'base' END AS anchor, CASE WHEN s_nationkey % 2 = 0 THEN 'n' || s_nationkey || '.example' END AS authority, 's' || s_suppkey || '.py#load' AS id FROM supplier
  UNION ALL SELECT 'PUT', '/b' || s_suppkey || '/{}', 'root', 'own.example', 's' || s_suppkey || '.py#Box.go' FROM supplier WHERE s_suppkey % 2 = 1"""


def _url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module of constants for each nation, of which every fifth binds its base twice; for each supplier a module that calls with a URL put together in one of six ways."""
    n = "n_nationkey"
    twice = F.when(F.col(n) % 5 == 0, F.lit("V += '/more'\n")).otherwise(F.lit(""))
    settings = table(spark, sf_dir, "nation").select(F.format_string("conf/n%d.py", n).alias("path"), F.concat(F.format_string("HOST = 'https://n%d.example'\nV = HOST + '/v%d'\n", n, n), twice, F.lit("PAGE = '{base}/{kind}/{k}'\n")).alias("text"))
    ways = ("V + '/sum/' + k", "f'{conf.V}/text/{k}'", "'%s/percent/%s' % (V, k)", "'%(v)s/keyed/%(k)s' % {'v': conf.V, 'k': k}", "PAGE.format(base=V, kind='format', k=k)", "local")
    way = F.element_at(F.array(*map(F.lit, ways)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    use = F.concat(F.format_string("import requests, httpx\nfrom conf import n%d as conf\nfrom conf.n%d import V, PAGE\nclient = httpx.Client(base_url=V)\n", "s_nationkey", "s_nationkey"), F.lit("def load(k):\n    local = f'{V}/local/{k}'\n    requests.get("), way, F.format_string(")\ndef ask():\n    client.post('/s%d')\n", "s_suppkey"))
    uses = table(spark, sf_dir, "supplier").select(F.format_string("s%d.py", "s_suppkey").alias("path"), use.alias("text"))
    return settings.unionByName(uses).select("path", F.encode("text", "UTF-8").alias("content"))


def url_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of functions and of clients, whose URLs and bases are put together from constants of other modules."""
    raw = materialize(python_texts.text_facts(_url_files(spark, sf_dir)), "raw-facts")
    bindings = materialize(G.module_bindings(raw, G.definitions(raw)), "bindings")
    told = materialize(texts.arguments(raw), "arguments")
    return P.client_calls(raw, bindings, told).unionByName(P.session_calls(raw, bindings, texts=told)).select("method", "template", "anchor", "authority", "id")


URL_TEXTS_SQL = """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_nationkey % 5 <> 0 AS known, ['sum', 'text', 'percent', 'keyed', 'format', 'local'][CAST(s_suppkey % 6 AS INTEGER) + 1] AS way FROM supplier)
  SELECT 'GET' AS method, CASE WHEN known THEN '/v' || n || '/' || way || '/{}' ELSE '/' || way || '/{}' END AS template, CASE WHEN known THEN 'root' ELSE 'base' END AS anchor, CASE WHEN known THEN 'n' || n || '.example' END AS authority, 's' || k || '.py#load' AS id FROM s
  UNION ALL SELECT 'POST', CASE WHEN known THEN '/v' || n ELSE '' END || '/s' || k, CASE WHEN known THEN 'root' ELSE 'base' END, CASE WHEN known THEN 'n' || n || '.example' END, 's' || k || '.py#ask' FROM s"""


def relation_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module for each supplier that runs SQL over two tables."""
    text = F.format_string("def load(cursor, k):\n    cursor.execute('SELECT * FROM t%d JOIN shop.n%d n ON n.id = %%s', [k])\n", "s_suppkey", "s_nationkey")
    files = table(spark, sf_dir, "supplier").select(F.format_string("q%d.py", "s_suppkey").alias("path"), F.encode(text, "UTF-8").alias("content"))
    return P.sql_uses(materialize(S.facts(files), "raw-facts")).select("id", "relation")


RELATION_SQL = "SELECT 'q' || s_suppkey || '.py#load' AS id, 't' || s_suppkey AS relation FROM supplier UNION ALL SELECT 'q' || s_suppkey || '.py#load', 'shop.n' || s_nationkey FROM supplier"


def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files: those of every fifth part are no Python."""
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit("def (:\n")).otherwise(F.format_string("x = %d\n", "p_partkey"))
    return S.outcomes(S.facts(table(spark, sf_dir, "part").select(F.format_string("p%d.py", "p_partkey").alias("path"), F.encode(text, "UTF-8").alias("content"))))


OUTCOMES_SQL = "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'syntax-error' ELSE 'parsed' END AS outcome, count(*) AS n FROM part GROUP BY 1"


def parse_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of 6 to 55 bytes, those of every fifth part no Python, under a budget of 20 bytes a part: outcomes of all."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.lit("def (:\n")).otherwise(F.concat(F.lit("x = 1"), F.repeat(F.lit(" "), F.col("p_size") - 1), F.lit("\n"))).alias("text"))
    files = materialize(parts.select(F.format_string("p%d.py", "p_partkey").alias("path"), F.encode("text", "UTF-8").alias("content"), F.length("text").cast("long").alias("length")), "files")
    return S.outcomes(S.budgeted(materialize(S.facts(files), "raw-facts"), files, 20 * files.count()))


BUDGET_SQL = """WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY 'p' || p_partkey || '.py') AS k, p_size + 5 AS n FROM part WHERE p_partkey % 5 <> 0),
    w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(20 * (SELECT count(*) FROM part) AS BIGINT) AS rest, false AS taken UNION ALL SELECT f.k, CASE WHEN n <= rest THEN rest - n ELSE rest END, n <= rest FROM w JOIN f ON f.k = w.k + 1)
  SELECT CASE WHEN taken THEN 'parsed' ELSE 'source-budget' END AS outcome, count(*) AS n FROM w WHERE k > 0 GROUP BY 1
  UNION ALL SELECT 'syntax-error', count(*) FROM part WHERE p_partkey % 5 = 0"""


def route_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular expression for each part, of five shapes."""
    k, n = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    pattern = (
        F.when(k == 0, F.concat(F.lit("^p"), n, F.lit("/(?P<k>[0-9]+)/$")))
        .when(k == 1, F.concat(F.lit("^p"), n, F.lit(r"/(?P<s>[-\w]+)/x\.y$")))
        .when(k == 2, F.concat(F.lit("^p"), n, F.lit("/(?P<rest>.*)$")))
        .when(k == 3, F.concat(F.lit("^p"), n, F.lit("/(?:a|b)/$")))
        .otherwise(F.concat(F.lit("^p"), n, F.lit(r"/(\d{4})/([^/]+)/?$")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", pattern.alias("pattern")).select("p_partkey", patterns.pattern_template(F.col("pattern")).alias("template"), patterns.pattern_kinds(F.col("pattern")).alias("kinds"), patterns.optional_slash(F.col("pattern")).cast("int").alias("optional"))


PATTERNS_SQL = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/p' || p_partkey || '/{}/' WHEN 1 THEN '/p' || p_partkey || '/{}/x.y' WHEN 2 THEN '/p' || p_partkey || '/{**}' WHEN 4 THEN '/p' || p_partkey || '/{}/{}' END AS template,
  CASE p_partkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'slug' WHEN 2 THEN 'path' WHEN 3 THEN '' ELSE 'regex' END AS kinds, CAST(p_partkey % 5 = 4 AS INT) AS optional FROM part"""


def manifest_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement line for each part, of its brand from its size on; every 400th without a start."""
    line = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 400 == 7, F.lit("<9")).otherwise(F.concat(F.lit(">="), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))))
    text = table(spark, sf_dir, "part").select(F.replace(line, F.lit("#"), F.lit("_")).alias("text"))
    return manifests.minimums(manifests.declarations(text))


MINIMUMS_SQL = """WITH d AS (SELECT lower(replace(p_brand, '#', '-')) AS package, p_size AS a, p_partkey % 10 AS b, p_partkey % 400 = 7 AS none FROM part)
  SELECT package, CASE WHEN NOT bool_or(none) THEN CAST(min(a * 10 + b) // 10 AS INT) END AS major, CASE WHEN NOT bool_or(none) THEN CAST(min(a * 10 + b) % 10 AS INT) END AS minor FROM d GROUP BY package"""

# the star schema as models: model, field, table, column, target
FIELDS = (("Order", "customer", "orders", "o_custkey", "Customer"), ("Order", "pk", "orders", "o_orderkey", None), ("Customer", "nation", "customer", "c_nationkey", "Nation"), ("Nation", "region", "nation", "n_regionkey", "Region"), ("Region", "name", "region", "r_name", None))


def lookup_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup path for each order: to its region's name, a comparison, or nowhere."""
    k = F.col("o_orderkey") % 4
    path = F.when(k == 0, "customer__nation__region__name").when(k == 1, "pk__in").when(k == 2, "customer__nation__icontains").otherwise("customer__city")
    sites = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.lit("Order").alias("model"), path.alias("path"))
    return catalog.walk_lookups(sites, spark.createDataFrame(FIELDS, "model string, name string, table_name string, column_name string, target string"))


LOOKUPS_SQL = """WITH w(k, table_name, column_name) AS (VALUES (0, 'orders', 'o_custkey'), (0, 'customer', 'c_nationkey'), (0, 'nation', 'n_regionkey'), (0, 'region', 'r_name'), (1, 'orders', 'o_orderkey'), (2, 'orders', 'o_custkey'), (2, 'customer', 'c_nationkey'), (3, 'orders', 'o_custkey'), (3, NULL, NULL))
  SELECT o_orderkey AS site, table_name, column_name FROM orders JOIN w ON o_orderkey % 4 = k"""


def router_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view set for each nation on one router: generic ones with an action, or with a list of their own."""
    nation, even = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 2 == 0
    body = F.when(even, F.format_string("from rest_framework import viewsets\nfrom rest_framework.decorators import action\nclass V%d(viewsets.ReadOnlyModelViewSet):\n    @action(detail=True, methods=['post'])\n    def go(self, request):\n        pass\n", "n_nationkey")).otherwise(F.format_string("class V%d:\n    def list(self, request):\n        pass\n", "n_nationkey"))
    views = nation.select(F.format_string("api/v%d.py", "n_nationkey").alias("path"), body.alias("text"))
    line = F.format_string("from api.v%d import V%d\nrouter.register('n%d', V%d)\n", *["n_nationkey"] * 4)
    urls_ = nation.agg(F.concat(F.lit("from rest_framework import routers\nrouter = routers.SimpleRouter()\n"), F.array_join(F.sort_array(F.collect_list(line)), "")).alias("text")).select(F.lit("api/urls.py").alias("path"), "text")
    raw, defs, bindings = _raw(views.unionByName(urls_).select("path", F.encode("text", "UTF-8").alias("content")))
    return P.router_routes(raw, bindings, defs)


ROUTER_SQL = """SELECT m AS method, '/n' || n_nationkey || t AS template, 'api/v' || n_nationkey || '.py#V' || n_nationkey || '.' || h AS id FROM nation, (VALUES (0, 'GET', '/', 'list'), (0, 'GET', '/{}/', 'retrieve'), (0, 'POST', '/{}/go/', 'go'), (1, 'GET', '/', 'list')) v(k, m, t, h) WHERE n_nationkey % 2 = k"""



def _model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application for each nation, with an abstract class, a model and one that refers to it, and a module for each supplier that asks both."""
    n = "n_nationkey"
    text = F.format_string(
        "from django.db import models\nclass Named(models.Model):\n    name = models.CharField(max_length=9)\n    class Meta:\n        abstract = True\n"
        "class Nation%d(Named):\n    region = models.IntegerField(db_column='r')\n"
        "class Supplier%d(Named):\n    nation = models.ForeignKey(Nation%d, models.CASCADE, related_name='suppliers')\n    class Meta:\n        db_table = 't%d'\n",
        *[n] * 4,
    )
    apps = table(spark, sf_dir, "nation").select(F.format_string("shop%d/models.py", n).alias("path"), text.alias("text"))
    use = F.format_string(
        "from shop%d.models import Nation%d as N, Supplier%d as S\ndef load():\n    return S.objects.filter(nation__name='x').order_by('-name')\ndef back():\n    return N.objects.exclude(suppliers__pk=1).all()\n",
        *["s_nationkey"] * 3,
    )
    uses = table(spark, sf_dir, "supplier").select(F.format_string("use%d.py", "s_suppkey").alias("path"), use.alias("text"))
    return apps.unionByName(uses).select("path", F.encode("text", "UTF-8").alias("content"))


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    raw, defs, bindings = _raw(_model_files(spark, sf_dir))
    names = models.resolved_names(raw, bindings)
    return raw, names, *models.catalogue(raw, defs, names)


def orm_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir)[2].select("id", F.col("abstract").cast("int").alias("abstract"), "table_name")


def orm_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir)[3]


def orm_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_uses(*_models(spark, sf_dir)).drop("line")


_APPS = "a AS (SELECT 'shop' || n_nationkey || '/models.py#' AS p, n_nationkey AS k, 'shop' || n_nationkey || '_nation' || n_nationkey AS n, 't' || n_nationkey AS s FROM nation)"
MODELS_SQL = f"""WITH {_APPS} SELECT p || 'Named' AS id, 1 AS abstract, NULL AS table_name FROM a UNION ALL SELECT p || 'Nation' || k, 0, n FROM a UNION ALL SELECT p || 'Supplier' || k, 0, s FROM a"""
FIELDS_SQL = f"""WITH {_APPS}, f(m, name, c, t) AS (VALUES ('Nation', 'id', 'id', NULL), ('Nation', 'pk', 'id', NULL), ('Nation', 'name', 'name', NULL), ('Nation', 'region', 'r', NULL), ('Nation', 'suppliers', 'nation_id', 'Supplier'),
    ('Supplier', 'id', 'id', NULL), ('Supplier', 'pk', 'id', NULL), ('Supplier', 'name', 'name', NULL), ('Supplier', 'nation', 'nation_id', 'Nation'), ('Supplier', 'nation_id', 'nation_id', NULL))
  SELECT p || m || k AS model, name, CASE WHEN m = 'Nation' AND t IS NULL THEN n ELSE s END AS table_name, c AS column_name, p || t || k AS target FROM a, f"""
ORM_USES_SQL = f"""WITH {_APPS}, u(f, r, c) AS (VALUES ('load', 's', NULL), ('load', 's', 'nation_id'), ('load', 'n', 'name'), ('load', 's', 'name'), ('back', 'n', NULL), ('back', 's', 'nation_id'), ('back', 's', 'id'))
  SELECT 'use' || s_suppkey || '.py#' || f AS id, CASE r WHEN 's' THEN s ELSE n END AS relation, c AS column_name FROM supplier JOIN a ON s_nationkey = k, u"""

QUERIES = {
    "python_graph_edges": python_graph,
    "python_hinted_edges": hinted_edges,
    "python_hinted_calls": hinted_calls,
    "python_call_outcomes": python_calls,
    "python_bound_edges": bound_edges,
    "python_flask_routes": flask_routes,
    "python_django_routes": django_routes,
    "python_client_calls": client_calls,
    "python_session_calls": session_calls,
    "python_url_texts": url_texts,
    "python_relation_uses": relation_uses,
    "python_parse_outcomes": parse_outcomes,
    "python_parse_budget": parse_budget,
    "python_router_routes": router_routes,
    "route_template_classify": route_patterns,
    "manifest_minimums": manifest_minimums,
    "orm_lookup_walk": lookup_walk,
    "orm_models": orm_models,
    "orm_fields": orm_fields,
    "orm_relation_uses": orm_uses,
}
ORACLES = {
    "python_graph_edges": PYTHON_GRAPH_SQL,
    "python_hinted_edges": HINTED_EDGES_SQL,
    "python_hinted_calls": HINTED_CALLS_SQL,
    "python_call_outcomes": PYTHON_CALLS_SQL,
    "python_bound_edges": BOUND_SQL,
    "python_flask_routes": FLASK_SQL,
    "python_django_routes": DJANGO_SQL,
    "python_client_calls": CLIENT_SQL,
    "python_session_calls": SESSION_SQL,
    "python_url_texts": URL_TEXTS_SQL,
    "python_relation_uses": RELATION_SQL,
    "python_parse_outcomes": OUTCOMES_SQL,
    "python_parse_budget": BUDGET_SQL,
    "python_router_routes": ROUTER_SQL,
    "route_template_classify": PATTERNS_SQL,
    "manifest_minimums": MINIMUMS_SQL,
    "orm_lookup_walk": LOOKUPS_SQL,
    "orm_models": MODELS_SQL,
    "orm_fields": FIELDS_SQL,
    "orm_relation_uses": ORM_USES_SQL,
}
