from pyspark.sql import functions as F

from tests.test_functions import values
from tracewell.functions import patterns
from tracewell.operators import catalog, python_facts, python_graph
from tracewell.sources import manifests, python_sources


def test_patterns(spark):
    a = F.col("a")
    cases = {
        r"^articles/(?P<year>[0-9]+)/$": ("/articles/{}/", "int"),
        r"^a/(?P<s>[-\w]+)/(?P<k>[^/]+)$": ("/a/{}/{}", "slug"),
        r"^files/(?P<p>.*)$": ("/files/{**}", "path"),
        r"^x\.y/(\d{4})/?$": ("/x.y/{}", "regex"),
        r"^(?:a|b)/$": (None, ""),
        r"^a+/$": (None, ""),
        r"^p(?P<a>\d+)(?P<b>\d+)/$": (None, "int,int"),
        r"^(?P<p>.*)/end$": (None, "path"),
        r"^u/(?P<u>[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/$": ("/u/{}/", "uuid"),
    }
    assert values(spark, patterns.pattern_template(a), *cases) == [t for t, _ in cases.values()]
    assert values(spark, patterns.pattern_kinds(a), *cases) == [k for _, k in cases.values()]


def test_manifests(spark):
    rows = spark.createDataFrame([('Django>=4.2,<6\nflask_sqlalchemy==3.1.1  # x\nrequests\nhttpx~=0.27\n',), ('dependencies = [\n  "django>=3.2",\n  "aiohttp<4",\n]\nuvicorn = "^0.30"\n',)], "text string")
    got = {r.package: (r.major, r.minor) for r in manifests.minimums(manifests.declarations(rows)).collect()}
    assert got == {"django": (3, 2), "flask-sqlalchemy": (3, 1), "httpx": (0, 27), "aiohttp": (None, None), "uvicorn": (0, 30)}


def test_lookups(spark):
    fields = spark.createDataFrame(
        [("Order", "customer", "orders", "customer_id", "Customer"), ("Order", "pk", "orders", "id", None), ("Customer", "name", "customers", "name", None), ("Customer", "orders", "orders", "customer_id", "Order")],
        "model string, name string, table_name string, column_name string, target string",
    )
    sites = spark.createDataFrame([(1, "Order", "customer__name__icontains"), (2, "Order", "customer__nothing"), (3, "Customer", "orders__pk__in"), (4, "Order", "name"), (5, "Order", "pk__more__in")], "site int, model string, path string")
    got = {}
    for r in catalog.walk_lookups(sites, fields).collect():
        got.setdefault(r.site, set()).add((r.table_name, r.column_name))
    assert got == {1: {("orders", "customer_id"), ("customers", "name")}, 2: {("orders", "customer_id"), (None, None)}, 3: {("orders", "customer_id"), ("orders", "id")}, 4: {(None, None)}, 5: {("orders", "id"), (None, None)}}


FILES = {
    "api/views.py": "from rest_framework import viewsets\nfrom rest_framework.decorators import action\nclass Items(viewsets.ModelViewSet):\n    @action(detail=True, methods=['post'], url_path='go-on')\n    def go(self):\n        pass\n    @action(detail=False)\n    def top(self):\n        pass\nclass Own:\n    def list(self):\n        pass\n",
    "api/urls.py": "from rest_framework import routers\nfrom api import views\nrouter = routers.DefaultRouter()\nrouter.register('items', views.Items)\nrouter.register('own', views.Own)\n",
    "net.py": "def fetch(path, method):\n    pass\ndef use(k):\n    fetch(f'/a/{k}?x=1', 'put')\n    fetch('/b/./c')\n    fetch(k)\n",
}


def test_routers_and_wrappers(spark):
    raw = python_sources.facts(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in FILES.items()], "path string, content binary")).cache()
    defs = python_graph.definitions(raw).cache()
    bindings = python_graph.module_bindings(raw, defs).cache()
    got = {(r.method, r.template, r.id.split("#")[1]) for r in python_facts.router_routes(raw, bindings, defs).collect()}
    assert got == {
        ("GET", "/items/", "Items.list"), ("POST", "/items/", "Items.create"), ("GET", "/items/{}/", "Items.retrieve"), ("PUT", "/items/{}/", "Items.update"), ("PATCH", "/items/{}/", "Items.partial_update"), ("DELETE", "/items/{}/", "Items.destroy"),
        ("POST", "/items/{}/go-on/", "Items.go"), ("GET", "/items/top/", "Items.top"), ("GET", "/own/", "Own.list"),
    }
    wrappers = spark.createDataFrame([("net.py#fetch", 0, 1, "GET", "base", "shop"), ("net.py#gone", 0, None, "GET", "base", None)], "target string, path_index int, method_index int, default_method string, anchor string, service string")
    calls = python_facts.wrapped_calls(raw, bindings, wrappers)
    assert sorted((r.method, r.template or "", r.service) for r in calls.collect()) == [("GET", "", "shop"), ("GET", "/b/c", "shop"), ("PUT", "/a/{}", "shop")]
    used = spark.createDataFrame([("net.py#fetch",)], "target string")
    assert [(r.target, r.calls) for r in python_facts.unresolved_wrappers(wrappers, used, defs).collect()] == [("net.py#gone", 0)]
