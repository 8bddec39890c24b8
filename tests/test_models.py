"""Models, their fields and what queries name, on small projects with results worked out by hand."""

import pytest

from tracewell.operators import facts
from tracewell.operators import models as M
from tracewell.operators import python_facts as P
from tracewell.operators import python_graph as G
from tracewell.operators import sql_text
from tracewell.sources import python_sources as S

FILES = {
    "blog/models.py": """from django.db import models

class Stamped(models.Model):
    made = models.DateTimeField()
    owner = models.ForeignKey('people.Person', models.CASCADE, related_name='%(class)s_items')
    class Meta:
        abstract = True

class Place(Stamped):
    title = models.CharField(max_length=5, db_column='ttl')

class Cafe(Place):
    tags = models.ManyToManyField('Tag')
    near = models.ForeignKey('self', models.CASCADE, null=True, related_name='+')

class Tag(models.Model):
    code = models.CharField(max_length=3, primary_key=True)
    shade = Colour()

class Colour(models.CharField):
    pass

class CafeProxy(Cafe):
    class Meta:
        proxy = True

class Named(models.Model):
    class Meta:
        db_table = PREFIX + 'x'

class Nothing:
    code = models.CharField()
""",
    "people/models.py": "from django.db.models import Model, TextField\nclass Person(Model):\n    name = TextField()\n",
    "use.py": """from blog.models import Cafe, CafeProxy
from people.models import Person

def a():
    Cafe.objects.filter(owner__name='x', tags__code__in=[1]).order_by('-title', '?')
def b():
    CafeProxy.objects.annotate(n=1).filter(n=2).values('near__place_ptr')
def c():
    Cafe.objects.get(nothing=1)
def d():
    Person.objects.update_or_create(name='x', defaults={})
def e():
    Missing.objects.all()
def f():
    Person._default_manager.filter(place_items__cafe__isnull=True, pk=1)
def g(Person):
    Person.objects.first().name.filter(x=1)
""",
}
CAFES = {("blog_cafe", None), ("blog_place", None)}
USES = {
    "a": CAFES | {("blog_place", "owner_id"), ("people_person", "name"), ("blog_cafe_tags", "tag_id"), ("blog_tag", "code"), ("blog_place", "ttl")},
    "b": CAFES | {("blog_cafe", "near_id"), ("blog_cafe", "place_ptr_id")},
    "c": CAFES | {(None, None)},
    "d": {("people_person", None), ("people_person", "name")},
    "e": {(None, None)},
    "f": {("people_person", None), ("blog_place", "owner_id"), ("blog_cafe", "place_ptr_id"), ("people_person", "id")},
}


def read(spark, files):
    raw = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, content binary").transform(S.facts).cache()
    defs = G.definitions(raw).cache()
    return raw, defs, G.module_bindings(raw, defs).cache()


@pytest.fixture(scope="module")
def found(spark):
    raw, defs, bindings = read(spark, FILES)
    names = M.resolved_names(raw, bindings)
    models, fields = M.catalogue(raw, defs, names)
    return models, fields, M.model_uses(raw, names, models, fields)


def test_tables(found):
    got = {r.name: r.table_name for r in found[0].collect()}
    assert got == {"Stamped": None, "Place": "blog_place", "Cafe": "blog_cafe", "Tag": "blog_tag", "CafeProxy": "blog_cafe", "Named": None, "Person": "people_person"}


def test_fields(found):
    got = {}
    for r in found[1].collect():
        got.setdefault(r.model.split("#")[1], {})[r.name] = (r.table_name, r.column_name, r.target and r.target.split("#")[1])
    place = {"made": ("blog_place", "made", None), "owner": ("blog_place", "owner_id", "Person"), "owner_id": ("blog_place", "owner_id", None), "title": ("blog_place", "ttl", None), "id": ("blog_place", "id", None)}
    assert got["Place"] == place | {"pk": ("blog_place", "id", None), "cafe": ("blog_cafe", "place_ptr_id", "Cafe")}
    cafe = got["Place"] | {"pk": ("blog_cafe", "place_ptr_id", "Place"), "place_ptr": ("blog_cafe", "place_ptr_id", "Place"), "tags": ("blog_cafe_tags", "tag_id", "Tag"), "near": ("blog_cafe", "near_id", "Cafe"), "near_id": ("blog_cafe", "near_id", None)}
    assert got["Cafe"] == cafe and got["CafeProxy"] == cafe
    assert got["Tag"] == {"code": ("blog_tag", "code", None), "pk": ("blog_tag", "code", None), "shade": ("blog_tag", "shade", None), "cafe": ("blog_cafe_tags", "tag_id", "Cafe")}
    assert got["Person"]["place_items"] == ("blog_place", "owner_id", "Place") and "Nothing" not in got


def test_uses(found):
    got = {}
    for r in found[2].collect():
        got.setdefault(r.id.split("#")[1], set()).add((r.relation, r.column_name))
    assert {k: v for k, v in got.items() if k != "g"} == USES
    assert got["g"] == {(None, None)}


def test_no_models(spark):
    raw, defs, bindings = read(spark, {"x.py": "x = 1\n"})
    names = M.resolved_names(raw, bindings)
    models, fields = M.catalogue(raw, defs, names)
    assert models.count() == 0 and fields.count() == 0 and M.model_uses(raw, names, models, fields).count() == 0


def test_migration_paths(spark):
    paths = {"a/migrations/0001.py": True, "alembic/versions/x.py": True, "a/versions/x.py": False, "migrations.py": False, "a/migrations/versions/b.py": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.m for r in rows.withColumn("m", M.is_migration_path(rows.p)).collect()} == paths


def test_sql_likeness(spark):
    texts = {"select 1": (True, False), "-- select\nnothing": (False, False), "'select'": (False, False), '"select" x': (False, False), "UPDATE t": (True, True), "please update": (False, False), "a; DROP x": (True, True), "": (False, False), "truncate": (True, False), None: (None, None)}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: (r.a, r.b) for r in rows.select("t", sql_text.looks_like_sql(rows.t).alias("a"), sql_text.looks_like_sql(rows.t, True).alias("b")).collect()} == texts


def test_relation_use_facts(spark):
    schema = "channel string, column_name string, dynamic boolean, path string, line int, column int, usr string"
    rows = [("a.b", "c", False, "p", 1, 1, "u"), ("a.b", "c", False, "p", 1, 1, "u"), ("a.", "c", False, "p", 2, 1, None), ("t\x85", None, False, "p", 3, 1, "u"), ("t", "c\n", False, "p", 4, 1, "u"), ("\u3000\u2028", None, True, "p", 5, 1, None), (None, None, True, "p", 6, 1, "u")]
    uses = spark.createDataFrame(rows, schema)
    got = {(r.channel, r.method, r.dynamic, r.line) for r in facts.relation_uses(uses).collect()}
    assert facts.relation_uses(uses).count() == 6
    assert got == {("a.b", "c", False, 1), ("a.", None, True, 2), ("t", None, True, 3), ("t", None, True, 4), ("<dynamic>", None, True, 5), ("<dynamic>", None, True, 6)}
    assert {r.sentence[:25] for r in facts.relation_use_limits(uses).collect()} == {"invalid-relation-names: 3", "missing-relation-usrs: 2 "}
    assert facts.relation_use_limits(uses.limit(0)).count() == 0


ROUTES = {
    "site/urls.py": (
        "from django.urls import path, re_path, include\nfrom site import views\nurlpatterns = [re_path(r'^(?P<year>[0-9]{4})/$', views.year), re_path(r'^blog/', include('site.blog'))]\n"
        "urlpatterns.append(path('late/', views.late))\nurlpatterns.extend([re_path(r'old$|^new$', views.either), re_path(r'^open/', views.year)])\nother.append(path('no/', views.late))\n"
    ),
    "site/blog.py": "from django.urls import re_path\nfrom site import views\nurlpatterns = [re_path(r'^(?P<s>[-\\w]+)/?$', views.late), re_path(r'(?P<rest>.*)$', views.year), re_path(r'^(a.b)/$', views.either)]\n",
    "site/views.py": "def year(r):\n    pass\ndef late(r):\n    pass\ndef either(r):\n    pass\n",
    "web.py": "from flask import Flask\napp = Flask(__name__)\ndef show(k):\n    pass\napp.add_url_rule('/s/<int:k>', 'show', view_func=show, methods=['PUT'])\napp.add_url_rule('/plain', view_func=show)\napp.add_url_rule(name, view_func=show)\n",
}


def test_patterns_and_added_routes(spark):
    raw, defs, bindings = read(spark, ROUTES)
    got = [(r.template, r.id.split("#")[1], r.constraints) for r in P.django_routes(raw, bindings, "site.urls").orderBy("ordinal").collect()]
    assert got[0] == ("/{}/", "year", "")
    assert set(got[1:3]) == {("/blog/{}", "late", "1:slug"), ("/blog/{}/", "late", "1:slug")}
    assert got[3:] == [("/blog/{**}", "year", "1:path"), (None, "either", None), ("/late/", "late", ""), (None, "either", None), (None, "year", None)]
    flask = {(r.method, r.template, r.id, r.constraints) for r in P.flask_routes(raw, bindings).collect()}
    assert flask == {("PUT", "/s/{}", "web.py#show", "1:int"), ("GET", "/plain", "web.py#show", "")}


STARS = {
    "a.py": "def one():\n    pass\ndef _hidden():\n    pass\ndef two():\n    pass\n",
    "b.py": "from a import *\ndef two():\n    pass\n",
    "c.py": "__all__ = ['three']\n__all__ += ['_five']\ndef three():\n    pass\ndef four():\n    pass\ndef _five():\n    pass\n",
    "d.py": "from b import *\nfrom c import *\ndef go():\n    one()\n    two()\n    three()\n    _five()\ndef miss():\n    four()\ndef hid():\n    _hidden()\n",
    "e.py": "from a import *\nfrom b import *\ndef last():\n    two()\n",
    "f.py": "from g import *\n",
    "g.py": "from f import *\nfrom nowhere import *\n",
}


def test_star_imports(spark):
    raw = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in STARS.items()], "path string, content binary").transform(S.facts)
    _, edges, outcomes = G.graph(raw)
    assert {(r.source, r.target) for r in edges.collect()} == {("d.py#go", "a.py#one"), ("d.py#go", "b.py#two"), ("d.py#go", "c.py#three"), ("d.py#go", "c.py#_five"), ("e.py#last", "b.py#two")}
    assert {r.node: r.status for r in outcomes.where("node IN ('d.py#miss', 'd.py#hid')").collect()} == {"d.py#miss": "unresolved", "d.py#hid": "unresolved"}


def test_groups_of_an_order(spark):
    groups = {"g": None, " g": "group", "g\u00a0": "group", "\ufeffg": "group", "a\u2028b": "group", "": "group", "x" * 256: None, "x" * 257: "group", "a b": None}
    schema = "fact_id string, service string, method string, usr string, channel string, path string, line int, column int, `group` string, index long, catch_all boolean"
    rows = spark.createDataFrame([(g, "s", "GET", g, "/", "p", k, 1, g, k, False) for k, g in enumerate(groups)], schema)
    assert {r.fact_id: r.problem for r in facts.order_problems(rows).collect()} == {g: p for g, p in groups.items() if p}
