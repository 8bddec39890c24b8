"""Bound edges of hand-written projects: each rule of what is followed and what opens a slot, worked out by hand."""

from tracewell.operators import python_graph, traversal
from tracewell.operators import value_flow as V
from tracewell.operators.joins import by_key, spread_nulls
from tracewell.sources.python_flow import flow_facts

REPOS = """class Repo:
    def save(self, x):
        return x
class Sql(Repo):
    def save(self, x):
        return x
class Mem(Repo):
    def save(self, x):
        return x
class Under(Sql):
    pass
class Odd:
    def __getattr__(self, name):
        return None
    def save(self, x):
        return x
"""

APP = """import other
from repos import Sql, Mem, Under, Odd
from wiring import shared, maybe

def rebound(flag):
    r = Sql()
    if flag:
        r = Mem()
    r.save(1)

def modules():
    shared.save(1)
    maybe.save(1)
    other.thing.save(1)

def conditional(flag):
    (Sql() if flag else Mem()).save(1)
    x = Sql() or None
    x.save(2)

def inherited():
    Under().save(1)

class Service:
    def __init__(self, repo, label=None):
        self.repo = repo
        self.label = label
    def run(self):
        self.repo.save(1)
        self.label.save(1)

def production():
    Service(Sql()).run()
    Service(repo=Mem(), label=Mem()).run()

def store(repo=None):
    repo.save(1)

def main():
    store(Mem())
    store()
    store(repo=Under())

def never(repo):
    repo.save(1)

def handed(repo):
    repo.save(1)

def hand():
    handed(Sql())
    [handed]

def named(repo):
    repo.save(1)

def name_it():
    named(Sql())
    return "app.named"

def starred(repo):
    repo.save(1)

def star(rows):
    starred(Sql())
    starred(*rows)

def make(flag):
    if flag:
        return Sql()
    return Mem()

def results():
    make(1).save(1)

def generator():
    yield Sql()

def from_generator():
    generator().save(1)

def hooks():
    o = Odd()
    o.save(1)

def unknown(rows):
    for r in rows:
        r.save(1)
    r = Sql()
    r.save(1)

def loop(r=Sql()):
    loop(r)
    r.save(1)

def chain(service):
    service.repo.save(1)

def chained():
    chain(Service(Sql(), None))

class Base:
    tool = Mem()
    def use(self):
        self.tool.save(1)

class Holder:
    pass

def write():
    h = Holder()
    h.inner = Under()
    h.inner.save(1)

class Factory:
    def build(self):
        return Mem()

def built():
    f = Factory()
    f = Factory()
    f.build().save(1)

def lambdas():
    (lambda r: r.save(1))(Sql())

def nested():
    r = Sql()
    r = Under()
    def inner():
        r.save(1)
    inner()
"""

WIRING = "from repos import Sql, Mem\nimport os\nif os.environ:\n    shared = Sql()\nelse:\n    shared = Mem()\nmaybe = os.environ.get('x') or Sql()\n"
OTHER = "from repos import Under\nthing = Under()\n"


def files(spark, sources):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in sources.items()], "path string, content binary")


def edges(spark, sources, **more):
    found: dict[str, set] = {}
    for r in V.bound_edges(flow_facts(files(spark, sources)), **more).collect():
        assert (r.kind, r.evidence) == ("call", "bound")
        found.setdefault(r.source.split("#")[1], set()).add(r.target.split("#")[1])
    return found


def test_what_is_followed(spark):
    sql, mem = "Sql.save", "Mem.save"
    got = edges(spark, {"repos.py": REPOS, "app.py": APP, "wiring.py": WIRING, "other.py": OTHER})
    assert got == {
        "rebound": {sql, mem},
        "modules": {sql, mem},
        "conditional": {sql, mem},
        "inherited": {sql},
        "Service.run": {sql, mem},
        "production": {"Service.run"},
        "store": {mem, sql},
        "results": {sql, mem},
        "chain": {sql, mem},
        "Base.use": {mem},
        "write": {sql},
        "built": {"Factory.build", mem},
        "nested.inner": {sql},
    }


# what a program may do outside what is seen: each of these takes the edge away that a module has without it
OPENED = {
    "unknown_write": "def x(o, v):\n    o.r{k} = v\n",
    "class_handed_on": "y = [S{k}]\n",
    "unknown_argument": "def x(v):\n    S{k}(v)\n",
    "named": "z = 'app.S{k}'\n",
    "hidden_method": "def x(v):\n    v.save{k} = print\n",
    "metaclass": "class T(S{k}, metaclass=abc):\n    pass\n",
    "foreign_base": "import away\nclass S{k}(away.Thing):\n    def __init__(self, r):\n        self.r{k} = r\n    def go(self):\n        self.r{k}.save{k}(1)\n",
}
MODULE = "class R{k}:\n    def save{k}(self, x):\n        pass\nclass S{k}:\n    def __init__(self, r):\n        self.r{k} = r\n    def go(self):\n        self.r{k}.save{k}(1)\ndef main():\n    S{k}(R{k}())\n"


def test_open_places(spark):
    sources = {f"m{k}.py": (MODULE + (line if k >= 100 else "")).replace("{k}", str(k)) for j, line in enumerate(OPENED.values()) for k in (j, 100 + j)}
    sources["late.py"] = "class R:\n    def save(self, x):\n        pass\nclass Q(R):\n    def save(self, x):\n        pass\nclass S:\n    def __init__(self, r):\n        self.r = r\n    def go(self):\n        self.r.save(1)\ndef main():\n    s = S(R())\n    s.r = Q()\n"
    assert edges(spark, sources) == {f"S{j}.go": {f"R{j}.save{j}"} for j in range(len(OPENED))} | {"S.go": {"R.save", "Q.save"}}


def test_steps_are_bounded(spark):
    assert edges(spark, {"m0.py": MODULE.replace("{k}", "0")}, most_rounds=2) == {}


def test_no_files(spark):
    assert edges(spark, {}) == {}


def test_no_table_is_sent_whole(spark, monkeypatch):
    """A program's tables are joined by key: none goes through the driver to all tasks, though those of a small program would fit."""
    plans, write = [], V.materialize

    def seen(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, tag)

    for module in (V, python_graph, traversal):
        monkeypatch.setattr(module, "materialize", seen)
    sources = {"repos.py": REPOS, "wiring.py": WIRING, "other.py": OTHER, "star.py": "from wiring import *\nshared.save(1)\n"}
    raw = flow_facts(files(spark, sources))
    for tag, last in (("bound", V.bound_edges(raw)), *zip(("nodes", "edges", "outcomes"), python_graph.graph(raw), strict=True)):
        plans.append((tag, last._jdf.queryExecution().executedPlan().toString()))
    assert sum("SortMergeJoin" in p for _, p in plans) > 20
    assert {tag for tag, p in plans if "Broadcast" in p} - {"edges"} == set()  # merge_edges is a step of other graphs as well


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(100).selectExpr("CASE WHEN id < 10 THEN concat('k', id) END AS key", "id")
    told = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "name string, told int")
    got = {r.id: (r.key, r.told) for r in rows.join(by_key(told), spread_nulls("key", rows.id.cast("string")) == told.name, "left").collect()}
    assert got == {i: (f"k{i}" if i < 10 else None, i if i < 5 else None) for i in range(100)}
    assert rows.select(spread_nulls("key", rows.id.cast("string"))).distinct().count() == 100
