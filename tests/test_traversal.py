"""Traversals of random graphs against breadth-first search from each root in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import edges as E
from tracewell.operators import traversal as T

KINDS = ("call", "new", "reference")


def case(seed):
    r = random.Random(seed)
    n = r.randint(2, 14)
    names = [f"n{k}" if k % 5 else r.choice(("\U0001f600", "～", "z")) + str(k) for k in range(n)]
    density = r.choice((0.08, 0.15, 0.3))
    raw = [(a, b, r.choice(KINDS), r.choice(E.TIERS)) for a in names for b in names for _ in range(2) if r.random() < density]
    roots = r.sample(names, min(n, r.randint(1, 4)))
    if r.random() < 0.3:
        roots.insert(r.randint(0, len(roots)), "nowhere")
    return names, raw, roots, r.choice((1, 2, 3, 128)), r.choice(("dependencies", "dependents")), r.choice(tuple(E.MODES)), r.choice((3, 100_000))


def merged(raw, names):
    sets = {}
    for a, b, kind, tier in raw:
        if a in names and b in names:
            sets.setdefault((a, b), {}).setdefault(tier, set()).add(kind)
    out = []
    for (a, b), by in sets.items():
        covered = set()
        for tier in E.TIERS:
            if by.get(tier, set()) - covered:
                out.append((a, b, tuple(sorted(by[tier])), tier))
                covered |= by[tier]
    return out


def distances(graph, root, depth, tier, flip):
    near = {}
    for a, b, _, t in graph:
        if E.TIERS.index(t) <= tier:
            near.setdefault(b if flip else a, set()).add(a if flip else b)
    out, frontier = {root: 0}, [root]
    for d in range(1, depth + 1):
        frontier = sorted({y for x in frontier for y in near.get(x, ())} - out.keys())
        out |= dict.fromkeys(frontier, d)
    return out, near


def brute(names, raw, roots, depth, direction, mode, most):
    graph, limit, flip = merged(raw, names), E.MODES[mode], direction == "dependents"
    key = lambda s: s.encode("utf-16-be")
    known = [(i, x) for i, x in enumerate(roots) if x in names]
    dist = {t: {i: distances(graph, x, depth, t, flip)[0] for i, x in known} for t in range(limit + 1)}
    near = distances(graph, "", 0, limit, flip)[1]
    rows = []
    for node in names:
        pairs = {i: dist[limit][i][node] for i, x in known if node in dist[limit][i] and x != node}
        if not pairs:
            continue
        d = min(pairs.values())
        nearest = min(i for i, v in pairs.items() if v == d)
        via = min((s for s in near if node in near[s] and dist[limit][nearest].get(s) == d - 1), key=key)
        kinds = sorted({k for a, b, ks, t in graph if E.TIERS.index(t) <= limit and ((b, a) if flip else (a, b)) == (via, node) for k in ks})
        full = sum(node in dist[limit][i] for i, _ in known)
        tier = next(t for t in range(limit + 1) if sum(node in dist[t][i] for i, _ in known) == full)
        rows.append((node, via, d, tuple(sorted(pairs)), tuple(kinds), E.TIERS[tier]))
    rows.sort(key=lambda x: (x[2], key(x[0])))
    cut = any(v == depth and any(y not in dist[limit][i] for y in near.get(x, ())) for i, _ in known for x, v in dist[limit][i].items())
    reasons = [r for r, on in (("depth", cut), ("max-reached", len(rows) > most), ("root-not-found", len(known) < len(roots))) if on]
    return rows[:most], ",".join(reasons)


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    names, raw, roots, depth, direction, mode, most = case(seed)
    nodes = spark.createDataFrame([(x,) for x in names], "id string").coalesce(1)
    edges = E.merge_edges(spark.createDataFrame(raw, "source string, target string, kind string, evidence string").coalesce(1), nodes)
    assert sorted((r.source, r.target, tuple(r.kinds), r.evidence) for r in edges.collect()) == sorted(merged(raw, set(names)))
    asked = spark.createDataFrame(list(enumerate(roots)), "root_idx int, id string").coalesce(1)
    found = T.traverse(nodes, edges, asked, direction, mode, depth, most)
    rows, reasons = brute(names, raw, roots, depth, direction, mode, most)
    assert [(r.id, r.via, r.depth, tuple(r.roots), tuple(r.relationships), r.evidence) for r in found.rows.collect()] == rows
    assert found.meta.first().reasons == reasons


def test_more_roots_than_are_listed(spark):
    names = [f"r{k:03d}" for k in range(80)]
    nodes = spark.createDataFrame([(x,) for x in [*names, "hub", "end"]], "id string")
    raw = spark.createDataFrame([(x, "hub", "call", "direct") for x in names] + [("hub", "end", "call", "direct")], "source string, target string, kind string, evidence string")
    found = T.traverse(nodes, E.merge_edges(raw, nodes), spark.createDataFrame(list(enumerate(names)), "root_idx int, id string"))
    assert [(r.id, len(r.roots), r.roots[-1]) for r in found.rows.collect()] == [("hub", 64, 63), ("end", 64, 63)]
    assert found.meta.first().roots_truncated


def test_bounds_are_checked(spark):
    none = spark.createDataFrame([], "id string")
    for bad in ({"dispatch": "all"}, {"max_depth": 0}, {"max_reached": 100_001}):
        with pytest.raises(ValueError):
            T.traverse(none, none, none, **bad)


def test_numbered_roots_and_utf16(spark):
    ids = spark.createDataFrame([("b", 5), ("a", 7), ("b", 1)], "id string, pos int")
    assert [(r.root_idx, r.id) for r in T.number_roots(ids).orderBy("root_idx").collect()] == [(0, "b"), (1, "a")]
    rows = spark.createDataFrame([("～",), ("\U0001f600",), ("a",)], "s string").orderBy(T.utf16(F.col("s")))
    assert [r.s for r in rows.collect()] == ["a", "\U0001f600", "～"]


@pytest.mark.parametrize("depth", [3, 128])
def test_many_roots(spark, depth):
    """More roots than one number packs and than are listed, in an order that isn't the nodes'."""
    r = random.Random(depth)
    names = [f"n{k:03d}" for k in range(220)]
    raw = [(a, r.choice(names), r.choice(KINDS), r.choice(E.TIERS)) for a in names for _ in range(2)]
    roots = r.sample(names, 150)
    nodes = spark.createDataFrame([(x,) for x in names], "id string")
    edges = E.merge_edges(spark.createDataFrame(raw, "source string, target string, kind string, evidence string"), nodes)
    found = T.traverse(nodes, edges, spark.createDataFrame(list(enumerate(roots)), "root_idx int, id string"), "dependencies", "candidates", depth)
    rows, reasons = brute(names, raw, roots, depth, "dependencies", "candidates", 100_000)
    assert [(x.id, x.via, x.depth, tuple(x.roots), tuple(x.relationships), x.evidence) for x in found.rows.collect()] == [(a, b, c, d[:64], e, f) for a, b, c, d, e, f in rows]
    assert found.meta.first().reasons == reasons and found.meta.first().roots_truncated == any(len(x[3]) > 64 for x in rows)


def test_reach_of_all_orders(spark):
    """The registered query against a search from each root over the collected graph."""
    from tracewell.plans import graph_queries as Q

    sf = "/root/testdata/sf0.001"
    nodes, merged_edges = Q.graph(spark, sf)
    ids = {x.id for x in nodes.collect()}
    near = {}
    for x in merged_edges.collect():
        near.setdefault(x.source, set()).add(x.target)
    roots = sorted((i for i in ids if i.startswith("orders#")), key=lambda i: int(i.split("#")[1]))[: T.MOST_ROOTS]
    reached = {}
    for k, root in enumerate(roots):
        out, frontier, d = {root}, [root], 0
        while frontier:
            d += 1
            frontier = {y for x in frontier for y in near.get(x, ())} - out
            out |= frontier
            for y in frontier:
                reached.setdefault(y, []).append((d, k))
    got = {x.id: (x.depth, x.roots) for x in Q.WHOLE["reach_all_orders"](spark, sf).collect()}
    assert got == {y: (min(v)[0], ",".join(map(str, sorted(k for _, k in v)[:64]))) for y, v in reached.items()}


def test_reach_of_all_orders_has_no_bound(spark, monkeypatch):
    """All orders are roots, and all that they reach is told, however many a request may have."""
    from tracewell.plans import graph_queries as Q

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(T, "MOST_ROOTS", 100)
    monkeypatch.setattr(T.traverse_near, "__defaults__", ("direct", 1, 7))
    rows = Q.WHOLE["reach_all_orders"](spark, sf).collect()
    got = {x.id: len(x.roots.split(",")) for x in rows}
    assert all(x.n_roots == got[x.id] or x.n_roots > got[x.id] == T.KEPT_ROOTS for x in rows)
    own = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").count().collect()
    assert {k: v for k, v in got.items() if k.startswith("customer#")} == {f"customer#{x.o_custkey}": x["count"] for x in own}
    assert {k.split("#")[0] for k in got} == {"customer", "part", "supplier", "nation", "region"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(2))
def test_listed_kinds_merge_without_sorting(spark, seed):
    """Pairs as numbers give the rows that sets do; no edge is sorted for it, and a pair needs no second grouping for the adjacency."""
    names, raw, *_ = case(seed)
    nodes = spark.createDataFrame([(x,) for x in names], "id string").coalesce(1)
    rows = spark.createDataFrame(raw, "source string, target string, kind string, evidence string").coalesce(1)
    edges = E.merge_edges(rows, nodes, tuple(KINDS))
    assert sorted((r.source, r.target, tuple(r.kinds), r.evidence) for r in edges.collect()) == sorted(merged(raw, set(names)))
    for direction, weakest in (("dependencies", 2), ("dependents", 1)):
        near = E.pair_adjacency(E.pair_edges(rows, nodes, tuple(KINDS)), tuple(KINDS), direction, weakest)
        same = E.adjacency(edges, direction, weakest)
        assert sorted(map(str, near.collect())) == sorted(map(str, same.collect()))
        for df in (edges, near):
            assert "Sort" not in plan_of(df) and "ObjectHashAggregate" not in plan_of(df)
    with pytest.raises(Exception, match="not listed"):
        E.merge_edges(rows, nodes, tuple(KINDS[:1])).collect()
