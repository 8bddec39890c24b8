"""Impact of all changes against breadth-first search in plain Python."""

from tracewell.operators import change
from tracewell.plans import graph_queries as Q


def brute(spark, sf, side):
    nodes, merged = Q._sides(spark, sf)[side]
    path = {r.id: r.path for r in nodes.collect()}
    changed = {r.path for r in change.changed_files(*Q.snapshots(spark, sf)).collect() if r.status != ("added" if side == "before" else "deleted")}
    users = {}
    for r in merged.collect():
        users.setdefault(r.target, set()).add(r.source)
    seeds, depth = sorted(i for i, p in path.items() if p in changed), {}
    for seed in seeds:
        seen, frontier, d = {seed}, {seed}, 0
        while frontier:
            d += 1
            frontier = {y for x in frontier for y in users.get(x, ())} - seen
            seen |= frontier
            for x in frontier:
                depth[x] = min(d, depth.get(x, d))
    return {(side, i, d, path[i], path[i].startswith("tests/")) for i, d in depth.items()}, len(seeds)


def test_impact_of_all_changes(spark, small, monkeypatch):
    monkeypatch.setattr(change, "MOST_SEEDS", 90)
    flags = {r.side: (r.n_selected, r.n_seeds, r.seeds_truncated) for r in Q.change_impact_flags(spark, small).collect()}
    monkeypatch.undo()
    got = {(r.side, r.id, r.depth, r.path, r.test_candidate) for r in Q.change_impact(spark, small).collect()}
    want = set()
    for side in ("before", "after"):
        rows, n = brute(spark, small, side)
        want |= rows
        assert flags[side] == (n, min(n, 90), n > 90)
    assert got == want and any(r[4] for r in got) and max(r[2] for r in got) > 2


def test_they_are_registered():
    import __spark_entry__ as entry

    assert Q.WHOLE.keys() <= entry.queries().keys()
