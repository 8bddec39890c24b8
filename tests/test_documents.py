"""Documents of facts, traversals and changes; scopes; patterns written out; format strings; against plain Python."""

import itertools
import json
import re
import string

import pytest
from pyspark.sql import functions as F

from tests.test_functions import values
from tracewell.functions import formats, patterns, requirements
from tracewell.operators import change, edges, facts, traversal
from tracewell.plans import graph_queries as Q
from tracewell.sources import documents

GAPS = "prefix string, message string, templates array<string>, template_prefixes array<string>, template_suffixes array<string>, methods array<string>"
FACTS = "channel string, method string, anchor string, dynamic boolean, path string, line int, column int, id string, service string, catch_all_prefix boolean, constraints array<struct<segment:int,kind:string,pattern:string>>"


def by_part(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r.part, r.place)):
        out.setdefault(r.part, []).append(r.json if r.part == "limitations" else json.loads(r.json))
    return out


def test_fact_documents(spark):
    rows = spark.createDataFrame(
        [
            ("/b", "GET", "root", False, "a.py", 2, 1, "a.py#f", None, True, [(1, "int", None)]),
            ("/b", "GET", "root", False, "a.py", 2, 1, "a.py#f", None, True, [(1, "int", None)]),
            (None, "ANY", "base", True, "a.py", 9, 1, None, "other", True, [(1, "int", None)]),
            ("/b", "GET", "root", False, "a.py", 10, 1, "a.py#g", None, None, []),
        ],
        FACTS,
    )
    gaps = spark.createDataFrame([("x", "{count} of", None, None, None, None), ("x", "{count} of", ["bad"], None, None, None), ("x", "{count} of", ["/ok"], None, None, None), ("x", "{count} of", ["/ok"], None, None, None)], GAPS)
    when = F.lit("2024-01-02 03:04:05").cast("timestamp")
    got = by_part(documents.fact_lines("server", rows, gaps, "p", when, service="main", tests=True))
    assert got["header"] == [{"format": "bridge-facts", "version": 1, "tool": {"name": "tracewell"}, "platform": "python", "target": "http", "roles": ["server"], "sourceSets": {"tests": "included"}, "project": "p", "generatedAt": "2024-01-02T03:04:05.000Z"}]
    assert [(f.get("channel"), f["location"]["line"], f["service"]) for f in got["facts"]] == [(None, 9, "other"), ("/b", 2, "main"), ("/b", 10, "main")]
    assert got["facts"][1]["paramConstraints"] == [{"segment": 1, "kind": "int"}] and got["facts"][1]["catchAllPrefix"] is True
    assert "paramConstraints" not in got["facts"][0] and "catchAllPrefix" not in got["facts"][0] and "symbol" not in got["facts"][0]
    assert got["limitations"] == ["x: 1 of", "x: 2 of"] and got["scopes"] == [{"limitationIndex": 0, "templates": ["/ok"]}]
    calls = by_part(documents.fact_lines("client", rows.drop("service", "constraints", "catch_all_prefix").where("channel IS NOT NULL"), gaps.limit(0), "p", when, service="main"))
    assert calls["header"][0]["service"] == "main" and calls.keys() == {"header", "facts"} and calls["facts"][0]["kind"] == "route-call"
    empty = by_part(documents.fact_lines("persistence", rows.limit(0), gaps.limit(0), "p", when))
    assert empty.keys() == {"header"} and empty["header"][0]["target"] == "sql"


def test_too_many_scopes_only_count(spark, monkeypatch):
    monkeypatch.setattr(facts, "MOST_SCOPES", 2)
    gaps = spark.createDataFrame([("x", "{count} of", [f"/{i}"], None, None, None) for i in range(3)] + [("x", "{count} of", None, None, None, None)], GAPS)
    assert [(r.limitation_index, r.sentence, r.templates) for r in facts.limitations(gaps).collect()] == [(0, "x: 4 of", None)]


def test_traversal_documents(spark):
    nodes = spark.createDataFrame([(x, "function", "a.py", i, 1) for i, x in enumerate("abcd")], "id string, kind string, path string, line int, column int")
    raw = spark.createDataFrame([("a", "b", "call", "direct"), ("b", "c", "call", "direct"), ("b", "c", "new", "direct")], "source string, target string, kind string, evidence string")
    roots = spark.createDataFrame([(0, "gone"), (1, "a")], "root_idx int, id string")
    calls = spark.createDataFrame([("a", 3, 2, 1), ("b", 0, 0, 0), ("c", traversal.MOST_UNRESOLVED + 5, 0, 0)], "node string, mode_direct long, mode_bound long, mode_candidates long")
    found = traversal.traverse(nodes.select("id"), edges.merge_edges(raw, nodes.select("id")), roots)
    got = by_part(documents.traversal_lines(found, roots, nodes, calls))
    assert got["header"] == [{"format": "language-traversal", "version": 1, "platform": "python", "dispatch": "direct", "direction": "dependencies", "truncated": True, "truncationReasons": ["root-not-found"]}]
    assert got["roots"] == [{"id": "gone"}, {"id": "a", "symbol": {"usr": "a", "qualifiedName": "a"}, "unresolvedCalls": 3}]
    assert [(r["symbol"]["usr"], r["depth"], r["via"], r["relationships"], r.get("unresolvedCalls")) for r in got["reached"]] == [("b", 1, "a", ["call"], None), ("c", 2, "b", ["call", "new"], traversal.MOST_UNRESOLVED)]
    assert [x.split(":")[0] for x in got["limitations"]] == ["root-not-found", "unresolved-calls-capped"]


def test_the_change_report(spark, small):
    rows = Q.change_report(spark, small).collect()
    parts = {}
    for r in rows:
        parts.setdefault((r.side, r.part), []).append(json.loads(r.json))
    before, after = ({r.path: r.identity for r in s.collect()} for s in Q.snapshots(spark, small))
    head = parts["both", "header"][0]
    assert head["status"] == "incomplete" and head["added"] == len(after.keys() - before.keys()) and head["deleted"] == len(before.keys() - after.keys())
    assert head["modified"] == sum(before[p] != after[p] for p in before.keys() & after.keys()) == sum(f["status"] == "modified" for f in parts["both", "files"])
    for side in ("before", "after"):
        nodes, _ = Q._sides(spark, small)[side]
        declared = {r.path for r in nodes.collect()}
        there = {f["path"] for f in parts["both", "files"] if f["status"] != ("added" if side == "before" else "deleted")}
        assert {f["path"] for f in parts[side, "unmapped"]} == there - declared
        assert len(parts[side, "reached"]) == Q.change_impact(spark, small).where(F.col("side") == side).count() and len(parts[side, "bounds"]) == 1


def test_expansions_match_what_their_pattern_matches(spark):
    """Every text over a small alphabet matches a pattern where it matches one of those that it is written out to."""
    cases = [r"^(?:a|b)c?$", r"^(a|\d+)/b$", r"^a{2}[bc]$", r"^(?:ab)?c/?$", r"^(?:a|)b\.$", r"^[ab][bc]c?$", r"^(?P<x>a|b|c)(?:c)?$"]
    texts = ["".join(t) for n in range(5) for t in itertools.product("abc1/.", repeat=n)]
    for pattern, out in zip(cases, values(spark, patterns.expansions(F.col("a")), *cases), strict=True):
        assert len(out) > 1 or "{2}" in pattern
        for text in texts:
            assert bool(re.search(pattern, text)) == any(re.search(o, text) for o in out), (pattern, text)


def test_formats(spark):
    texts = ["".join(t) for n in range(1, 5) for t in itertools.product(["{", "}", "x", "!r", ":", "0"], repeat=n)]
    for text, got in zip(texts, values(spark, formats.format_pieces(F.col("a")), *texts), strict=True):
        try:
            parsed = list(string.Formatter().parse(text))
        except ValueError:
            assert got is None, text
            continue
        if got is None:  # what Python reads in a way of its own is told as unknown
            assert any(name is not None and (re.search(r"[{}]", name + (spec or "")) or conversion == "}") for _, name, spec, conversion in parsed), text
            continue
        want, n = [], 0
        for literal, name, spec, conversion in parsed:
            want.append(literal)
            if name is not None:
                key = str(n) if name == "" else str(int(name)) if name.isdigit() else name
                n += name == ""
                want.append((key, not spec and conversion in (None, "s")))
        flat = lambda xs: [("".join(g) if k is str else list(g)) for k, g in itertools.groupby([x for x in xs if x != ""], key=type)]
        assert flat([p.text if p.key is None else (p.key, p.plain) for p in got]) == flat(want), text
    for text, keyed, args in ((("%s-%d%%"), False, ("a", 1)), ("%(k)s/%(n)02d", True, {"k": "x", "n": 3})):
        whole = values(spark, formats.percent_pieces(F.col("a"), keyed), text)[0]
        given = args if keyed else {str(i): a for i, a in enumerate(args)}
        assert "".join(p.text if p.key is None else str(given[p.key]) if p.plain else text and (f"%{'02' if keyed else ''}d" % given[p.key]) for p in whole) == text % args


@pytest.mark.parametrize("runtime", ["3.8.0", "3.12.1"])
def test_requirements(spark, runtime):
    """Against lists of versions: a version under all lower bounds' least is below; clauses that leave out this one aren't told."""
    clauses = [">=3.8", ">3.8", "<3.12", "<=3.8.0", "==3.8", "!=3.8", "!=3.8.*", "==3.12.*", "~=3.8.1", "~=3.9", ">=4"]
    texts = [",".join(t) for n in (1, 2) for t in itertools.product(clauses, repeat=n)]
    versions = [(3, a, b) for a in range(20) for b in range(4)] + [(4, 0, 0), (4, 1, 0)]

    def fits(v, c):
        op, text = re.match(r"(~=|[=!<>]=|[<>])(.*)", c).groups()
        wild, own = text.endswith(".*"), tuple(int(x) for x in text.removesuffix(".*").split("."))
        full = (own + (0, 0, 0))[:3]
        if op == "~=":
            return v >= full and v[: len(own) - 1] == own[:-1]
        if op in ("==", "!="):
            return ((v[: len(own)] == own) if wild else v == full) == (op == "==")
        return {">=": v >= full, ">": v > full, "<": v < full, "<=": v <= full}[op]

    now = tuple(int(x) for x in runtime.split("."))
    for text, got in zip(texts, values(spark, requirements.requirement_status(F.col("a"), F.lit(runtime)), *texts), strict=True):
        parts = [c for c in text.split(",") if not c.startswith("!")]
        low = [c for c in parts if c[0] in ">=~"]
        meets = [v for v in versions if all(fits(v, c) for c in parts)]
        if not low or not meets:
            assert got == "not-evaluated", text
        elif now < min(v for v in versions if all(fits(v, c) or any(fits(u, c) for u in versions if u < v) for c in low)):
            assert got == "runtime-below-minimum", text
        else:
            assert got == ("minimum-not-newer" if all(fits(now, c) for c in text.split(",") if c.startswith("!")) else "not-evaluated"), text


def test_paths(spark):
    good, bad = ["a", "a/b.py", "console", "a.b/c", "nul1"], ["", "/a", "a/", "a//b", "..", "a/../b", ".git/x", "a/.Git", "a\\b", "c:", "a\nb", "a. ", "a.", "NUL", "com1.txt", "x/aux/y", None]
    assert values(spark, change.is_safe_path(F.col("a")), *good, *bad) == [True] * len(good) + [False] * len(bad)


def test_client_agreement(spark):
    rows = spark.createDataFrame(
        [("a", "httpx", "httpx-base-url", "/x", True), ("a", "httpx", "httpx-base-url", "/x", True), ("b", "httpx", "httpx-base-url", "/x", True), ("b", "httpx", "httpx-base-url", None, False), ("c", "requests", "rfc3986", "/x", True), ("c", "requests", "no-base", None, True), ("d", "requests", "no-base", None, True), ("d", "httpx", "no-base", None, True), ("e", "aiohttp", "aiohttp-base-url", None, False)],
        "name string, library string, style string, base string, base_known boolean",
    )
    got = {r.name: (r.library, r.style, r.base, r.base_known) for r in facts.client_agreement(rows).collect()}
    assert got == {"a": ("httpx", "httpx-base-url", "/x", True), "b": ("httpx", "httpx-base-url", None, False), "c": ("requests", "no-base", None, False), "e": ("aiohttp", "aiohttp-base-url", None, False)}
