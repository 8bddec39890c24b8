"""Queries over the entity graph, each with the same answer in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import change, edges, traversal
from tracewell.operators.ranking import numbered
from tracewell.sources import documents
from tracewell.sources import entity_graph as G

MERGED_SQL = f"""nodes AS ({G.NODES_SQL}), raw AS ({G.RAW_EDGES_SQL}),
  sets AS (SELECT source, target,
      coalesce(list_sort(list(DISTINCT kind) FILTER (evidence = 'direct')), []) AS d, coalesce(list_sort(list(DISTINCT kind) FILTER (evidence = 'bound')), []) AS b, coalesce(list_sort(list(DISTINCT kind) FILTER (evidence = 'candidate')), []) AS c
    FROM raw WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY source, target),
  kept AS (SELECT *, len(list_filter(b, lambda x: NOT list_contains(d, x))) > 0 AS kb FROM sets),
  merged AS (
    SELECT source, target, d AS kinds, 'direct' AS evidence, 0 AS tier FROM kept WHERE len(d) > 0
    UNION ALL SELECT source, target, b, 'bound', 1 FROM kept WHERE kb
    UNION ALL SELECT source, target, c, 'candidate', 2 FROM kept WHERE len(list_filter(c, lambda x: NOT list_contains(CASE WHEN kb THEN list_concat(d, b) ELSE d END, x))) > 0)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = G.nodes(spark, sf_dir)
    return nodes, edges.merge_edges(G.raw_edges(spark, sf_dir), nodes, G.KINDS)


def _near(spark: SparkSession, sf_dir: str, direction: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """The graph's nodes, and its adjacency; edges of weaker tiers than the mode follows go first."""
    nodes, raw = G.nodes(spark, sf_dir), G.raw_edges(spark, sf_dir).where(edges.tier(F.col("evidence")) <= edges.MODES[mode])
    return nodes, edges.pair_adjacency(edges.pair_edges(raw, nodes, G.KINDS), G.KINDS, direction, edges.MODES[mode])


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1].select("source", "target", F.array_join("kinds", ",").alias("kinds"), "evidence")


MERGE_SQL = f"WITH {MERGED_SQL} SELECT source, target, array_to_string(kinds, ',') AS kinds, evidence FROM merged"


def stats(part: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, merged = graph(spark, sf_dir)
        return edges.statistics(nodes, merged).where(F.col("part") == part).select("name", "n")

    return run


STATS_SQL = {
    "nodes": f"WITH nodes AS ({G.NODES_SQL}) SELECT kind AS name, count(*) AS n FROM nodes GROUP BY kind",
    "edges": f"WITH {MERGED_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(kinds) AS name FROM merged) GROUP BY name",
    "evidence": f"WITH {MERGED_SQL} SELECT evidence AS name, count(*) AS n FROM merged GROUP BY evidence",
}


def adjacency(direction: str, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = _near(spark, sf_dir, direction, mode)[1]
        return near.select("src", "dst", F.array_join("kinds", ",").alias("kinds"))

    return run


def adjacency_sql(direction: str, mode: str) -> str:
    src, dst = ("source", "target") if direction == "dependencies" else ("target", "source")
    return f"WITH {MERGED_SQL}, e AS (SELECT {src} AS src, {dst} AS dst, unnest(kinds) AS k FROM merged WHERE tier <= {edges.MODES[mode]}) SELECT src, dst, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds FROM e GROUP BY src, dst"


# name: direction, dispatch, root ids in SQL that both engines read, max_depth, max_reached
TRAVERSALS = {
    "reach_single_root": ("dependencies", "direct", "SELECT 0 AS root_idx, 'orders#1' AS id", 128, 100_000),
    "impact_single_root": ("dependents", "candidates", "SELECT 0 AS root_idx, 'supplier#1' AS id", 128, 100_000),
    "reach_multi_root": ("dependencies", "candidates", "SELECT CAST(o_orderkey - 1 AS INT) AS root_idx, concat('orders#', o_orderkey) AS id FROM orders WHERE o_orderkey BETWEEN 1 AND 40", 128, 100_000),
    "reach_direct_mode": ("dependencies", "direct", "SELECT CAST(o_orderkey - 1 AS INT) AS root_idx, concat('orders#', o_orderkey) AS id FROM orders WHERE o_orderkey BETWEEN 1 AND 60", 128, 100_000),
    "reach_bound_mode": ("dependencies", "bound", "SELECT CAST(o_orderkey - 1 AS INT) AS root_idx, concat('orders#', o_orderkey) AS id FROM orders WHERE o_orderkey BETWEEN 1 AND 60", 128, 100_000),
    "reach_candidates_mode": ("dependencies", "candidates", "SELECT CAST(p_partkey - 1 AS INT) AS root_idx, concat('part#', p_partkey) AS id FROM part WHERE p_partkey BETWEEN 1 AND 50", 128, 100_000),
    "reach_depth_limited": ("dependents", "candidates", "SELECT CAST(n_nationkey AS INT) AS root_idx, concat('nation#', n_nationkey) AS id FROM nation WHERE n_nationkey < 5", 2, 100_000),
    "reach_top_n": ("dependents", "candidates", "SELECT CAST(r_regionkey AS INT) AS root_idx, concat('region#', r_regionkey) AS id FROM region", 128, 100),
    "reach_missing_roots": ("dependencies", "bound", "SELECT CAST(n_nationkey AS INT) AS root_idx, concat(CASE WHEN n_nationkey % 2 = 0 THEN 'nation#' ELSE 'nowhere#' END, n_nationkey) AS id FROM nation", 128, 100_000),
    "reach_roots_capped64": ("dependencies", "candidates", "SELECT CAST(p_partkey - 1 AS INT) AS root_idx, concat('part#', p_partkey) AS id FROM part WHERE p_partkey BETWEEN 1 AND 150", 128, 100_000),
    "change_impact_reverse": ("dependents", "bound", "SELECT CAST(p_partkey - 1 AS INT) AS root_idx, concat('part#', p_partkey) AS id FROM part WHERE p_partkey BETWEEN 1 AND 20", 1, 100_000),
}


def _traversed(name: str, spark: SparkSession, sf_dir: str) -> traversal.Reached:
    direction, dispatch, roots, depth, most = TRAVERSALS[name]
    for t in ("orders", "part", "nation", "region"):
        G.table(spark, sf_dir, t).createOrReplaceTempView(t)
    nodes, near = _near(spark, sf_dir, direction, dispatch)
    return traversal.traverse_near(nodes, near, spark.sql(roots), dispatch, depth, most)


def reach(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _traversed(name, spark, sf_dir).rows
        return rows.select("id", "via", "depth", F.array_join(F.transform("roots", lambda r: r.cast("string")), ",").alias("roots"), F.array_join("relationships", ",").alias("relationships"), "evidence")

    return run


def flags(name: str):
    return lambda spark, sf_dir: _traversed(name, spark, sf_dir).meta


def _traversal_ctes(name: str) -> str:
    direction, dispatch, roots, depth, most = TRAVERSALS[name]
    src, dst = ("source", "target") if direction == "dependencies" else ("target", "source")
    weakest = edges.MODES[dispatch]
    walks = []
    for t in range(weakest + 1):
        walks.append(f"""
  e{t} AS MATERIALIZED (SELECT DISTINCT {src} AS src, {dst} AS dst FROM merged WHERE tier <= {t}),
  w{t} AS (SELECT root_idx, id AS node, 0 AS depth FROM roots UNION SELECT w.root_idx, e.dst, w.depth + 1 FROM w{t} w JOIN e{t} e ON e.src = w.node WHERE w.depth < {depth}),
  l{t} AS MATERIALIZED (SELECT root_idx, node, min(depth) AS depth FROM w{t} GROUP BY root_idx, node)""")
    counts = "".join(f", (SELECT count(*) FROM l{t} WHERE l{t}.node = s.node) AS n{t}" for t in range(weakest + 1))
    evidence = "CASE " + " ".join(f"WHEN n{t} = n{weakest} THEN '{edges.TIERS[t]}'" for t in range(weakest + 1)) + " END"
    return f"""WITH RECURSIVE {MERGED_SQL}, asked AS ({roots}), roots AS (SELECT * FROM asked WHERE id IN (SELECT id FROM nodes)),{','.join(walks)},
  kinds AS (SELECT src, dst, string_agg(DISTINCT k, ',' ORDER BY k) AS k FROM (SELECT {src} AS src, {dst} AS dst, unnest(kinds) AS k FROM merged WHERE tier <= {weakest}) GROUP BY src, dst),
  pairs AS (SELECT l.* FROM l{weakest} l WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE r.root_idx = l.root_idx AND r.id = l.node)),
  best AS (SELECT node, min(depth) AS depth FROM pairs GROUP BY node),
  near AS (SELECT b.node, b.depth, (SELECT min(root_idx) FROM pairs p WHERE p.node = b.node AND p.depth = b.depth) AS nearest FROM best b),
  s AS (SELECT n.node, n.depth, n.nearest, (SELECT min(l.node) FROM l{weakest} l JOIN e{weakest} e ON e.src = l.node WHERE e.dst = n.node AND l.root_idx = n.nearest AND l.depth = n.depth - 1) AS via FROM near n),
  ranked AS (SELECT node, root_idx, row_number() OVER (PARTITION BY node ORDER BY root_idx) AS r FROM pairs),
  listed AS (SELECT node, string_agg(CAST(root_idx AS VARCHAR), ',' ORDER BY root_idx) FILTER (r <= {traversal.KEPT_ROOTS}) AS roots, max(r) AS n FROM ranked GROUP BY node),
  told AS (SELECT s.node AS id, s.via, s.depth, listed.roots, kinds.k AS relationships, {evidence} AS evidence, listed.n AS n
    FROM (SELECT s.*{counts} FROM s) s JOIN listed USING (node) LEFT JOIN kinds ON kinds.src = s.via AND kinds.dst = s.node)"""


def reach_sql(name: str) -> str:
    return f"{_traversal_ctes(name)} SELECT id, via, depth, roots, relationships, evidence FROM told ORDER BY depth, id LIMIT {TRAVERSALS[name][4]}"


def flags_sql(name: str) -> str:
    _, dispatch, _, depth, most = TRAVERSALS[name]
    t = edges.MODES[dispatch]
    return f"""{_traversal_ctes(name)}, f AS (SELECT
    EXISTS (SELECT 1 FROM l{t} l JOIN e{t} e ON e.src = l.node WHERE l.depth = {depth} AND NOT EXISTS (SELECT 1 FROM l{t} m WHERE m.root_idx = l.root_idx AND m.node = e.dst)) AS d,
    (SELECT count(*) FROM told) > {most} AS m, EXISTS (SELECT 1 FROM asked WHERE id NOT IN (SELECT id FROM nodes)) AS r)
    SELECT d OR m OR r AS truncated, concat_ws(',', CASE WHEN d THEN 'depth' END, CASE WHEN m THEN 'max-reached' END, CASE WHEN r THEN 'root-not-found' END) AS reasons,
      coalesce((SELECT max(n) FROM told), 0) > {traversal.KEPT_ROOTS} AS roots_truncated, least((SELECT count(*) FROM told), {most}) AS n_reached FROM f"""


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.unresolved_by_mode(G.call_outcomes(spark, sf_dir))


UNRESOLVED_SQL = f"""WITH o AS ({G.OUTCOMES_SQL}) SELECT node, count(*) FILTER (status IN ('unresolved', 'partial')) AS mode_direct,
  count(*) FILTER (status IN ('unresolved', 'partial') AND NOT linked) AS mode_bound, count(*) FILTER (status = 'unresolved' AND NOT linked) AS mode_candidates FROM o GROUP BY node"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.reason_histogram(G.call_outcomes(spark, sf_dir))


REASONS_SQL = f"WITH o AS ({G.OUTCOMES_SQL}), c AS (SELECT node, reason, count(*) AS n FROM o WHERE status IN ('unresolved', 'partial') GROUP BY node, reason) SELECT node, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM c GROUP BY node"


def call_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by status, by reason, and of the open ones those that are linked and aren't."""
    outcomes = G.call_outcomes(spark, sf_dir)
    return edges.call_statistics(outcomes, outcomes.where("status = 'unresolved'").select("reason", "linked"))


CALLS_SQL = f"""WITH o AS ({G.OUTCOMES_SQL}) SELECT 'call_sites' AS part, status AS name, count(*) AS n FROM o GROUP BY status UNION ALL SELECT status || '_calls', reason, count(*) FROM o WHERE status IN ('unresolved', 'partial') GROUP BY status, reason
  UNION ALL SELECT CASE WHEN linked THEN 'bound_linked' ELSE 'bound_open' END AS p, reason, count(*) FROM o WHERE status = 'unresolved' GROUP BY p, reason"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents as files: in the second some are edited, gone, moved or copied."""
    docs = G.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))
    path = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".txt").otherwise(".py"))
    before = docs.select(path("src/f").alias("path"), F.col("h").alias("identity"))
    moved = F.when(F.col("doc_id") % 7 == 3, path("lib/g")).otherwise(path("src/f"))
    after = docs.where(F.col("doc_id") % 11 != 5).select(moved.alias("path"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("edited"), F.col("h"))).otherwise(F.col("h")).alias("identity"))
    return before, after


SNAPSHOTS_SQL = """docs AS (SELECT doc_id, md5(coalesce(text, '')) AS h, CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.py' END AS x FROM documents),
  b AS (SELECT 'src/f' || doc_id || x AS path, h AS identity FROM docs),
  a AS (SELECT CASE WHEN doc_id % 7 = 3 THEN 'lib/g' ELSE 'src/f' END || doc_id || x AS path, CASE WHEN doc_id % 5 = 0 THEN 'edited' || h ELSE h END AS identity FROM docs WHERE doc_id % 11 <> 5),
  c AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS status, b.identity AS was, a.identity AS now
    FROM b FULL JOIN a ON a.path = b.path WHERE a.identity IS DISTINCT FROM b.identity),
  g AS (SELECT was, min(path) AS gone FROM c WHERE status = 'deleted' GROUP BY was HAVING count(*) = 1)"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.changed_files(*snapshots(spark, sf_dir)).select("path", "status")


def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.changed_files(*snapshots(spark, sf_dir)).where("rename_from IS NOT NULL").select("path", "rename_from")


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration for each analysed file of the first state."""
    before, _ = snapshots(spark, sf_dir)
    return before.where(change.is_analyzed(F.col("path"))).select(F.concat(F.col("path"), F.lit("#main")).alias("id"), "path")


def change_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.seeds(_declared(spark, sf_dir), change.changed_files(*snapshots(spark, sf_dir)), "before")


def change_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.unmapped(_declared(spark, sf_dir), change.changed_files(*snapshots(spark, sf_dir)), "before")


def _sides(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(nodes, merged edges) of each state: a declaration for each analysed file, which uses those of smaller numbers, and tests of some."""
    out = {}
    for side, files in zip(("before", "after"), snapshots(spark, sf_dir), strict=True):
        own = files.where(change.is_analyzed(F.col("path"))).select(F.concat("path", F.lit("#main")).alias("id"), "path", F.regexp_extract("path", r"(\d+)\.py$", 1).cast("long").alias("n"))
        tests = own.where("n % 6 = 1").select(F.format_string("tests/test_f%d.py#main", "n").alias("id"), F.format_string("tests/test_f%d.py", "n").alias("path"), F.col("id").alias("target"))
        uses = lambda k, kind, tier: own.where(f"n > 0 AND n % {k} <> 0").select(F.col("id").alias("source"), F.expr(f"n DIV {k}").alias("n"), F.lit(kind).alias("kind"), F.lit(tier).alias("evidence")).join(own.select("n", F.col("id").alias("target")), "n").select("source", "target", "kind", "evidence")  # noqa: E731,B023
        raw = uses(3, "call", "direct").unionByName(uses(5, "new", "bound")).unionByName(tests.select(F.col("id").alias("source"), "target", F.lit("call").alias("kind"), F.lit("direct").alias("evidence")))
        nodes = own.select("id", "path").unionByName(tests.select("id", "path"))
        out[side] = nodes, edges.merge_edges(raw, nodes)
    return out


def _impacts(spark: SparkSession, sf_dir: str) -> dict[str, traversal.Reached]:
    changes = change.changed_files(*snapshots(spark, sf_dir))
    return {side: change.impact(nodes, merged, changes, side, "bound") for side, (nodes, merged) in _sides(spark, sf_dir).items()}


def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on all changed declarations of both states, at any depth."""
    found = _impacts(spark, sf_dir)
    return found["before"].rows.withColumn("side", F.lit("before")).unionByName(found["after"].rows.withColumn("side", F.lit("after")))


def change_impact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _impacts(spark, sf_dir)
    return found["before"].meta.withColumn("side", F.lit("before")).unionByName(found["after"].meta.withColumn("side", F.lit("after")))


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the change between both states."""
    states = snapshots(spark, sf_dir)
    changes = change.changed_files(*states)
    empty = {side: change.unmapped(nodes, changes, side) for side, (nodes, _) in _sides(spark, sf_dir).items()}
    return documents.change_lines(*states, _impacts(spark, sf_dir), empty)


def traversal_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on every nation, as a document; the entities' tables stand for files."""
    nodes, near = _near(spark, sf_dir, "dependents", "candidates")
    ids = G.table(spark, sf_dir, "nation").select(F.concat(F.lit("nation#"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("pos"))
    roots = traversal.number_roots(ids)
    found = traversal.traverse_near(nodes, near, roots, "candidates")
    placed = nodes.select("id", "kind", F.substring_index("id", "#", 1).alias("path"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    return documents.traversal_lines(found, roots, placed, edges.unresolved_by_mode(G.call_outcomes(spark, sf_dir)), "dependents", "candidates")


def reach_all_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all orders reach, at any depth: every order is a root, and all that is reached is told. Of a node's roots the first are listed, all are counted."""
    nodes, near = _near(spark, sf_dir, "dependencies", "candidates")
    ids = G.table(spark, sf_dir, "orders").select(F.concat(F.lit("orders#"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("pos"))
    roots = numbered(ids.groupBy("id").agg(F.min("pos").alias("pos")), "pos", name="root_idx").select(F.col("root_idx").cast("int"), "id")
    rows = traversal.traverse_near(nodes, near, roots, "candidates", max_depth=None, max_reached=None).rows
    return rows.select("id", "via", "depth", F.array_join(F.transform("roots", lambda r: r.cast("string")), ",").alias("roots"), F.array_join("relationships", ",").alias("relationships"), "evidence", "n_roots")


def identity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = G.table(spark, sf_dir, "documents")
    return docs.select("doc_id", change.git_blob_id(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "sha256").alias("blob_id"))


QUERIES = {
    "graph_merge_edges": merge,
    "graph_stats_by_kind": stats("nodes"),
    "graph_stats_edges_by_kind": stats("edges"),
    "graph_stats_by_evidence": stats("evidence"),
    "adjacency_forward": adjacency("dependencies", "candidates"),
    "adjacency_reverse": adjacency("dependents", "bound"),
    **{name: reach(name) for name in TRAVERSALS},
    "reach_truncation_flags": flags("reach_top_n"),
    "reach_truncation_depth": flags("reach_depth_limited"),
    "reach_truncation_roots": flags("reach_missing_roots"),
    "unresolved_by_mode": unresolved,
    "unresolved_by_reason": reasons,
    "call_statistics": call_statistics,
    "snapshot_diff": snapshot_diff,
    "rename_candidates": rename_candidates,
    "change_seeds": change_seeds,
    "change_unmapped": change_unmapped,
    "identity_digest": identity_digest,
}
# beyond what SQL does in time; tests hold them against brute force
WHOLE = {"change_impact": change_impact, "change_impact_flags": change_impact_flags, "change_report": change_report, "traversal_document": traversal_document, "reach_all_orders": reach_all_orders}
ORACLES = {
    "graph_merge_edges": MERGE_SQL,
    "graph_stats_by_kind": STATS_SQL["nodes"],
    "graph_stats_edges_by_kind": STATS_SQL["edges"],
    "graph_stats_by_evidence": STATS_SQL["evidence"],
    "adjacency_forward": adjacency_sql("dependencies", "candidates"),
    "adjacency_reverse": adjacency_sql("dependents", "bound"),
    **{name: reach_sql(name) for name in TRAVERSALS},
    "reach_truncation_flags": flags_sql("reach_top_n"),
    "reach_truncation_depth": flags_sql("reach_depth_limited"),
    "reach_truncation_roots": flags_sql("reach_missing_roots"),
    "unresolved_by_mode": UNRESOLVED_SQL,
    "unresolved_by_reason": REASONS_SQL,
    "call_statistics": CALLS_SQL,
    "snapshot_diff": f"WITH {SNAPSHOTS_SQL} SELECT path, status FROM c",
    "rename_candidates": f"WITH {SNAPSHOTS_SQL} SELECT c.path, g.gone AS rename_from FROM c JOIN g ON g.was = c.now WHERE c.status = 'added'",
    "change_seeds": f"WITH {SNAPSHOTS_SQL} SELECT c.path || '#main' AS id, c.path FROM c WHERE c.status <> 'added' AND c.path LIKE '%.py' ORDER BY id LIMIT {change.MOST_SEEDS}",
    "change_unmapped": f"WITH {SNAPSHOTS_SQL} SELECT path, status FROM c WHERE status <> 'added' AND path NOT LIKE '%.py'",
    "identity_digest": "SELECT doc_id, sha256(encode('blob ' || octet_length(encode(coalesce(text, ''))) || chr(0) || coalesce(text, ''))) AS blob_id FROM documents",
}
