"""Comparing two snapshots of files, and what the changes can affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.traversal import Reached, number_roots, traverse

MOST_SEEDS = 10_000  # fixed value
ANALYZED = r"(\.py$)|((^|/)(pyproject\.toml|setup\.cfg|pyvenv\.cfg)$)"  # fixed values: names of analysed files
TEST = r"((^|/)(test_[^/]*\.py|[^/]*_test\.py|tests\.py|conftest\.py)$)|((^|/)tests?/)"  # fixed values: names of tests


def is_analyzed(path: Column) -> Column:
    return path.rlike(ANALYZED)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST)


# fixed values: names that some systems keep for devices
DEVICE = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"


def is_safe_path(path: Column) -> Column:
    """False for paths that lead out of their folder, into git's own, or that other systems read in another way."""
    unsafe = lambda p: p.isin("", ".", "..") | (F.lower(p) == ".git") | p.rlike(r"[. ]$") | p.rlike(DEVICE)
    return F.coalesce((path != "") & ~path.rlike(r"[\\:\x00-\x1F\x7F]") & ~F.exists(F.split(path, "/", -1), unsafe), F.lit(False))


def git_blob_id(content: Column, algorithm: str = "sha1") -> Column:
    """The object id that git gives a file's bytes."""
    whole = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content)
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, rename_from) of paths whose identity differs; a rename candidate is the one deleted path of the same identity."""
    both = before.select("path", F.col("identity").alias("was")).join(after.select("path", F.col("identity").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    changes = both.where(~F.col("was").eqNullSafe(F.col("now"))).withColumn("status", status)
    # one row for each identity: many files of one content are counted, not gathered
    gone = changes.where("status = 'deleted'").groupBy(F.col("was").alias("now")).agg(F.count("*").alias("n"), F.min("path").alias("_from")).where("n = 1")
    return changes.join(gone.select("now", "_from"), "now", "left").select("path", "status", F.when(F.col("status") == "added", F.col("_from")).alias("rename_from"))


def selected(nodes: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """(id, path) of declarations in changed files; files that are only on the other side have none. ``nodes``: (id, path)."""
    there = changes.where(F.col("status") != ("added" if side == "before" else "deleted"))
    return nodes.join(there.select("path"), "path", "left_semi").select("id", "path")


def seeds(nodes: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """The first MOST_SEEDS of ``selected`` by id; ``seed_counts`` tells whether there are more."""
    return selected(nodes, changes, side).orderBy("id").limit(MOST_SEEDS)


def seed_counts(nodes: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """(n_selected, n_seeds, seeds_truncated): one row."""
    n = F.count("*")
    return selected(nodes, changes, side).agg(n.alias("n_selected"), F.least(n, F.lit(MOST_SEEDS)).alias("n_seeds"), (n > MOST_SEEDS).alias("seeds_truncated"))


def unmapped(nodes: DataFrame, changes: DataFrame, side: str) -> DataFrame:
    """Changed paths of a side that hold no declaration."""
    there = changes.where(F.col("status") != ("added" if side == "before" else "deleted"))
    return there.join(nodes.select("path").distinct(), "path", "left_anti").select("path", "status")


def impact(nodes: DataFrame, edges: DataFrame, changes: DataFrame, side: str, dispatch: str = "direct", max_depth: int = 128, max_reached: int = 100_000) -> Reached:
    """What depends on the seeds of one side. Sides have graphs of their own.

    Rows: id, via, depth, evidence, path, test_candidate. Meta: one row of what was cut short, seeds too.
    """
    found = seeds(nodes, changes, side)
    roots = number_roots(found.withColumn("pos", F.row_number().over(Window.orderBy("id"))))  # MOST_SEEDS rows at most
    reached = traverse(nodes.select("id"), edges, roots, "dependents", dispatch, max_depth, max_reached)
    rows = reached.rows.join(nodes.select("id", "path"), "id").select("id", "via", "depth", "evidence", "path", is_test_path(F.col("path")).alias("test_candidate"))
    return Reached(rows, reached.meta.crossJoin(seed_counts(nodes, changes, side)))


def content_digest(files: DataFrame) -> DataFrame:
    """(digest): SHA-256 over paths, sizes and content hashes in order of path. Hashes of ranges are combined, so no task sees all contents."""
    rows = files.select("path", F.concat_ws(":", F.sha2(F.encode("path", "UTF-8"), 256), F.octet_length("content").cast("string"), F.sha2("content", 256)).alias("h"))
    parts = rows.groupBy(F.substring(F.sha2(F.encode("path", "UTF-8"), 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))
