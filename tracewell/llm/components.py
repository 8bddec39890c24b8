"""Connected components of links between documents, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import storage

from . import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its smallest node.

    Each round joins a node's neighbours to the smallest of them, first the larger ones (so chains shorten), then the
    smaller ones, and is written to the shared folder; it ends when nothing changes. Minimums are pre-aggregated and no
    group of neighbours is gathered, so a hub is only rows.
    """
    oriented = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = common.materialize(oriented, "links"), None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.materialize(small.union(low.select("u", "m")).distinct(), "links")
        storage.drop(edges)
        edges = after
    raise RuntimeError("links did not settle")
