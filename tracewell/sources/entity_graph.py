"""A dependency graph over the star-schema tables: nodes are rows with a key, edges are references between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """``rows`` in as many partitions as keep each below about ``most``: a small file of many rows is else read by one task, whatever is done with each row."""
    return rows.repartition(1 + rows.count() // most)


def _id(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}#"), F.col(column).cast("string"))


KINDS = ("attribute", "call", "callback", "decorator", "dispatch", "framework", "inherit", "new", "reference")  # all that raw_edges gives
KEYS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind)."""
    parts = [table(spark, sf_dir, t).select(_id(t, k).alias("id"), F.lit(t).alias("kind")) for t, k in KEYS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, evidence); a pair may come many times."""
    read = lambda t: table(spark, sf_dir, t)
    line = read("lineitem")
    evidence = F.when(F.col("l_discount") < 0.03, "direct").when(F.col("l_discount") < 0.07, "bound").otherwise("candidate")
    returned = F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "new").otherwise("callback")
    status = F.when(F.col("l_linestatus") == "F", "decorator").otherwise("framework")
    order, part, supplier = _id("orders", "l_orderkey"), _id("part", "l_partkey"), _id("supplier", "l_suppkey")
    rows = [
        read("orders").select(_id("orders", "o_orderkey"), _id("customer", "o_custkey"), F.lit("reference"), F.lit("direct")),
        read("customer").select(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.lit("attribute"), F.lit("direct")),
        read("supplier").select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), F.lit("attribute"), F.lit("direct")),
        read("nation").select(_id("nation", "n_nationkey"), _id("region", "n_regionkey"), F.lit("inherit"), F.lit("direct")),
        line.select(order, part, returned, evidence),
        line.select(order, supplier, status, evidence),
        line.select(part, supplier, F.lit("dispatch"), evidence),
    ]
    out = rows[0].toDF("source", "target", "kind", "evidence")
    for r in rows[1:]:
        out = out.union(r)
    return out


def call_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, status, reason, linked): events as call sites of their users."""
    value = F.col("value")
    status = F.when(value < 20, "resolved").when(value < 45, "unresolved").when(value < 70, "partial").otherwise("external")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("customer#"), F.col("user_id").cast("string")).alias("node"), status.alias("status"), F.col("event_type").alias("reason"), ((F.col("event_id") % 3) == 0).alias("linked"))


# The same graph in DuckDB SQL, for the oracles
NODES_SQL = " UNION ALL ".join(f"SELECT '{t}#' || {k} AS id, '{t}' AS kind FROM {t}" for t, k in KEYS)
_EVIDENCE = "CASE WHEN l_discount < 0.03 THEN 'direct' WHEN l_discount < 0.07 THEN 'bound' ELSE 'candidate' END"
RAW_EDGES_SQL = f"""SELECT 'orders#' || o_orderkey AS source, 'customer#' || o_custkey AS target, 'reference' AS kind, 'direct' AS evidence FROM orders
  UNION ALL SELECT 'customer#' || c_custkey, 'nation#' || c_nationkey, 'attribute', 'direct' FROM customer
  UNION ALL SELECT 'supplier#' || s_suppkey, 'nation#' || s_nationkey, 'attribute', 'direct' FROM supplier
  UNION ALL SELECT 'nation#' || n_nationkey, 'region#' || n_regionkey, 'inherit', 'direct' FROM nation
  UNION ALL SELECT 'orders#' || l_orderkey, 'part#' || l_partkey, CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'new' ELSE 'callback' END, {_EVIDENCE} FROM lineitem
  UNION ALL SELECT 'orders#' || l_orderkey, 'supplier#' || l_suppkey, CASE l_linestatus WHEN 'F' THEN 'decorator' ELSE 'framework' END, {_EVIDENCE} FROM lineitem
  UNION ALL SELECT 'part#' || l_partkey, 'supplier#' || l_suppkey, 'dispatch', {_EVIDENCE} FROM lineitem"""
OUTCOMES_SQL = "SELECT 'customer#' || user_id AS node, CASE WHEN value < 20 THEN 'resolved' WHEN value < 45 THEN 'unresolved' WHEN value < 70 THEN 'partial' ELSE 'external' END AS status, event_type AS reason, event_id % 3 = 0 AS linked FROM events"
