"""Root ids of a request: given ones first, then those of a file; each once, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.traversal import MOST_ROOTS, number_roots


class RootError(ValueError):
    """The list of roots can't be used."""


def collect_roots(spark: SparkSession, given: list[str], path: str | None = None) -> DataFrame:
    """(root_idx, id). The file is a JSON array of ids, or a document whose facts have symbols with a usr."""
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(given)], "place long, part int, id string")
    if path:
        text = spark.read.text(path, wholetext=True).select("value")
        listed = text.select(F.posexplode(F.from_json("value", "array<string>"))).toDF("place", "id")
        fact = text.select(F.posexplode(F.from_json("value", "facts array<struct<symbol:struct<usr:string>>>")["facts"])).select(F.col("pos").alias("place"), F.col("col.symbol.usr").alias("id"))
        rows = rows.unionByName(listed.unionByName(fact).where("id IS NOT NULL").select("place", F.lit(1).alias("part"), "id"))
    rows = rows.withColumn("pos", F.struct("part", "place"))
    numbered = number_roots(rows)
    bad = numbered.agg(F.count("*").alias("n"), F.max((F.col("id") == "") | F.col("id").rlike(r"[\x00-\x1F\x7F]")).alias("odd")).first()
    if not bad.n or bad.odd or bad.n > MOST_ROOTS:
        raise RootError("no roots" if not bad.n else "an id is empty or has control characters" if bad.odd else f"more than {MOST_ROOTS} roots")
    return numbered
