"""Places in a whole order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.storage import materialize


def numbered(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """``rows`` with ``name``: the place in the order, from 0. Ranges of the order are sorted apart, and the rows of earlier ranges added.

    Rows of equal places in the order are numbered in any way.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each partition
    ahead = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_ahead") + F.col("_place")).cast("long")).drop("_range", "_place", "_ahead")
