"""Walking lookup paths over a catalogue of models: one round of joins for each part of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.storage import materialize

# fixed values: last parts of a path that compare and name no field
LOOKUPS = "exact iexact gt gte lt lte in contains icontains startswith istartswith endswith iendswith range isnull regex iregex year iso_year month day week week_day iso_week_day quarter hour minute second date time".split()
MOST_PARTS = 32
FEW = 200_000  # rows of a catalogue that all tasks are sent; by a join of shuffles, the sites of one model and name would be one task's
PER_TASK = 200_000  # sites whose rows one task tells apart, about


def walk_lookups(sites: DataFrame, fields: DataFrame) -> DataFrame:
    """(site, table_name, column_name) that each lookup path names; a path that leads nowhere gives one row without a column.

    ``sites``: site, model, path (parts joined by __). ``fields``: model, name, table_name, column_name, target (of a relation, else null);
    reverse relations are rows of their own. The model's primary key is the field named pk.
    """
    at = materialize(sites.select("site", "model", F.split("path", "__").alias("rest"), F.lit(True).alias("first")), "lookups")
    out, n = None, at.count()
    fields = materialize(fields.select("model", "name", "table_name", "column_name", "target"), "catalogue")
    if fields.count() <= FEW:
        fields = F.broadcast(fields)
    for _ in range(MOST_PARTS):
        if at.isEmpty():
            break
        head = at.withColumn("name", F.get("rest", F.lit(0))).withColumn("more", F.slice("rest", 2, MOST_PARTS))
        hit = head.join(fields, ["model", "name"], "left")
        lookup = F.col("column_name").isNull() & ~F.col("first") & F.col("name").isin(*LOOKUPS) & (F.size("more") == 0)
        named = hit.where(F.col("column_name").isNotNull()).select("site", "table_name", "column_name")
        # a path of one relation after another goes on; a field that is no relation can only be compared
        dead = hit.where((F.col("column_name").isNull() & ~lookup) | (F.col("column_name").isNotNull() & F.col("target").isNull() & (F.size("more") > 0) & ~(F.get("more", F.lit(0)).isin(*LOOKUPS) & (F.size("more") == 1))))
        lost = dead.select("site", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("column_name"))
        step = named.unionByName(lost)
        out = step if out is None else out.unionByName(step)
        at = materialize(hit.where(F.col("target").isNotNull() & (F.size("more") > 0)).select("site", F.col("target").alias("model"), F.col("more").alias("rest"), F.lit(False).alias("first")), "lookups")
    if out is not None:  # a site's rows are told apart where it is dealt to, in a table that doesn't grow with the input
        return out.repartition(1 + n // PER_TASK, "site").distinct()
    return sites.select("site", F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("column_name")).limit(0)
