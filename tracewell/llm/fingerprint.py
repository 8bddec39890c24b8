"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

Sections end at blank lines, paragraphs at line ends, and leaves hold up to eight words of a paragraph with the white space
around them, so the leaves together are the text, exactly. Leaves have 128-bit hashes. A paragraph's hash is over its leaves' hashes in order, a section's
over its paragraphs', and the root, which is the fingerprint, over its sections'. Equal roots mean equal texts; where
roots differ, the branches that differ show where. Likeness of two fingerprints is the share of leaves they have in common
(twice the common ones over all of both), 1 where roots are equal.

All of it is DataFrame functions. For the next document in order of id, rows are dealt into ranges of ids by approximate
quantiles; within a range a window gives the next row, and each range's first row is handed to the one before it, so no task
orders all rows.

Defined cases: a null text is taken as empty: it has no leaves and the root of no sections; two empty texts have likeness 1, an empty and another 0.
Rows of one id are ordered by text; repeated rows are each other's next. A null id comes first. A table of one row is
its own next. Texts are whole, however long; columns of other names are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAF = r"(?:\S++\s*+|\s++){1,8}"  # up to eight words with what follows each
SECTION = r"(?<=\n[ \t]{0,8}\n)(?![ \t]*\n)"
RANGE_ROWS = 2_000  # rows of a range of ids, about
MOST_RANGES = 10_000


def tree(text: Column) -> Column:
    """An array of sections, each an array of paragraphs, each an array of leaf hashes."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x.cast("binary")))
    lines = lambda s: F.transform(F.filter(F.split(s, r"(?<=\n)"), lambda p: p != ""), leaves)
    return F.transform(F.split(text, SECTION), lines)


def paragraphs(nested: Column) -> Column:
    """Hash of each paragraph, as an array for each section."""
    return F.transform(nested, lambda s: F.transform(s, lambda p: F.md5(F.array_join(p, ".").cast("binary"))))


def root(hashed: Column) -> Column:
    """The fingerprint, from the hashes of paragraphs."""
    return F.sha2(F.array_join(F.transform(hashed, lambda s: F.sha2(F.array_join(s, "."), 256)), "."), 256)


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two trees have in common, by distinct leaves."""
    x, y = F.array_distinct(F.flatten(F.flatten(a))), F.array_distinct(F.flatten(F.flatten(b)))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def located(a: Column, b: Column) -> Column:
    """Where two trees differ, from their hashes of paragraphs: (section, paragraph) from 0, over the longer of each; empty if the texts are equal."""
    none = F.array().cast("array<string>")

    def inside(s: Column, i: Column) -> Column:
        both = F.arrays_zip(F.coalesce(s["x"], none).alias("x"), F.coalesce(s["y"], none).alias("y"))
        told = F.transform(both, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p["x"].eqNullSafe(p["y"]).alias("same")))
        return F.when(s["x"].eqNullSafe(s["y"]), F.filter(told, lambda t: F.lit(False))).otherwise(F.filter(told, lambda t: ~t["same"]))

    rows = F.flatten(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), inside))
    return F.transform(rows, lambda t: F.struct(t["section"], t["paragraph"]))


def with_next(docs: DataFrame, key: str, body: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` (of columns key and body) with ``next``: the body of the row after in order of key and body, cyclically.

    Ranges of keys come from approximate quantiles: MOST_RANGES numbers at most on the driver. Bodies are shuffled once.
    """
    total = docs.count()
    n = max(1, min(MOST_RANGES, total // rows))
    bounds = sorted(set(docs.where(F.col(key).isNotNull()).approxQuantile(key, [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.lit(0)
    if bounds:
        # how many bounds are at or below the key, by halving
        def below(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.col(key) < F.lit(int(bounds[mid])), below(low, mid)).otherwise(below(mid + 1, high))

        part = F.when(F.col(key).isNull(), F.lit(0)).otherwise(below(0, len(bounds)))
    dealt = docs.withColumn("_part", part)
    order = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first(), body)
    least = F.min(F.struct(F.col(key).isNotNull().alias("a"), F.col(key).alias("b"), F.col(body).alias("c")))
    firsts = dealt.groupBy("_part").agg(least.alias("_f"))  # a row for each range
    ranges = [r[0] for r in dealt.select("_part").distinct().orderBy("_part").collect()]  # MOST_RANGES numbers at most
    before = dict(zip(ranges, ranges[-1:] + ranges[:-1], strict=True))
    to = docs.sparkSession.createDataFrame(list(before.items()), "_part int, _to int")
    handed = firsts.join(F.broadcast(to), "_part").select("_to", F.col("_f.c").alias("_first"))
    return dealt.withColumn("_next", F.lead(body).over(order)).join(handed, F.col("_part") == F.col("_to"), "left").withColumn("next", F.coalesce("_next", "_first")).select(key, body, "next")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, and where the edited text's tree differs: edited_paragraphs, how many of its paragraphs, and first_edited, the
    first of them (section and paragraph; null if the texts are equal)."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id", "t")
    n = F.length("t")
    edited = F.concat(F.substring("t", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("next", F.lit(1), F.floor(n / 4).cast("int")))
    built = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("e"), "t", "next")
    built = built.select("doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), tree(F.col("t")).alias("own"), tree(F.col("e")).alias("edit"), tree(F.col("next")).alias("after"))
    built = built.select("doc_id", "n_chars", "edited_sha256", likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"), paragraphs(F.col("own")).alias("own"), paragraphs(F.col("edit")).alias("edit"))
    built = built.withColumn("differs", located(F.col("own"), F.col("edit")))
    return built.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        root(F.col("own")).alias("fingerprint"),
        root(F.col("edit")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("differs").alias("edited_paragraphs"),
        F.get("differs", F.lit(0)).alias("first_edited"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"))

