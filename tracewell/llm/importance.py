"""Importance resampling to a target distribution, by n-grams of a position table.

Each document's words become rows of (row, position, word). A window over a document's positions leads from each word to the ones that follow, so for each order the
following words are joined to an n-gram; its hash is a bucket. Buckets are counted over the corpus and over the target texts; a bucket's gain is the log ratio of
its smoothed shares. Gains are joined back to the buckets of each document, and their floored mean is its weight. Documents are drawn without replacement by
weight plus Gumbel noise of a hash of the id.

Documents are dealt over tasks by row once, before their words are unfolded, and so the window and the sums of a document need no shuffle of words. Counts of buckets are BUCKETS rows
from each task at most. Buckets of each document are written once (14 bits each in Parquet), and both passes over them, counts and gains, read that table. The gains are BUCKETS rows, which bounds what is broadcast.
Draws take ranks by ranges of the score, so no task sees the whole order.

Defined cases: a null text has no words; a document without features weighs 0; a null id is hashed as the empty text, and stands before others in ties; repeated rows each get a row, and rows alike in id and score are ranked in any order among
themselves; an empty corpus has no rows; without target texts T is 0; texts are taken whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import numbered

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS = 2  # n-grams of 1 to so many words
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = "7"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def bucket(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def position_table(docs: DataFrame, *kept: str) -> DataFrame:
    """(row, ``kept``, position, word, then next1, ...): each word of each row of ``docs`` (row, text, ...) with those that follow it; a row with a null word for one without words.

    Rows are dealt by ``row``, which is one document's own.
    """
    unfolded = docs.repartition("row").sortWithinPartitions("row").select("row", *kept, F.posexplode_outer(words(F.col("text"))).alias("position", "word"))
    ahead = Window.partitionBy("row").orderBy("position")
    return unfolded.select("row", *kept, "position", "word", *(F.lead("word", k).over(ahead).alias(f"next{k}") for k in range(1, ORDERS)))


def document_buckets(docs: DataFrame, *kept: str) -> DataFrame:
    """(row, ``kept``, n_words, buckets): the buckets of all n-grams of each row. A document's words stay where its row is."""
    grams = [F.concat_ws(" ", "word", *(f"next{j}" for j in range(1, k))) for k in range(1, ORDERS + 1)]
    ends = ["word", *(f"next{k}" for k in range(1, ORDERS))]
    table = position_table(docs, *kept).select("row", *kept, "word", *(F.when(F.col(e).isNotNull(), bucket(g)).alias(f"b{k}") for k, (e, g) in enumerate(zip(ends, grams, strict=True))))
    found = table.groupBy("row").agg(*(F.first(c).alias(c) for c in kept), F.count("word").alias("n_words"), *(F.collect_list(f"b{k}").alias(f"b{k}") for k in range(ORDERS)))
    return found.select("row", *kept, "n_words", F.concat(*(f"b{k}" for k in range(ORDERS))).alias("buckets"))


def counted(buckets: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): occurrences, summed in tasks first."""
    return buckets.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all BUCKETS, from counts s of the corpus and t of the target texts."""
    both = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(corpus, "bucket", "left").join(target, "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")))
    every = Window.partitionBy()  # BUCKETS rows
    s_all, t_all = F.sum("s").over(every), F.sum("t").over(every)
    ratio = ((F.col("t") + 1) * (s_all + BUCKETS)) / ((F.col("s") + 1) * (t_all + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(buckets: DataFrame, gain: DataFrame, *kept: str) -> DataFrame:
    """(row, ``kept``, n_words, n_features, weight): the gains of a document's buckets are added in its task, so one row of it is shuffled."""
    keys = ["row", *kept, "n_words"]
    joined = buckets.select(*keys, F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gain), "bucket", "left")  # BUCKETS rows
    summed = joined.groupBy(*keys).agg(F.sum("gain").alias("total"), F.count("bucket").alias("n_features"))
    return summed.select(*keys, "n_features", F.coalesce(F.expr("(total - pmod(total, nullif(n_features, 0))) div nullif(n_features, 0)"), F.lit(0).cast("long")).alias("weight"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text); ``target`` has texts."""
    with_row = lambda df: df.withColumn("row", F.monotonically_increasing_id())
    found = common.materialize(document_buckets(with_row(docs.select("doc_id", "text")), "doc_id"), "ngram-buckets")
    wanted = document_buckets(with_row(target.select("text")))
    told = weighed(found, gains(counted(found, "s"), counted(wanted, "t")), "doc_id")
    scored = common.materialize(told.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("less", -F.col("score")), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ranked = numbered(scored.where(able), "less", "doc_id", name="place")
    placed = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    return placed.select(*columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "benchmark").select("text"))
