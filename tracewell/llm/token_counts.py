"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a document and its tokens,
a delete takes both away, and a revision adds the difference of counts. A batch of changes is reduced to its deltas for each group
and committed under an id; a batch that is already committed is left alone, so a retry changes nothing. Totals are the sum over committed batches.

A batch is one Parquet folder, written under a temporary name and put in place by one rename. Where the batch is there already, a rename
puts the folder into it, under its temporary name, which starts with an underscore and so is never read: by that a writer sees that
another was first, and takes its own away. A job that fails takes its folder away; one that dies leaves a folder that nobody reads.

Defined cases: a null source or language is a group of its own; a null count or text adds a document and no tokens; a change with an unknown
kind is an error; groups whose documents and tokens both come to zero are not shown; an empty batch commits and adds nothing;
a repeated change within a batch counts as often as it stands there; an empty table of documents has no totals; texts are counted whole; columns other than doc_id, source, lang and text are not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ("source", "lang", "tokenizer")
# counts that need no vocabulary, each a version of its own: words between white space, and UTF-8 bytes
TOKENIZERS = {"words-1": r"size(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+', 0))", "bytes-1": "octet_length(text)"}


def deltas(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, documents, tokens): what a batch adds.

    Changes have the keys, kind (insert, delete or revise), tokens, and old_tokens (of a revision). Sums are taken within
    tasks before the shuffle, so a hot source is one row from each.
    """
    kind = F.col("kind")
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.coalesce("tokens", F.lit(0))
    added = F.when(kind == "revise", tokens - F.coalesce("old_tokens", F.lit(0))).otherwise(sign * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(sign.cast("long")).alias("documents"), F.sum(added.cast("long")).alias("tokens"))


class Rollup:
    """Committed batches under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def committed(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        return sorted(s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("batch_id="))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False, without work, if it is there. Of writers of one batch at once, one gets True."""
        if self._fs.exists(self._path(self._batch(batch_id))):
            return False
        return self._put(batch_id, deltas(changes))

    def _put(self, batch_id: str, rows: DataFrame) -> bool:
        name = f"_made-{uuid.uuid4().hex}"
        made, target = self._path(f"{self.path}/{name}"), self._path(self._batch(batch_id))
        try:
            rows.write.parquet(made.toString())
        except Exception:
            self._fs.delete(made, True)
            raise
        moved = self._fs.rename(made, target)
        inside = self._path(target, name)
        if moved and not self._fs.exists(inside):
            return True
        self._fs.delete(inside if moved else made, True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        batches = [self._batch(b) for b in self.committed()]
        rows = self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")


def counted(docs: DataFrame, expression: str, tokenizer: str) -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.coalesce(F.expr(expression), F.lit(0)).cast("long").alias("tokens"))


def changed(rows: DataFrame, kind: str, old: Column | None = None) -> DataFrame:
    return rows.withColumn("kind", F.lit(kind)).withColumn("old_tokens", old if old is not None else F.lit(None).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: inserted by words, inserted by bytes, every later copy of a text deleted from
    the words, and all byte counts revised to leave out line ends. The first batch comes a second time and is ignored."""
    return rolled(spark, common.read(spark, sf_dir, "documents"))


def rolled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The batches of ``query`` over ``docs`` (doc_id, source, lang, text). Texts are read once, for a narrow table of counts and hashes.

    Of the rows of a text, the one of the smallest id stays, a null id being the largest, and one alone of those that share it; each other row is a deletion of its own.
    """
    counts = {name: F.coalesce(F.expr(e), F.lit(0)).cast("long") for name, e in (TOKENIZERS | {"bare": "octet_length(replace(text, '\n', ''))"}).items()}
    narrow = docs.select("doc_id", "source", "lang", "text").select("doc_id", "source", "lang", F.monotonically_increasing_id().alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), *(c.alias(n) for n, c in counts.items()))
    narrow = common.materialize(narrow, "counts")
    kept = narrow.groupBy("hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    of = lambda rows, tokenizer: rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("tokens"))
    rollup = Rollup(spark, f"{common.shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    words = changed(of(narrow, "words-1"), "insert")
    rollup.commit("0001", words)
    rollup.commit("0002", changed(of(narrow, "bytes-1"), "insert"))
    rollup.commit("0003", changed(of(narrow.join(kept, "row", "left_anti"), "words-1"), "delete"))
    rollup.commit("0004", narrow.select("source", "lang", F.lit("bytes-1").alias("tokenizer"), F.col("bare").alias("tokens"), F.col("`bytes-1`").alias("old_tokens"), F.lit("revise").alias("kind")))
    rollup.commit("0001", words)
    return rollup.totals()


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS copy FROM documents),
  rows AS (
    SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS n FROM d WHERE copy = 1
    UNION ALL SELECT source, lang, 'bytes-1', strlen(replace(t, chr(10), '')) FROM d)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM rows GROUP BY source, lang, tokenizer"""
