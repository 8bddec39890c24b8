"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words and runs of punctuation are tokens; tokens and pairs of neighbouring tokens are hashed into buckets, all pairs of
equal tokens into one. A document is
a sparse vector of bucket counts, squashed and scaled to unit length, and its score is the sigmoid of one sparse dot
product. The updates are FTRL-proximal: each weight follows from a sum of gradients, with a rate of its own and an L1 part
that keeps most weights at zero.

Labelled rows are dealt into shards that are trained apart and averaged, so no task sees more than its shard.

Defined cases: null and empty texts have no tokens and score the sigmoid of the bias; without a label, or with labels of
one class, training has nothing to tell apart and all score by the bias (0.5, or the side of that class); a doc_id with
several labels trains with each; repeated rows score alike; texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
MOST_LABELLED = 12_000  # labelled rows a class that the model is fitted on, at most
SHARDS = 4
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
PAIR = np.uint64(0x9FB21C651E98DF25)
TWICE = np.uint64(0x2545F4914F6CDD1D)  # the pair of any token with itself


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits (and all beyond ASCII), and other marks, make runs of their own; white space and controls separate."""
    kind = np.full(256, 1, np.uint8)
    for b in range(128):
        kind[b] = 1 if chr(b).isalnum() else 0 if b <= 32 or b == 127 else 2
    return np.arange(256, dtype=np.uint8), kind


def _features(column):
    """(first row, row of each feature, bucket, value) of consecutive rows of an Arrow text column."""
    folded, kinds = _kinds()
    for row, offsets, data in common.text_chunks(column):
        words, first = common.hashed_runs(offsets, data, folded, kinds)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        same = of[1:] == of[:-1]
        pairs = np.where(words[:-1] == words[1:], TWICE, common.mix(words[:-1] * PAIR + words[1:]))[same]
        key = (np.concatenate((of, of[1:][same])).astype(np.int64) << 18) | (np.concatenate((words, pairs)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        rows, bucket, value = key >> 18, key & (BUCKETS - 1), np.sqrt(n)
        length = np.sqrt(np.bincount(rows, value**2, len(offsets) - 1))
        yield row, len(offsets) - 1, rows, bucket, value / length[rows]


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal over (buckets, values, label); the last weight is the bias's."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
            g = (_sigmoid(w @ x) - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, shards: int = SHARDS) -> np.ndarray:
    """Mean weights of the shards, from at most ``most`` labelled documents of each class outside the held-out quarter."""
    marked = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~common.held_out(F.col("_id")))
    few = common.bounded_sample(marked, "_y", "_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))  # few: 2 * most narrow rows

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow as pa

        pdf = pdf.sort_values(["_id", "_y", "text"])
        y, rows = pdf["_y"].to_numpy(float), []
        for first, count, of, bucket, value in _features(pa.array(pdf["text"], pa.large_string())):
            cut = np.searchsorted(of, np.arange(count + 1))
            rows += [(np.append(bucket[a:b], BUCKETS), np.append(value[a:b], 1.0), y[first + k]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
        w = train(rows)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "w": w[at] * len(rows), "n": 0}) if len(at) else pd.DataFrame({"bucket": [BUCKETS], "w": [0.0], "n": [0]})

    dealt = rows.withColumn("_shard", F.abs(F.xxhash64("_id", F.lit(11))) % shards)
    sizes = dealt.count()
    trained = dealt.groupBy("_shard").applyInPandas(shard, "bucket long, w double, n long").groupBy("bucket").agg(F.sum("w").alias("w"))
    found = trained.toPandas()  # at most BUCKETS + 1 rows
    w = np.zeros(BUCKETS + 1)
    w[found["bucket"].to_numpy(np.int64)] = found["w"].to_numpy() / max(1, sizes)
    return w


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score) of ``docs``; the text doesn't leave the task that reads it."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS + 1 numbers

    def scored(batches):
        w = shared.value
        for b in batches:
            z = np.full(b.num_rows, w[BUCKETS])
            for first, count, of, bucket, value in _features(b.column("text")):
                z[first : first + count] += np.bincount(of, w[bucket] * value, count)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(_sigmoid(z))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidied(scored), "doc_id long, held_out boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
