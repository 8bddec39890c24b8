"""Language identification by rank-order profiles.

Each language has a profile: its most frequent character n-grams, in order. A document's own most frequent n-grams
are compared with each profile by out-of-place distance: how far each stands from its place there, or the largest
distance where it is missing. The least distance wins.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; equal distances go to the
smaller language name; without any profile (an empty table, or no language given) every row is ``und``; repeated
rows are predicted alike; a very long text is taken whole; columns of other names are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MOST_ROWS = 1000  # documents a language that profiles are fitted on, at most
MOST_LANGUAGES = 1000  # more distinct values of lang than this are an error: profiles are broadcast
PROFILE = 400  # n-grams in a profile
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for all else; of the basic plane."""
    table = np.full(0x10000, SPACE, np.uint32)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _letters()[np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        for cp in np.unique(raw[raw > 0xFFFF]):
            c = chr(cp)
            low[raw == cp] = ord(c.lower()[0]) if unicodedata.category(c).startswith("L") else SPACE
    return low


def _ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count), n from 1 to 3 within words and with one space on either side; three code points in an integer."""
    c = np.concatenate(([SPACE], _codes(text), [SPACE])).astype(np.int64)
    blank = c == SPACE
    c = c[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two, mid = (c[:-1] << 21) | c[1:], c[1:-1] != SPACE
    three = ((two[:-1] << 21) | c[2:])[mid]
    return np.unique(np.concatenate((c[c != SPACE], two, three)), return_counts=True)


def _top(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    if len(grams) > 4 * most:
        some = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))[:most]]


def fit(docs: DataFrame, profile: int = PROFILE, most_rows: int = MOST_ROWS) -> dict[str, np.ndarray]:
    """Profiles from the text and lang of a bounded sample: ``most_rows`` documents a language, outside the held-out quarter."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    sample = common.bounded_sample(rows, "lang", "doc_id", most_rows, MOST_LANGUAGES)

    def count(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                both = [_ngrams(t) for t in texts]
                if both and sum(len(g) for g, _ in both):
                    g, k = np.concatenate([g for g, _ in both]), np.concatenate([n for _, n in both])
                    grams, where = np.unique(g, return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(where, k).astype("int64")})

    ranked = (
        sample.mapInPandas(common.tidied(count), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        .where(F.col("rank") <= profile)
    )
    found = ranked.orderBy("lang", "rank").select("lang", "gram").toPandas()  # PROFILE rows a language, and few languages
    return {lang: rows["gram"].to_numpy(np.int64) for lang, rows in found.groupby("lang")}


def guesser(spark: SparkSession, profiles: dict[str, np.ndarray], profile: int = PROFILE):
    """A function of a text column: (lang_pred, score), where score is 1 less the distance as a share of the largest there can be."""
    names = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(names), len(grams) + 1), -1, np.int64)  # the last column: n-grams of no profile
    for k, n in enumerate(names):
        ranks[k, np.searchsorted(grams, profiles[n])] = np.arange(len(profiles[n]))
    shared = spark.sparkContext.broadcast((names, grams, ranks))  # languages times PROFILE numbers

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, grams, ranks = shared.value

        def one(text: str | None) -> tuple[str, float]:
            own = _top(*_ngrams(text), profile) if text and len(names) else np.zeros(0, np.int64)
            if not len(own):
                return "und", 0.0
            at = np.searchsorted(grams, own)
            at[at == len(grams)] = 0
            there = ranks[:, np.where(grams[at] == own, at, len(grams))]
            far = np.where(there < 0, profile, np.abs(there - np.arange(len(own)))).sum(axis=1)
            best = int(far.argmin())
            return names[best], 1.0 - float(far[best]) / (profile * len(own))

        try:
            for texts in batches:
                found = [one(t.as_py()) for t in texts]
                yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang_pred", "score"])
        finally:
            common.tidy()

    return guess


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs``."""
    told = docs.select("doc_id", guesser(docs.sparkSession, profiles, profile)("text").alias("told"))
    return told.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "told.lang_pred", "told.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter, with all columns as they are: a language can be given to these alone. Profiles come from the documents of this stage's own input; without any (no labels), none can be told from another, and all with a letter stay."""
    profiles = fit(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(guesser(spark, profiles)(F.col("text"))["lang_pred"] != "und")
