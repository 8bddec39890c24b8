"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import storage
from tracewell.storage import shared_dir  # noqa: F401  for the modules of this subpackage

HELD_OUT = 2  # crc32(doc_id as text) mod 4 with this remainder is never trained on


def tidy() -> None:
    """Gives memory that this Python worker no longer uses back: it lives on for later tasks, beside those of other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidied(run):
    """``run``, a function from batches to batches, with ``tidy`` at its end."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole



def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """As ``storage.materialize``; the driver's garbage is collected then, as shuffle files of finished jobs go only with it."""
    out = storage.materialize(df, tag)
    del df
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def positioned(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of Parquet files with position: the row's number from 0, by number of the part and row within it. Other rows have none.

    The order of splits when files are read doesn't matter.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        return docs.select(*columns, F.lit(None).cast("long").alias("position"))
    about = docs.metadataColumn("_metadata")  # the files' own, whatever columns are called
    rows = docs.select(*columns, about["file_path"].alias("_file"), about["row_index"].alias("_at"))
    files = docs.groupBy(about["file_path"].alias("_f")).agg(F.count("*").alias("_n"))
    name = F.substring_index("_f", "/", -1)
    part = F.when(name.rlike(r"^part-\d+"), F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"))
    ahead = F.sum("_n").over(Window.orderBy(part.asc_nulls_first(), "_f")) - F.col("_n")  # a row for each file
    return rows.join(F.broadcast(files.select("_f", ahead.alias("_ahead"))), F.col("_file") == F.col("_f")).select(*columns, (F.col("_ahead") + F.col("_at")).alias("position"))


def held_out(doc_id: Column) -> Column:
    """True for rows outside training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def bounded_sample(rows: DataFrame, by: str, key: str, most: int, values: int = 1000) -> DataFrame:
    """About ``most`` rows of each value of ``by`` (all, if fewer), those with the smallest hash of ``key``.

    A count of each value, which reads two narrow columns, gives a threshold for the hash, so only sampled rows are shuffled.
    The number of rows is bounded by ``most`` for each value; ties go by the key. More than ``values`` values are an error.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).limit(values + 1).collect()
    if len(counts) > values:
        raise ValueError(f"{by} has more than {values} values")
    unit = F.xxhash64(F.col(key)).bitwiseAND(F.lit(2**52 - 1)) / float(2**52)
    share = F.create_map(*(F.lit(x) for r in counts if r[0] is not None for x in (r[0], (1.1 * most + 20) / r.n))) if counts else None
    if share is None:
        return rows.limit(0)
    order = Window.partitionBy(by).orderBy("_unit", key)
    kept = rows.withColumn("_unit", unit).where(F.col("_unit") <= share[F.col(by)])
    return kept.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_unit", "_rank")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array (wrapping arithmetic)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(data: np.ndarray, kind: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of bytes of one kind over 0; runs also end at ``cuts`` (ascending offsets).

    ``kind`` gives each byte's class: 0 separates. A run's hash depends on its bytes alone: prefix sums of a
    polynomial in an odd base, which can be divided by the power at its start.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[cuts[cuts <= len(data)]] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    some = kind[start] > 0
    start, end = start[some], end[some]
    up, down = _grown(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def text_chunks(column, most: int = 1 << 20):
    """(first row, offsets, bytes) of consecutive rows of an Arrow string column, about ``most`` bytes each; null: empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, (offsets[row : stop + 1] - offsets[row]), data[offsets[row] : offsets[stop]]
        row = stop


def word_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(byte -> byte with A-Z lowered, byte -> kind) for ``run_hashes``: every byte but the separators is of kind 1."""
    folded, kind = np.arange(256, dtype=np.uint8), np.ones(256, np.uint8)
    if lower:
        folded[65:91] += 32
    kind[list(separators)] = 0
    return folded, kind


def hashed_runs(offsets: np.ndarray, data: np.ndarray, folded: np.ndarray, kinds: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run, in order; first run of each row and the end). A row beyond ``most`` bytes goes in parts cut between runs."""
    data = folded[data]
    kind = kinds[data]
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + most)
        while stop < len(data) and kind[stop] and kind[stop] == kind[stop - 1]:
            more = np.flatnonzero(kind[stop : stop + most] != kind[stop])
            stop += int(more[0]) if len(more) else min(most, len(data) - stop)
        inner = offsets[(offsets >= at) & (offsets <= stop)] - at
        s, h = run_hashes(data[at:stop], kind[at:stop], inner)
        starts.append(s + at)
        hashes.append(h)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(start, offsets)
