"""Token ids in files, compressed by Re-Pair grammars and open to random access.

Documents in ascending id order are encoded and followed by an end id. A shard is a run of whole documents; within it frequent pairs of ids are
replaced by nonterminals, round after round, until no pair is frequent enough to pay for its rule or a round saves next to nothing. A round takes pairs by falling count, each
unless its left id is already taken as a right one or the other way round: so occurrences of different pairs don't overlap, and all of a round are replaced in one pass.
A pair of one id with itself is taken where that id is in no other pair, from the left of each run.
A pair never spans two documents, so each document is a slice of symbols. Rules carry the length of what they stand for; by the sums of these,
any ids of any document are decoded without the rest.

A file is a row of a Parquet table: (part, seq, doc_ids, tokens, payload), in the order of part and seq. The payload holds a header, rules, lengths of
their expansions, where each document starts in symbols and in ids, and the symbols, in 16 bits each where they fit. Spark commits the table, so a task that is lost is written again.

Words between ASCII white space are encoded once for each task's stretch of text, as white space parts tokens and is dropped by this vocabulary. Runs of Latin letters and of
punctuation are single units before its merges and go to them directly; all else takes the tokenizer's whole path.

Defined cases: a null text is empty, and a document of the end id alone; null ids stand first; equal ids go by a hash of their text, and repeated rows each get an entry;
an empty table gives an empty file table and no rows; texts are encoded whole; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END = 1
SHARD_IDS = 1 << 18  # a shard ends with the document that reaches this
LEAST = 8  # occurrences that pay for a rule
MOST_PAIRS = 4096  # pairs that a round looks at, by falling count; the next round sees the others
ROUNDS = 12
SLIGHT = 64  # a round that saves less than this part of the symbols is the last
CACHED = 500_000  # words that a worker remembers between stretches of text
STRETCH = 16 << 20  # bytes of text that are encoded at once
HEADER = struct.Struct("<4sIIIII")
FILES = "part int, seq int, doc_ids array<long>, tokens long, payload binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}


# letters that are lower case, composed and a run by themselves, then punctuation: two units, each merged apart
UNITS = r"^(?P<a>[a-zß-öø-ÿ]+)(?P<b>[!-/:-@\[-`{-~]*)$"


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``flat`` that ``items`` name, one after another; where each ends)."""
    length = size[items]
    end = np.cumsum(length)
    if not len(end):
        return flat[:0], end
    return flat[np.repeat(start[items] - (end - length), length) + np.arange(end[-1], dtype=start.dtype)], end


class Encoder:
    """Ids of texts, with a memory of units that is bounded by CACHED."""

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {"": b""}

    def _learn(self, units: list[str], direct: np.ndarray) -> list[bytes]:
        """The ids of each unit, four bytes each."""
        known, tokenize, letters = self.known, self.tokenizer.model.tokenize, _byte_letters()
        if len(known) > CACHED:  # those of this stretch stay: they hold what is frequent everywhere
            self.known = known = {u: known[u] for u in units if u in known} | {"": b""}
        new = [k for k, u in enumerate(units) if u not in known]
        other = [units[k] for k in new if not direct[k]]
        for k in range(0, len(other), 4096):
            for u, e in zip(other[k : k + 4096], self.tokenizer.encode_batch_fast(other[k : k + 4096], add_special_tokens=False), strict=True):
                known[u] = array("I", e.ids).tobytes()
        for u in (units[k] for k in new if direct[k]):
            shown = u if u.isascii() else u.encode().decode("latin-1").translate(letters)
            known[u] = array("I", [t.id for t in tokenize(shown)]).tobytes()
        return [known[u] for u in units]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text starts and the end)."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        if not len(words.values):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        spread = words.values.dictionary_encode()
        own = spread.dictionary
        low = pc.if_else(pc.match_substring(own, "<|"), own, pc.ascii_lower(own))  # names of special tokens stand as they are
        pair = pc.extract_regex(low, UNITS)
        plain = pc.is_valid(pair)
        first = pc.if_else(plain, pc.struct_field(pair, "a"), low)
        second = pc.if_else(plain, pc.struct_field(pair, "b"), "")
        units = pa.chunked_array([first.cast(pa.large_string()), second.cast(pa.large_string())]).combine_chunks().dictionary_encode()
        at = units.indices.to_numpy()
        direct = np.zeros(len(units.dictionary), bool)
        direct[at[: len(own)][plain.to_numpy(zero_copy_only=False)]] = True
        direct[at[len(own) :]] = True
        found = self._learn(units.dictionary.to_pylist(), direct)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        both = np.stack((at[: len(own)], at[len(own) :]), axis=1).ravel()  # the two units of each distinct word
        flat, end = _gathered(flat, np.cumsum(size) - size, size, both)
        end = end[1::2]
        size = np.diff(end, prepend=0)
        ids, end = _gathered(flat, end - size, size, spread.indices.to_numpy())
        offsets = words.offsets.to_numpy()
        return ids, np.concatenate(([0], end))[offsets - offsets[0]]


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> bytes:
    """The payload of a shard: ``ids`` of documents that begin at ``starts`` (whose last entry is the end)."""
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, lengths = ids.astype(np.uint32), [], np.ones(base, np.int64)
    closes = np.zeros(len(ids), bool)
    closes[starts[1:] - 1] = True  # no document is empty: each has its end id
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        size = base + len(rules)
        kind, shift = (np.uint32, 16) if size < 1 << 16 else (np.uint64, 32)
        across = np.iinfo(kind).max  # the key of two documents' ids; no pair's own, as the right id of it would be the largest of all
        keys = (symbols[:-1].astype(kind) << kind(shift)) | symbols[1:].astype(kind)
        keys[closes[:-1]] = across
        ranked = np.sort(keys)
        edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        count = np.diff(np.append(edge, len(ranked)))
        often = np.flatnonzero((count >= least) & (ranked[edge] != across))
        often = often[np.argsort(-count[often], kind="stable")[:MOST_PAIRS]]
        pairs = ranked[edge[often]].astype(np.uint64)
        taken, lefts, rights = [], bytearray(size), bytearray(size)
        for x, y in zip((pairs >> np.uint64(shift)).tolist(), (pairs & np.uint64((1 << shift) - 1)).tolist(), strict=True):
            if not rights[x] and not lefts[y] and (x != y or not (lefts[x] or rights[x])):
                lefts[x] = rights[y] = 1
                taken.append((x, y))
        if not taken:
            break
        new = np.array(taken, np.int64)
        opens, ends = np.frombuffer(lefts, bool), np.frombuffer(rights, bool)
        at = np.flatnonzero(opens[symbols[:-1]] & ends[symbols[1:]])
        wanted = ((new[:, 0] << shift) | new[:, 1]).astype(kind)
        by = np.argsort(wanted)
        wanted, there = wanted[by], keys[at]
        place = np.minimum(np.searchsorted(wanted, there), len(by) - 1)
        hit = wanted[place] == there
        at, place = at[hit], by[place[hit]]
        beside = np.diff(at, prepend=-2) == 1  # only pairs of one id with itself stand side by side
        if beside.any():
            every = np.arange(len(at))
            keep = (every - np.maximum.accumulate(np.where(beside, 0, every))) % 2 == 0
            at, place = at[keep], place[keep]
        symbols[at] = size + place
        closes[at] = closes[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        before, symbols, closes = len(symbols), symbols[keep], closes[keep]
        lengths = np.concatenate((lengths, lengths[new[:, 0]] + lengths[new[:, 1]]))
        rules += taken
        if (before - len(symbols)) * SLIGHT < before:
            break
    width = 2 if base + len(rules) <= 1 << 16 else 4
    heads = np.concatenate(([0], np.flatnonzero(closes) + 1))
    parts = (np.array(rules, "<u4").reshape(-1, 2), lengths[base:].astype("<u4"), heads.astype("<u4"), starts.astype("<u8"), symbols.astype(f"<u{width}"))
    return b"".join([HEADER.pack(b"RPG1", base, len(rules), len(symbols), len(starts) - 1, width), *(p.tobytes() for p in parts)])


class Shard:
    """A payload, read back."""

    def __init__(self, payload: bytes):
        magic, self.base, rules, symbols, docs, width = HEADER.unpack_from(payload)
        if magic != b"RPG1":
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        for name, kind, n in (("rules", "<u4", 2 * rules), ("lengths", "<u4", rules), ("heads", "<u4", docs + 1), ("starts", "<u8", docs + 1), ("symbols", f"<u{width}", symbols)):
            setattr(self, name, np.frombuffer(payload, kind, n, at))
            at += n * np.dtype(kind).itemsize
        if at != len(payload):
            raise ValueError("a shard of token ids is cut short or too long")
        self.rules = self.rules.reshape(-1, 2)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """What ``symbols`` stand for, level by level of their rules."""
        symbols = symbols.astype(np.uint32)
        while (big := symbols >= self.base).any():
            size = 1 + big
            out, first = np.repeat(symbols, size), (np.cumsum(size) - size)[big]
            out[first], out[first + 1] = self.rules[symbols[big] - self.base].T
            symbols = out
        return symbols

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``; only symbols that hold some of these are expanded."""
        symbols = self.symbols[self.heads[k] : self.heads[k + 1]].astype(np.int64)
        size = np.where(symbols < self.base, 1, self.lengths[np.maximum(symbols - self.base, 0)] if len(self.lengths) else 1)
        end = np.cumsum(size)
        start, stop, _ = slice(start, stop).indices(int(end[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = int(np.searchsorted(end, start, "right")), int(np.searchsorted(end, stop, "left"))
        skipped = int(end[first] - size[first])
        return self.expand(symbols[first : last + 1])[start - skipped : stop - skipped]

    def all(self) -> np.ndarray:
        """The ids of all documents: rules are expanded once, and each symbol takes its run of ids."""
        flat = np.concatenate((np.arange(self.base, dtype=np.uint32), self.expand(np.arange(self.base, self.base + len(self.rules)))))
        size = np.concatenate((np.ones(self.base, np.int64), self.lengths.astype(np.int64)))
        return _gathered(flat, np.cumsum(size) - size, size, self.symbols)[0]


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about STRETCH bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + STRETCH, "right")))
        yield row, stop
        row = stop


def write(docs: DataFrame, path: str, vocabulary_path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """The files of ``docs`` (doc_id, text) under ``path``, a folder that all machines share."""
    name = vocabulary_path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, starts = TaskContext.get().partitionId(), 0, [], [], [0]
        encoder = _encoder(name)

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, ids, starts
            payload = compress(np.concatenate(ids), np.array(starts, np.int64))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.list_(pa.int64())), pa.array([starts[-1]], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "doc_ids", "tokens", "payload"])
            seq, held, ids, starts = seq + 1, [], [], [0]
            return row

        for batch in batches:
            texts = batch.column("text")
            for row, stop in _stretches(texts):
                found, at = encoder.encode(texts.slice(row, stop - row))
                for k, doc in enumerate(batch.column("doc_id").slice(row, stop - row).to_pylist()):
                    held.append(doc)
                    ids += [found[at[k] : at[k + 1]], np.array([END], np.uint32)]
                    starts.append(starts[-1] + int(at[k + 1] - at[k]) + 1)
                    if starts[-1] >= shard_ids:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = (F.col("doc_id").asc_nulls_first(), "tie", "row")  # the row's number only deals out many rows of one id and text
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(common.tidied(run), FILES).write.parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, before): the ids of all shards before. Parts are as many as tasks wrote, and only their totals are ordered in one task."""
    narrow = shards.select("part", "seq", "tokens")
    parts = narrow.groupBy("part").agg(F.sum("tokens").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")
    return narrow.withColumn("within", within).join(ahead, "part").select("part", "seq", (F.col("ahead") + F.col("within")).alias("before"))


def digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, docs, payload in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "payload")), strict=True):
                shard = Shard(payload.as_buffer())
                ids, at = shard.all().astype("<u4"), shard.starts.astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(crc)
                columns = [pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), docs.values, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    told = shards.select("part", "seq", "doc_ids", "payload").mapInArrow(common.tidied(run), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return told.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(common.read(spark, sf_dir, "documents"), path)
    return digests(files(spark, path))
