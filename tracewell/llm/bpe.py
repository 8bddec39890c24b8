"""Byte-level BPE encoding and decoding by monoid tree reduction.

Each match of the splitting pattern is encoded by itself. A match is halved until its parts are short; a short part is
merged directly, always the pair of the lowest rank, leftmost first. Two encoded neighbours are joined by encoding a
window over their boundary anew: some tokens of the left end and some of the right start, widened on a side until the
token outside and the window's token next to it are stable together, that is, until their bytes encoded as one give
those two tokens. A sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is so stable (no
first merge across a boundary can happen in the whole that doesn't happen in the pair), so tokens outside a
window stand. Joining is associative, and decoding concatenates token bytes up the tree.

Defined cases: a null text is taken as empty: no tokens, and the hash of no bytes; texts are whole, however long; repeated rows give
repeated results; white space and bytes of any script pass through unchanged, as decoding shows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 24  # bytes that are merged directly
MOST_CACHED = 1 << 18  # matches or pairs that a worker remembers
MOST_RANKS = 1_000_000  # a vocabulary beyond this is an error: it is broadcast


class Words(dict):
    """Tokens of matches seen; others are made when asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, match: str) -> tuple[int, ...]:
        return self.make(match)


class Codec:
    """Ranks and their inverse, with bounded memories of matches and pairs seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes = {i: b for b, i in ranks.items()}
        self.words = Words(self.word)
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short piece: the pair of lowest rank is merged, leftmost first, until none is left."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1])

    def stable(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MOST_CACHED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes, from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.window(left[len(left) - i :], right[:j])
            fixed_left = i == len(left) or self.stable(left[-i - 1], window[0])
            fixed_right = j == len(right) or self.stable(window[-1], right[j])
            if fixed_left and fixed_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if fixed_left else 2 * i, j if fixed_right else 2 * j

    def window(self, left: list[int], right: list[int]) -> list[int]:
        """A window's tokens: merged directly while short; a long one (a run of one character, say) by a heap of pairs."""
        piece = self.decode(left + right)
        return self.merged(piece) if len(piece) <= 4 * LEAF else self.merged_long(piece)

    def merged_long(self, piece: bytes) -> list[int]:
        """As ``merged``, in n log n steps, with links between parts."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            k = after[i] if end[i] else n
            if k >= n or end[k] != stop:
                continue  # one of the two has changed since
            end[i], end[k], after[i] = stop, 0, after[k]
            if after[k] < n:
                before[after[k]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := ranks.get(piece[a : end[after[a]]])) is not None:
                    heappush(heap, (r, a, end[after[a]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.merged(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def word(self, match: str) -> tuple[int, ...]:
        """The tokens of a match that isn't known yet; a match that is itself a token stays one."""
        piece = match.encode("utf-8")
        whole = self.ranks.get(piece)
        found = (whole,) if whole is not None else tuple(self.tree(piece))
        if len(match) <= 64:
            if len(self.words) >= MOST_CACHED:
                self.words.clear()
            self.words[match] = found
        return found

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{path} has more than {MOST_RANKS} tokens")
    return ranks


def _worker(shared, made: dict = {}) -> Codec:  # noqa: B006  one codec for each worker and vocabulary
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in made:
        made.clear()
        made[key] = Codec(*shared.value)
    return made[key]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids. The vocabulary is read on the driver from ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), pattern))  # at most MOST_RANKS tokens

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        codec = _worker(shared)
        return pd.Series([list(codec.encode(t or "")) for t in texts])

    return docs.withColumn(ids, run(text))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of an array of token ids."""
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), "$^"))

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        codec = _worker(shared)
        return pd.Series([codec.decode(x if x is not None else ()) for x in column])

    return docs.withColumn(out, run(ids))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with n_tokens and hashes of the ids and of the bytes they decode to; ids stay in the worker."""
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), pattern))

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _worker(shared)
        try:
            for texts in batches:
                n, ids_hash, text_hash = [], [], []
                for t in texts:
                    ids = codec.encode(t.as_py() or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(little(ids)).hexdigest())
                    text_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            common.tidy()

    return docs.withColumn("_d", run("text")).withColumns({c: F.col(f"_d.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_d")


def little(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return stage(spark, common.read(spark, sf_dir, "documents"), sf_dir, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each document's token count and digests, with its source and language, and its position in the files that ``docs`` are read from."""
    import public_tokenizers

    rows = common.positioned(docs, "doc_id", "source", "lang", "text")
    return digests(rows, path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")
