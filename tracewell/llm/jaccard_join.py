"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles. Two sets of similarity t share at least ceil(t * n) shingles, so in any one
global order their first n - ceil(t * n) + l shingles share at least l. Each document takes the l of least estimated cost,
from how many others hold the shingles of its prefix: a longer prefix is more to probe, but a pair must then share more of it before it is
verified. A pair must share the smaller of both documents' l, and within the shorter prefixes that the sizes of the two allow; and small bitmaps of
the sets must not differ in more places than similar sets can.

The order is by frequency, rarest first, which keeps most prefixes free of shingles that others have. Counting all shingles of a
corpus for it would be dear, so it goes in two exact steps. First, a quarter of all shingles, by their hash, are counted, and an order that has them first
leaves out every document whose prefix no other document touches. Then the whole sets of those that are left are counted and indexed.

Documents of equal sets are one class, and classes take part once. Links matter for components, so pairs that are already connected
need not be verified. Rounds of stars find most: in each shingle's bucket every member is compared with one pivot, which is
linear in the bucket. A round's pairs must share the prefix shingles that their l ask for, and only buckets that still
hold several components go on to the next round. Then all pairs of different components that are left, by buckets, are verified, exactly. A group of
thousands of near copies is a few stars, not its square.

Defined cases: null and empty texts, and those of white space alone, have no shingles and no links; with fewer words than a
shingle takes, the whole sequence is one. Rows with the same id are one document: a link of any is a link of all. A row without an id links with
nothing and has no component. Texts are whole, however long; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import storage

from . import common
from .components import components

SEPARATORS = b" \t\n\x0b\x0c\r"
WORDS = 4
PERCENT = 85
SAMPLED = np.uint64(1 << 62)  # hashes below this have their frequencies counted
MOST_MATCHES = 4  # the largest l that is tried
VERIFY_COST = 8.0  # of verifying a candidate, against reading one posting
STARS = 4  # rounds of stars, at most
BITS = 512  # of a set's bitmap
FEW = 8  # after a round of stars, all pairs are looked at once they are fewer than so many for each posting of the whole index
BROADCAST_IDS = 500_000  # a list of ids up to this goes to all tasks, so that texts needn't be shuffled; a longer one is joined by shuffling
STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(column: pa.Array, words: int = WORDS):
    """Sorted hashes of the distinct shingles of each text, in order; lower-cases A to Z alone."""
    folded, kinds = common.word_table(SEPARATORS, lower=True)
    for _, offsets, data in common.text_chunks(column):
        hashes, first = common.hashed_runs(offsets, data, folded, kinds)
        n = len(hashes) - words + 1
        runs = np.zeros(0, np.uint64)
        if n > 0:
            runs = sum((hashes[k : n + k] * STEP[k] for k in range(1, words)), hashes[:n] * STEP[0])
            runs = common.mix(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                yield common.mix((hashes[a:b] * STEP[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield runs[:0]


def needed(n, percent: int = PERCENT):
    """Least overlap that a set of n can have with any that it links to."""
    return (percent * n + 99) // 100


def fingerprint(own: np.ndarray) -> int:
    """Of a whole set, 64 bits."""
    return int(common.mix(own + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).astype(np.int64))


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, a, b, sample): size and 128-bit fingerprint of each set, and those of its shingles that are counted first."""

    def run(batches):
        for batch in batches:
            n, a, b, lengths, parts = [], [], [], [], []
            for own in shingles(batch.column("text"), words):
                below = int(np.searchsorted(own, SAMPLED))
                n.append(len(own))
                a.append(fingerprint(own))
                b.append(int(common.mix(own ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).astype(np.int64)))
                lengths.append(below)
                parts.append(own[:below].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            sample = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), sample], names=["doc_id", "n", "a", "b", "sample"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidied(run), "doc_id long, n long, a long, b long, sample array<long>")


def room(n: Column, percent: int = PERCENT) -> Column:
    """How many shingles of a set of n a partner may lack: n - ceil(t * n)."""
    return n - F.floor((percent * n + 99) / 100).cast("long")


def touched(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rep) of the classes that can have a partner: sampled shingles first and rarest first, some shingle of the prefix is another's too, or not counted."""
    tokens = reps.select("rep", F.explode("sample").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1").select("token")
    shared = tokens.join(often, "token").groupBy("rep").agg(F.count("*").alias("m"))
    sizes = reps.select("rep", "n", F.size("sample").alias("s"))
    few = F.col("s") <= room(F.col("n"), percent)
    near = F.col("s") - F.col("m") <= room(F.col("n"), percent)
    return sizes.join(shared, "rep", "left").where(few | F.coalesce(near, F.lit(False))).select("rep").distinct()


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, rep, a, n, at, l): each set's prefix, of the length that its estimated cost asks for, with places in it from 0.

    Shingles of one set alone come first in the order and need no row.
    """
    tokens = sets.select("token", "rep", "a", "n")
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("rep", "a")
    shared = tokens.join(often, "token").withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("f", "token")) - 1)
    free = room(F.col("n"), percent)
    near = shared.where(F.col("at") < free + MOST_MATCHES)
    cost = F.array(*(F.struct((F.sum(F.when(F.col("at") < free + k, F.col("f") - 1).otherwise(0)).over(own) * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("l")) for k in range(1, MOST_MATCHES + 1)))
    allowed = F.filter(cost, lambda c: (c["l"] == 1) | (c["l"] <= F.col("n") - free))
    return near.withColumn("l", F.array_min(allowed)["l"]).where(F.col("at") < free + F.col("l")).select("token", "rep", "a", "n", "at", "l")


def verified(pairs: DataFrame, heads: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (u, v) of ``pairs`` (u, ua, v, va) whose sets are similar enough.

    First, their prefixes must share as many shingles as the less asking of both wants, and their bitmaps (a bit is set where
    an odd number of shingles fall on it) must not differ in more bits than similar sets can in shingles. Only what is left takes
    the whole sets to be counted exactly.
    """

    bits = [f"b{i}" for i in range(BITS // 64)]
    left = heads.select(F.col("rep").alias("u"), F.col("a").alias("ua"), "n", "l", "prefix", *bits)
    right = heads.select(F.col("rep").alias("v"), F.col("a").alias("va"), F.col("n").alias("m"), F.col("l").alias("k"), F.col("prefix").alias("other"), *(F.col(b).alias(f"c{b[1:]}") for b in bits))
    matches = F.size(F.array_intersect("prefix", "other")) >= F.least("l", "k")
    asked = pairs.join(left, ["u", "ua"]).join(right, ["v", "va"]).where(matches & F.expr(_alike(percent))).select("u", "ua", "v", "va")
    whole = asked.join(sets.select(F.col("rep").alias("u"), F.col("a").alias("ua"), F.col("own").alias("x")), ["u", "ua"])
    whole = whole.join(sets.select(F.col("rep").alias("v"), F.col("a").alias("va"), F.col("own").alias("y")), ["v", "va"])
    # a pair at a time, in the JVM: batches of whole sets would have no bound in bytes
    both = F.size(F.array_intersect("x", "y"))
    return whole.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("u", "v").distinct()


def _overlap(percent: int) -> str:
    return f"ceil({percent} * (n + m) / {100 + percent}.0)"


def _fits(percent: int) -> str:
    """Two sizes can be similar enough, and a shared shingle stands early enough in both for the least of their l."""
    early = f"at < n - {_overlap(percent)} + least(l, k) AND bt < m - {_overlap(percent)} + least(l, k)"
    return f"100 * least(n, m) >= {percent} * greatest(n, m) AND {early}"


def _alike(percent: int) -> str:
    """Bitmaps differ in no more bits than similar sets can in shingles."""
    return " + ".join(f"bit_count(b{i} ^ c{i})" for i in range(BITS // 64)) + f" <= n + m - 2 * {_overlap(percent)}"


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parities of the shingles on each of BITS places, as 64-bit integers."""
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def linked(index: DataFrame, heads: DataFrame, sets: DataFrame, percent: int = PERCENT, stars: int = STARS) -> DataFrame | None:
    """(node, component) of all classes that have a link; None if none has.

    Each round looks only at the buckets that still hold several components, and only their postings go on to the next.
    """
    work, known, size, old = index.withColumn("c", F.col("rep")), None, index.count(), []
    for turn in range(stars + 1):
        # buckets of several components, their pairs across (counted and not made), and the component with most members
        each = work.groupBy("token", "c").agg(F.count("*").alias("k"))
        mixed = each.groupBy("token").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("p"), F.max(F.struct("k", "c"))["c"].alias("most")).where("p > 0")
        mixed = common.materialize(mixed, "jaccard-mixed")
        left = mixed.agg(F.sum("p")).first()[0] or 0
        if not left:
            storage.drop(mixed, *old)
            return known
        work = common.materialize(work.join(mixed.select("token", "most"), "token"), "jaccard-work")
        storage.drop(mixed, *old)
        last = turn == stars or (turn > 0 and left <= FEW * size)
        found = _all_pairs(work, heads, percent) if last else _star_pairs(work, turn, percent)
        links = verified(found, heads, sets, percent)
        if known is not None:
            links = links.union(known.where("node <> component").select("node", "component"))
        before, known = known, common.materialize(components(links), "components")
        storage.drop(before)
        if last:
            storage.drop(work)
            return known
        old = [work]
        work = work.drop("c", "most").join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    return known


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, a narrow table, for a join with texts: sent to all tasks if it is short enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _pairs(met: DataFrame) -> list[Column]:
    """(u, ua, v, va) of sets (rep, a) and (y, ya), the smaller name first."""
    first = F.col("rep") < F.col("y")
    return [F.least("rep", "y").alias("u"), F.when(first, F.col("a")).otherwise(F.col("ya")).alias("ua"), F.greatest("rep", "y").alias("v"), F.when(first, F.col("ya")).otherwise(F.col("a")).alias("va")]


def _star_pairs(work: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a bucket with its pivot, if they are in different components."""
    rank = F.col("at") if turn == 0 else F.xxhash64("rep", F.lit(turn))  # the first pivots are the members with the least that is theirs alone
    pivot = F.min(F.struct(rank.alias("h"), F.col("rep").alias("y"), F.col("a").alias("ya"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("l").alias("k"), F.col("c").alias("d")))
    pivots = work.groupBy("token").agg(pivot.alias("x")).select("token", "x.y", "x.ya", "x.m", "x.bt", "x.k", "x.d")
    met = work.join(pivots, "token").where("c <> d AND rep <> y AND " + _fits(percent))
    return met.select(*_pairs(met)).distinct()


def _all_pairs(work: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that share as many early prefix shingles as the less asking of both wants.

    One of a pair is outside the bucket's largest component, so a bucket costs its size times its few strays.
    """
    bits = [f"b{i}" for i in range(BITS // 64)]
    there = work.join(heads.select("rep", "a", *bits), ["rep", "a"])
    x = there.where("c <> most")
    y = there.select("token", F.col("rep").alias("y"), F.col("a").alias("ya"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("l").alias("k"), F.col("c").alias("d"), *(F.col(b).alias(f"c{b[1:]}") for b in bits))
    met = x.join(y, "token").where(f"c <> d AND rep <> y AND (d = most OR rep < y) AND {_fits(percent)} AND {_alike(percent)}")
    enough = met.groupBy(*_pairs(met)).agg(F.count("*").alias("both"), F.min(F.least("l", "k")).alias("least")).where("both >= least")
    return enough.select("u", "ua", "v", "va")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs`` (doc_id, text)."""
    drawn = common.materialize(sketch(docs, words), "jaccard-sets")
    rows = common.materialize(drawn.drop("sample"), "jaccard-sizes")
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))
    reps = drawn.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["a", "b", "n"]).where("doc_id = rep").select("rep", "n", "sample")
    wanted = common.materialize(touched(reps, percent), "jaccard-touched")
    storage.drop(drawn)

    def whole(batches):
        for batch in batches:
            own = list(shingles(batch.column("text"), words))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)))
            bits = np.stack([bitmap(x) for x in own]) if own else np.zeros((0, BITS // 64), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([fingerprint(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), listed, *(pa.array(bits[:, i]) for i in range(BITS // 64))], names=["rep", "a", "n", "own", *(f"b{i}" for i in range(BITS // 64))])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(_few(wanted), "rep", "left_semi")
    bits = [f"b{i}" for i in range(BITS // 64)]
    made = texts.mapInArrow(common.tidied(whole), "rep long, a long, n long, own array<long>, " + ", ".join(f"{b} long" for b in bits)).where("n > 0")
    repeats = some.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    if not repeats.isEmpty():  # an id's equal texts are one set
        made = made.dropDuplicates(["rep", "a"])
    sets = common.materialize(made, "jaccard-whole")
    index = common.materialize(prefixes(sets.select("rep", "a", "n", F.explode("own").alias("token")), percent), "jaccard-prefixes")
    heads = index.groupBy("rep", "a").agg(F.first("l").alias("l"), F.collect_list("token").alias("prefix"))  # of one set
    heads = common.materialize(sets.select("rep", "a", "n", *bits).join(heads, ["rep", "a"]), "jaccard-heads")
    known = linked(index, heads, sets, percent)
    # rows of one id are one node: the least name of its classes
    each = some.select("doc_id", "a", "b", "n").join(classes, ["a", "b", "n"]).select("doc_id", "rep").distinct()
    named = each.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    if known is None:
        known = named.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    more = each.join(named.withColumnRenamed("rep", "least"), "doc_id").where("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v"))
    if not more.isEmpty():  # ids with several texts tie all their classes together
        known = components(known.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    placed = named.join(known, named.rep == known.node, "left").select(F.col("doc_id").alias("_id"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(placed, F.col("doc_id") == F.col("_id"), "left")
    out = common.materialize(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")), "jaccard")
    storage.drop(rows, wanted, sets, index, heads, known)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one of the smallest id. Documents without shingles or without an id stay.

    Of rows that repeat the id that stays, one stays, the least by a hash of the row. Columns may have any names; an empty table stays so.
    """
    cols = docs.columns
    told = join(docs.select("doc_id", "text"), words, percent)
    gone = told.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(_few(gone), "doc_id", "left_anti").select(*cols)
    again = told.where("doc_id IS NOT NULL AND doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    twice = kept.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("*").alias("h")).join(again.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    once = twice.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("h"))).where("place = 1").select("doc.*")
    return kept.join(again, "doc_id", "left_anti").select(*cols).unionByName(once)
