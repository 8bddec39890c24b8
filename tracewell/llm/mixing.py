"""Mixing sources to target weights by Pfair scheduling.

Each source is a task whose weight is its target share, and a block of its documents is a unit of work. Block j of a source of
share w is released at slot floor(j / w) and must be placed before slot ceil((j+1) / w). Each slot takes, of the released blocks, the one
with the earliest deadline (ties: the source of smaller name). As shares sum to one, all deadlines are met, so while no source has
run out each is always less than one block away from its exact share of the slots, however many sources, slots and blocks there are.
Shares are whole numbers of 2^-40, summing to one: what the last rounding leaves goes to the largest. A source's exact share is missed
by 2^-40 of the slots at most, times the number of sources for the largest.

No walk over the slots is made. Without what is pending before it, a range of slots places some of the blocks released in it, and leaves
others over. Blocks that come in pending could take any of its slots, so with them it places as many as it has slots, the earliest
deadlines of both, and the latest are left over. So a range is told by its number of placed blocks, the latest of them (one for each source is
enough, as each has one pending block at most) and those left over, and two neighbouring ranges make one. Ranges are joined FAN at a time,
level by level, and what is pending at the start of each follows from the top down: rounds by the logarithm of the slots, each over
arrays that grow with the sources alone.

All of it is DataFrame functions. Ranks within a source are counts of earlier buckets of a hash of the id plus a place
within the bucket, so a source that holds a third of all rows is dealt over many tasks. Positions follow from counts of documents by ranges of
slots.

A source that runs out leaves its later slots to others whose blocks are released, or empty; no document is dropped or repeated.

Defined cases: a null source is the empty one; target weights default to the square root of each source's count; with
given weights, sources without one come after all others in order of name; rows of one id are ordered by a hash of the
whole row; one source alone keeps the order of its hashes; an empty table stays so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell import storage

from . import common

BLOCK = 64  # documents
POWER = 0.5  # target weights are counts to this power, unless given
WHOLE = 1 << 40  # shares are whole parts of it
FAN = 64  # ranges of slots that make one of the next level
MOST_SOURCES = 4096  # more sources than this are an error: a range carries a block of each
BUCKET_ROWS = 4096
BROADCAST_BLOCKS = 100_000  # a larger schedule is joined by shuffling
CHUNK = 1 << 16  # blocks that are made, and slots that are counted, in one go

JOBS = "array<struct<d:bigint,k:int,j:bigint>>"  # blocks: deadline, source, number in its source
PLACED = "array<struct<slot:bigint,k:int,j:bigint>>"
STARTS = f"array<struct<s:bigint,a:{JOBS}>>"


def shares(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(src, n, k, q): k numbers the sources by name, q is a source's share in parts of WHOLE (0 without a weight, else 1 at least)."""
    if weights is None:
        rated = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        known = F.create_map(*(F.lit(x) for item in weights.items() for x in item)) if weights else F.create_map(F.lit(""), F.lit(0.0))
        rated = counts.withColumn("w", F.greatest(F.lit(0.0), F.coalesce(known[F.col("src")].cast("double"), F.lit(0.0))))
    whole = Window.partitionBy()  # MOST_SOURCES rows at most
    rated = rated.withColumn("k", (F.row_number().over(Window.orderBy("src")) - 1).cast("int"))
    share = F.col("w") / F.nullif(F.sum("w").over(whole), F.lit(0.0))
    rated = rated.withColumn("q", F.when(F.col("w") > 0, F.greatest(F.lit(1).cast("long"), F.floor(share * WHOLE).cast("long"))).otherwise(F.lit(0).cast("long")))
    first = F.row_number().over(Window.orderBy(F.desc("q"), "k")) == 1
    q = F.when(first & (F.col("q") > 0), F.col("q") + WHOLE - F.sum("q").over(whole)).otherwise(F.col("q"))
    return rated.select("src", "n", "k", q.alias("q"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(shared: DataFrame, block: int, tasks: int) -> DataFrame:
    """(s, job): each block of each source that has a weight, and the slot of its release."""
    last = F.floor((F.col("n") - 1) / block)
    chunks = shared.where("q > 0").select("k", "q", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(CHUNK).cast("long"))).alias("c"))
    each = chunks.repartition(tasks).select("k", "q", F.explode(F.sequence("c", F.least(F.col("last"), F.col("c") + CHUNK - 1))).alias("j"))
    part = f"CAST({WHOLE} AS DECIMAL(18, 0))"
    job = F.struct(F.expr(f"(CAST(j + 1 AS DECIMAL(18, 0)) * {part} + q - 1) div CAST(q AS DECIMAL(18, 0))").alias("d"), "k", "j")
    return each.select(F.expr(f"(CAST(j AS DECIMAL(18, 0)) * {part}) div CAST(q AS DECIMAL(18, 0))").alias("s"), job.alias("job"))


def late(jobs: Column, most: Column) -> Column:
    """The last ``most`` of sorted jobs."""
    return F.slice(jobs, F.size(jobs) - most + 1, most)


def left_over(node: Column, pending: Column) -> Column:
    """What is pending after a range of slots that ``pending`` came into."""
    over = F.greatest(F.lit(0).cast("long"), F.size(pending) + node["n"] - (node["e"] - node["s"])).cast("int")
    return F.concat(node["t"], let(F.array_sort(F.concat(pending, node["u"])), lambda pool: late(pool, over)))


def joined(left: Column, right: Column, most: int) -> Column:
    """Two ranges, the second right after the first, as one."""
    over = F.greatest(F.lit(0).cast("long"), F.size(left["t"]) + right["n"] - (right["e"] - right["s"])).cast("int")

    def made(x: Column) -> Column:
        placed = F.array_sort(F.concat(left["u"], F.slice(x["pool"], F.lit(1), F.size(x["pool"]) - x["over"])))
        u = let(placed, lambda p: late(p, F.least(F.size(p), F.lit(most))))
        n = left["n"] + right["n"] + F.size(left["t"]) - x["over"]
        return F.struct(left["s"].alias("s"), right["e"].alias("e"), n.alias("n"), u.alias("u"), F.concat(right["t"], late(x["pool"], x["over"])).alias("t"))

    return let(F.struct(F.array_sort(F.concat(left["t"], right["u"])).alias("pool"), over.alias("over")), made)


def summed(kids: Column, most: int) -> Column:
    """A range from its parts in order, with the slots between them, in which nothing is released."""

    def step(done: Column, kid: Column) -> Column:
        none = F.array().cast(JOBS)
        gap = F.struct(done["e"].alias("s"), kid["s"].alias("e"), F.lit(0).cast("long").alias("n"), none.alias("u"), none.alias("t"))
        return let(joined(done, gap, most), lambda x: joined(x, kid, most))

    return F.aggregate(F.slice(kids, F.lit(2), F.size(kids)), F.element_at(kids, 1), step)


def put(jobs: Column, at: Column) -> Column:
    """Jobs on consecutive slots from ``at``."""
    return F.transform(jobs, lambda x, i: F.struct((at + i).alias("slot"), x["k"].alias("k"), x["j"].alias("j")))


def opened(kids: Column, pending: Column, single: bool, last: bool) -> Column:
    """What is pending at the start of each part of a range, and what is placed between the parts; in parts that are a ``single`` slot, too,
    and after the ``last`` part of all."""

    def step(state: Column, kid: Column) -> Column:
        def made(x: Column) -> Column:
            cut = F.least(F.size(x), kid["s"] - state["e"]).cast("int")
            return let(F.slice(x, cut + 1, F.size(x)), lambda a: moved(a, put(F.slice(x, F.lit(1), cut), state["e"])))

        def moved(a: Column, between: Column) -> Column:
            placed = [state["placed"], between]
            if single:
                placed.append(put(F.array(F.array_min(F.concat(a, kid["u"]))), kid["s"]))
            starts = state["starts"] if single else F.array_append(state["starts"], F.struct(kid["s"].alias("s"), a.alias("a")))
            return F.struct(left_over(kid, a).alias("a"), kid["e"].alias("e"), starts.alias("starts"), F.concat(*placed).alias("placed"))

        return let(F.array_sort(state["a"]), made)

    start = F.struct(pending.alias("a"), F.element_at(kids, 1)["s"].alias("e"), F.array().cast(STARTS).alias("starts"), F.array().cast(PLACED).alias("placed"))

    def end(state: Column) -> Column:
        rest = put(F.array_sort(state["a"]), state["e"]) if last else F.array().cast(PLACED)
        return F.struct(state["starts"].alias("starts"), F.concat(state["placed"], rest).alias("placed"))

    return F.aggregate(kids, start, step, end)


def schedule(shared: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, k, j): the slot of each block of each source that has a weight."""
    spark = shared.sparkSession
    known = [(r.n, r.q) for r in shared.where("q > 0").collect()]  # MOST_SOURCES rows at most
    if not known:
        return spark.createDataFrame([], "slot long, k int, j long")
    most, horizon = len(known), max((n - 1) // block * WHOLE // q for n, q in known)
    tasks = min(4096, 1 + sum(1 + n // block for n, _ in known) // 4096)
    single = blocks(shared, block, tasks).withColumn("g", F.expr(f"s div {FAN}")).repartition(tasks, "g")
    single = single.groupBy("g", "s").agg(F.array_sort(F.collect_list("job")).alias("x"))
    node = F.struct("s", (F.col("s") + 1).alias("e"), F.lit(1).cast("long").alias("n"), F.slice("x", 1, 1).alias("u"), F.slice("x", F.lit(2), F.size("x")).alias("t"))
    levels, width, rows = [], FAN, single.select("g", node.alias("node"))
    while True:
        levels.append(storage.materialize(rows.groupBy("g").agg(F.array_sort(F.collect_list("node")).alias("kids")), "mix-up"))
        if width > horizon:
            break
        rows = levels[-1].select(F.expr(f"g div {FAN}").alias("g"), summed(F.col("kids"), most).alias("node"))
        width *= FAN
    pending, placed = levels[-1].select(F.col("g").alias("at"), F.array().cast(JOBS).alias("a")), []
    for k in reversed(range(len(levels))):
        found = levels[k].join(pending, F.col("g") == F.col("at")).select(opened(F.col("kids"), F.col("a"), k == 0, k == len(levels) - 1).alias("o"))
        found = storage.materialize(found.select("o.*"), "mix-down")
        placed.append(found.select(F.explode("placed").alias("p")).select("p.*"))
        pending = found.select(F.explode("starts").alias("s")).select(F.expr(f"s.s div {FAN ** k}").alias("at"), F.col("s.a").alias("a")) if k else None
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    return whole


def turns(shared: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k, j, slot, ahead): the slot of each block of each source, and the documents of all sources in earlier slots."""
    placed = schedule(shared, block).join(F.broadcast(shared.select(F.col("k").alias("k2"), "n")), F.col("k") == F.col("k2"))  # a row for each source
    placed = placed.select("k", "j", "slot", F.least(F.lit(block), F.col("n") - F.col("j") * block).alias("docs"), F.expr(f"slot div {CHUNK}").alias("c"))
    sums = placed.groupBy("c").agg(F.sum("docs").alias("docs"))
    sums = sums.select(F.col("c").alias("c2"), (F.sum("docs").over(Window.orderBy("c")) - F.col("docs")).alias("before"))  # a row for each CHUNK slots
    inner = F.sum("docs").over(Window.partitionBy("c").orderBy("slot")) - F.col("docs")
    return placed.withColumn("inner", inner).join(sums, F.col("c") == F.col("c2")).select("k", "j", "slot", (F.col("before") + F.col("inner")).alias("ahead"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with mix_block (of its source), mix_slot and mix_pos (its place in the whole mixture, from 0); its own columns of these names go."""
    cols = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_pos")]
    whole = spread(docs, weights, block)
    return whole.select(*(F.col("doc").getField(c).alias(c) for c in cols), "mix_block", "mix_slot", "mix_pos")


def spread(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(doc, mix_block, mix_slot, mix_pos): each row of ``docs`` as a struct, so that its columns may have any names, and its place."""
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("source"), F.lit("")).alias("src"), F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.xxhash64("*").alias("tie"))
    counted = rows.groupBy("src").agg(F.count("*").alias("n")).orderBy("src").limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not counted:
        return rows.select("doc", *(F.lit(None).cast("long").alias(c) for c in ("mix_block", "mix_slot", "mix_pos")))
    counts = docs.sparkSession.createDataFrame([(r.src, r.n) for r in counted], "src string, n long")
    shared = shares(counts, weights)

    digits = next((d for d in range(1, 9) if max(r.n for r in counted) // 16**d <= BUCKET_ROWS), 9)
    rows = rows.withColumn("b", F.substring("h", 1, digits))
    earlier = rows.groupBy("src", "b").agg(F.count("*").alias("n"))
    earlier = earlier.select(F.col("src").alias("s2"), F.col("b").alias("b2"), (F.sum("n").over(Window.partitionBy("src").orderBy("b")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("src", "b").orderBy("h", F.col("id").asc_nulls_first(), "tie"))
    ranked = rows.withColumn("place", place).join(earlier, (F.col("src") == F.col("s2")) & (F.col("b") == F.col("b2"))).withColumn("rank", F.col("before") + F.col("place") - 1)

    # without a weight: after all that have one, and after such sources of an earlier name
    every = F.array_sort(F.collect_list(F.struct("k", "n", "q")).over(Window.partitionBy()))
    earlier = F.transform(every, lambda s: F.when((s["q"] > 0) | (s["k"] < F.col("k")), s["n"]).otherwise(F.lit(0).cast("long")))
    source = F.broadcast(shared.select(F.col("src").alias("s3"), "k", F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x).alias("late")))  # a row for each source
    turn = turns(shared, block).select(F.col("k").alias("tk"), "j", "slot", "ahead")  # a row for each block
    if sum(-(-r.n // block) for r in counted) <= BROADCAST_BLOCKS:
        turn = F.broadcast(turn)
    found = ranked.join(source, F.col("src") == F.col("s3")).withColumn("mix_block", F.floor(F.col("rank") / block))
    found = found.join(turn, (F.col("k") == F.col("tk")) & (F.col("mix_block") == F.col("j")), "left")
    position = F.coalesce(F.col("ahead") + F.col("rank") % block, F.col("late") + F.col("rank"))
    return found.select("doc", F.col("mix_block").cast("long").alias("mix_block"), F.col("slot").cast("long").alias("mix_slot"), position.cast("long").alias("mix_pos"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents").select("doc_id", "source"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture: files, and rows within them, follow mix_pos. Columns may have any names."""
    return spread(docs).repartitionByRange("mix_pos").sortWithinPartitions("mix_pos").select("doc.*")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS src, source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents),
  c AS (SELECT src, count(*) AS n FROM d GROUP BY src),
  v AS (SELECT src, n, row_number() OVER (ORDER BY src) AS k, greatest(1, CAST(floor(sqrt(n) / sum(sqrt(n)) OVER () * {WHOLE}) AS BIGINT)) AS q FROM c),
  w AS (SELECT src, n, k, CAST(CASE WHEN row_number() OVER (ORDER BY q DESC, k) = 1 THEN q + {WHOLE} - sum(q) OVER () ELSE q END AS BIGINT) AS q FROM v),
  a AS (SELECT list(q ORDER BY k) AS q, list(n ORDER BY k) AS n, count(*) AS m FROM w),
  s AS (
    SELECT CAST(0 AS BIGINT) AS t, list_transform(range(m), lambda x: 0::BIGINT) AS done, CAST(0 AS BIGINT) AS pick FROM a
    UNION ALL
    SELECT t + 1, list_transform(range(1, m + 1), lambda i: done[i] + CAST(i = best AS BIGINT)), best FROM (
      SELECT s.t, s.done, a.m, coalesce(list_min(list_transform(list_filter(range(1, m + 1), lambda i: done[i] * {BLOCK} < n[i] AND done[i] * {WHOLE} // q[i] <= t), lambda i: ((done[i] + 1) * {WHOLE} + q[i] - 1) // q[i] * 10000 + i)) % 10000, 0) AS best
      FROM s, a WHERE list_bool_or(list_transform(range(1, m + 1), lambda i: done[i] * {BLOCK} < n[i])))),
  turn AS (SELECT x.t AS slot, y.pick AS k, x.done[y.pick] AS j, x.done AS done FROM s x JOIN s y ON y.t = x.t + 1 WHERE y.pick > 0)
SELECT d.doc_id, d.source, d.r // {BLOCK} AS mix_block, turn.slot AS mix_slot,
  CAST(list_sum(list_transform(range(1, a.m + 1), lambda i: least(a.n[i], {BLOCK} * turn.done[i]))) + d.r % {BLOCK} AS BIGINT) AS mix_pos
FROM d JOIN w USING (src) CROSS JOIN a JOIN turn ON turn.k = w.k AND turn.j = d.r // {BLOCK}"""
