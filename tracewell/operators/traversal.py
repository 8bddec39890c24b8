"""Bounded reachability from many roots, level by level, with attribution to each root.

State is a relation (node, bucket, depth, a set for each tier): which roots of a bucket of PACKED first reach the node at that level over edges of up to that
tier, as bits of a number. By which edge the nearest of them comes is looked up once, at the end. So a node has a row for each PACKED roots at most and level that adds some, one pass tells all tiers, and sets are joined and told apart by the bit. A level is one join of the frontier with the
adjacency and one aggregation with the levels before; each level is written once, so lineage stays short and a lost
executor costs no more than a level. Nothing but the size of a frontier comes to the driver. No root is left out, however many are listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.edges import MODES, TIERS, adjacency
from tracewell.operators.joins import by_key
from tracewell.storage import drop, materialize

MOST_DEPTH, MOST_REACHED, MOST_ROOTS = 128, 100_000, 10_000  # fixed values: bounds of a request
COMPACTED = 8  # levels after which those before are written as one table
KEPT_ROOTS = 64  # fixed value: roots that are listed for a node
FEW = 200_000  # rows of a frontier that all tasks are sent, so that the adjacency needn't be dealt
PACKED = 60  # roots whose bits are one number; less than 63, as the lowest bit is found by arithmetic
MOST_UNRESOLVED = 1_000_000  # fixed value: the largest count of open calls that is shown


@dataclass(frozen=True)
class Reached:
    """``rows`` as reached, in order, and ``meta``: one row of what was cut short."""

    rows: DataFrame
    meta: DataFrame


def utf16(column: Column) -> Column:
    """Sorts strings by UTF-16 code units."""
    return F.encode(column, "UTF-16BE")


def number_roots(ids: DataFrame, id_column: str = "id", position: str = "pos") -> DataFrame:
    """(root_idx, id): the first place of each id, numbered from 0 without gaps. Roots are few: MOST_ROOTS at most."""
    first = ids.groupBy(F.col(id_column).alias("id")).agg(F.min(position).alias("pos"))
    return first.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("root_idx"), "id")


def propagate(near: DataFrame, roots: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame | None]:
    """((node, root_idx, depth, tier) rows, the last frontier if the depth bound stopped it), for roots of any name, a row for each that a node has.

    Of a node and root, the first row has the least depth; a later one has a stronger tier than all before: that of the weakest edge on
    the way, for the best way of that many steps.
    """
    at = materialize(roots.select(F.col("id").alias("node"), "root_idx", F.lit(0).alias("depth"), F.lit(0).alias("tier")), "level")
    seen, parts = at, [at]
    for depth in range(1, max_depth + 1):
        step = at.withColumnRenamed("tier", "so_far").join(by_key(near), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "root_idx").agg(F.min(F.greatest("so_far", "tier")).alias("tier"))
        old = seen.select(F.col("node").alias("n"), F.col("root_idx").alias("r"), F.col("tier").alias("t"))
        new = step.join(by_key(old), (F.col("node") == F.col("n")) & (F.col("root_idx") == F.col("r")) & (F.col("t") <= F.col("tier")), "left_anti")
        at = materialize(new.select("node", "root_idx", F.lit(depth).alias("depth"), "tier"), "level")
        if at.isEmpty():
            return seen, None
        seen, parts = seen.unionByName(at), [*parts, at]
        if len(parts) > COMPACTED:
            seen = materialize(seen, "levels")
            drop(*parts[:-1])
            parts = [seen]
    return seen, at


def _bit(root: Column) -> tuple[Column, Column]:
    return F.floor(root / PACKED).cast("int").alias("bucket"), F.call_function("shiftleft", F.lit(1).cast("long"), (root % PACKED).cast("int")).alias("bit")


def _onward(at: DataFrame, near: DataFrame) -> DataFrame:
    """``at`` with each of its nodes' edges: a short frontier goes to all tasks, a long one is dealt with the edges and neither is sorted."""
    frontier = F.broadcast(at) if at.limit(FEW + 1).count() <= FEW else at.hint("shuffle_hash")
    return near.join(frontier, F.col("node") == F.col("src"))


def spread(near: DataFrame, roots: DataFrame, max_depth: int | None, weakest: int) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """((node, bucket, depth, b0, ...) rows, the tables they are in, the last frontier if the depth bound stopped it): the roots that are new to a node at a level, for each tier over whose edges, and stronger ones, they come.

    Level 0 holds a root's own bit, which comes at no other level. Rows are numbers beside the node, so edges are combined in hash tables as they come.
    """
    sets = [f"b{t}" for t in range(weakest + 1)]
    none = F.lit(0).cast("long")
    start = roots.select(F.col("id").alias("node"), *_bit(F.col("root_idx"))).groupBy("node", "bucket").agg(F.bit_or("bit").alias("bit"))
    at = materialize(start.select("node", "bucket", F.lit(0).alias("depth"), *(F.col("bit").alias(b) for b in sets)), "level")
    seen, parts = at, [at]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        met = _onward(at.select("node", "bucket", *sets), near.select("src", "dst", "tier"))
        come = met.select(F.col("dst").alias("node"), "bucket", *(F.when(F.col("tier") <= t, F.col(b)).otherwise(none).alias(b) for t, b in enumerate(sets)), *(none.alias(f"old_{b}") for b in sets))
        both = come.unionByName(seen.select("node", "bucket", *(none.alias(b) for b in sets), *(F.col(b).alias(f"old_{b}") for b in sets)))
        new = both.groupBy("node", "bucket").agg(*(F.bit_or(b).bitwiseAND(F.bitwise_not(F.bit_or(f"old_{b}"))).alias(b) for b in sets))
        at = materialize(new.where(" OR ".join(f"{b} <> 0" for b in sets)).select("node", "bucket", F.lit(depth).alias("depth"), *sets), "level")
        if at.isEmpty():
            return seen, [*parts, at], None
        seen, parts = seen.unionByName(at), [*parts, at]
        if len(parts) > COMPACTED:
            seen = materialize(seen, "levels")
            drop(*parts[:-1])
            parts = [seen, at]
    return seen, parts, at


def _asked(near: DataFrame, steps: DataFrame, all_: str) -> DataFrame:
    """(src, dst, kinds, level, bucket, bit): each edge of a node that is reached, with the level of its nearest root and that root's bit."""
    bits = F.col(all_)
    nearest = F.col("bucket") * PACKED + F.bit_count(bits.bitwiseAND(-bits) - 1)
    came = steps.where((F.col("depth") > 0) & (bits != 0))
    first = came.groupBy("node").agg(F.min(F.col("depth").cast("long") * (1 << 31) + nearest).alias("first"))  # one number: hash tables hold it
    first = first.select(F.col("node").alias("dst"), (F.col("first") / (1 << 31)).cast("int").alias("level"), *_bit(F.col("first") % (1 << 31)))
    return near.select("src", "dst", "kinds").join(first, "dst")


def _ways(asked: DataFrame, steps: DataFrame, all_: str) -> DataFrame:
    """(node, depth, via, kinds): by which of the edges ``asked`` the nearest root first comes to each node: its level, and of the nodes one level nearer to that root the first by UTF-16."""
    held = steps.where(F.col(all_) != 0).select(F.col("node").alias("src"), "bucket", (F.col("depth") + 1).alias("level"), all_)
    ends = asked.join(held, ["src", "bucket", "level"]).where(F.col(all_).bitwiseAND(F.col("bit")) != 0)
    way = ends.groupBy("dst", "level").agg(F.min(F.struct(utf16(F.col("src")).alias("key"), F.col("src").alias("via"), "kinds")).alias("way"))
    return way.select(F.col("dst").alias("node"), F.col("level").alias("depth"), "way.via", "way.kinds")


def _checked(dispatch: str, max_depth: int | None, max_reached: int | None) -> int:
    if dispatch not in MODES:
        raise ValueError(f"unknown dispatch {dispatch}")
    if not ((max_depth is None or 1 <= max_depth <= MOST_DEPTH) and (max_reached is None or 1 <= max_reached <= MOST_REACHED)):
        raise ValueError("a bound is out of range")
    return MODES[dispatch]


def traverse(nodes: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "dependencies", dispatch: str = "direct", max_depth: int = MOST_DEPTH, max_reached: int = MOST_REACHED) -> Reached:
    """What ``roots`` (root_idx, id) reach over merged ``edges``.

    Rows: id, via, depth, roots (first KEPT_ROOTS, ascending), relationships, evidence, n_roots (all of them). ``via`` is the first node, by UTF-16, one level
    nearer to the nearest root; evidence is the strongest tier over which every reaching root still reaches the node.
    """
    return traverse_near(nodes, adjacency(edges, direction, _checked(dispatch, max_depth, max_reached)), roots, dispatch, max_depth, max_reached)


def traverse_near(nodes: DataFrame, adjacent: DataFrame, roots: DataFrame, dispatch: str = "direct", max_depth: int | None = MOST_DEPTH, max_reached: int | None = MOST_REACHED) -> Reached:
    """``traverse`` over (src, dst, kinds, tier), a row for each pair, of the tiers that ``dispatch`` follows. None for a bound of a request: there is none."""
    weakest = _checked(dispatch, max_depth, max_reached)
    roots = materialize(roots.select("root_idx", "id"), "roots")
    ids = nodes.select("id").join(roots.select("id"), "id", "left_semi").distinct()  # the few nodes that are roots
    known = materialize(roots.join(ids, "id", "left_semi"), "known")
    missing = roots.join(known, "id", "left_anti")
    near = materialize(adjacent, "adjacency")
    steps, parts, frontier = spread(near, known, max_depth, weakest)
    sets = [f"b{t}" for t in range(weakest + 1)]
    all_ = sets[-1]

    cut = F.lit(False)
    if frontier is not None:
        levels = steps.groupBy("node", "bucket").agg(F.bit_or(all_).alias("known"))
        onward = _onward(frontier.select("node", "bucket", all_), near).groupBy(F.col("dst").alias("node"), "bucket").agg(F.bit_or(all_).alias("more"))
        left = onward.join(levels, ["node", "bucket"], "left").where(F.col("more").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))) != 0)
        cut = F.lit(not left.isEmpty())

    # dealt by node once: its buckets, and then the node
    others = F.bit_or(F.when(F.col("depth") > 0, F.col(all_)).otherwise(0)).alias("bits")
    levels = steps.repartition("node").groupBy("node", "bucket").agg(*(F.bit_or(b).alias(b) for b in sets), others)
    # the strongest tier whose set is the whole one, in the bucket that is hardest to reach
    strongest = F.coalesce(*(F.when(F.col(b) == F.col(all_), F.lit(t)) for t, b in enumerate(sets)))
    held = F.slice(F.sort_array(F.collect_list(F.when(F.col("bits") != 0, F.struct("bucket", "bits")))), 1, KEPT_ROOTS)
    told = levels.groupBy("node").agg(F.max(strongest).alias("tier"), F.sum(F.bit_count("bits")).alias("n_roots"), held.alias("held")).where("n_roots > 0")
    # in two steps, so that a disk holds the edges dealt by one end at a time
    asked = materialize(_asked(near, steps, all_), "asked")
    drop(near)
    told = materialize(told.join(_ways(asked, steps, all_), "node"), "told")
    drop(asked, *parts)
    places = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(PACKED - 1)), lambda i: x["bits"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0), lambda i: (x["bucket"] * PACKED + i).cast("int"))
    listed = F.slice(F.flatten(F.transform("held", places)), 1, KEPT_ROOTS)

    # the strongest tier over which as many roots reach the node as over all
    evidence = F.get(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    ordered = told.select(F.col("node").alias("id"), "via", "depth", "held", F.col("kinds").alias("relationships"), evidence.alias("evidence"), "n_roots")
    kept = ordered.orderBy("depth", utf16(F.col("id")))
    kept = (kept if max_reached is None else kept.limit(max_reached)).select("id", "via", "depth", listed.alias("roots"), "relationships", "evidence", "n_roots")
    meta = (
        ordered.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("n_roots") > KEPT_ROOTS), F.lit(False)).alias("roots_truncated"))
        .withColumn("depth_cut", cut)
        .withColumn("max_reached_cut", F.lit(False) if max_reached is None else F.col("n") > max_reached)
        .withColumn("root_not_found", F.lit(not missing.isEmpty()))
    )
    reasons = F.array_compact(F.array(F.when(F.col("depth_cut"), "depth"), F.when(F.col("max_reached_cut"), "max-reached"), F.when(F.col("root_not_found"), "root-not-found")))
    meta = meta.select((F.size(reasons) > 0).alias("truncated"), F.array_join(reasons, ",").alias("reasons"), "roots_truncated", (F.col("n") if max_reached is None else F.least(F.col("n"), F.lit(max_reached))).alias("n_reached"))
    return Reached(kept, meta)


def with_unresolved(rows: DataFrame, counts: DataFrame, mode: str) -> DataFrame:
    """Adds each reached node's open calls, up to MOST_UNRESOLVED; null for none."""
    n = F.least(F.col(f"mode_{mode}"), F.lit(MOST_UNRESOLVED))
    return rows.join(counts.select(F.col("node").alias("id"), F.when(n > 0, n).alias("unresolved_calls")), "id", "left")


def closure(pairs: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    """(node, root, depth): everything each node is above in (child, parent) pairs, at its least distance, itself not included."""
    near = materialize(pairs.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(0).alias("tier")).distinct(), "closure")
    roots = near.select(F.col("src").alias("id")).distinct().withColumn("root_idx", F.col("id"))
    levels, _ = propagate(near, roots, most)
    return levels.where("node <> root_idx").select("node", F.col("root_idx").alias("root"), "depth")
