"""A running budget over rows in an order: a row is taken if it still fits, else it is passed over and later, smaller ones may fit.

What a block of rows takes depends on what is left when it begins, so a block is walked once for what it is given, in rounds: runs of blocks that fit whole are taken by their sums alone, and only
the first block that doesn't fit is walked. After it, no row that is larger than what is left can fit, so blocks without one that is small enough are passed over whole, by their smallest row. A budget that is used up
by B bytes in all ends the walk once nothing is as small as what is left. Each block that is walked takes a row at least, its smallest, and leaves less than the largest row that it passed over, so few are walked unless
each of very many blocks holds one tiny row among large ones. Rows of size 0 always fit.

Blocks are ranges of the order, and their summaries (sum, smallest row) are what a window sees; rows of a block are walked by an ordered fold in one task, bounded by BLOCK.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import numbered
from tracewell.storage import materialize

BLOCK = 4096  # rows that are walked at once, at most


def within_budget(rows: DataFrame, size: str, budget: int, *order: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``taken``: whether the row is within ``budget`` when rows are taken in ``order``, each that still fits. Null sizes are passed over; equal places in the order are told apart in any way.

    The driver holds the place of the walk and what is left, two numbers a round.
    """
    if budget < 0:
        raise ValueError("a budget is below zero")
    placed = numbered(rows.withColumn("_size", F.col(size).cast("long")), *order, name="_budget_at")
    placed = materialize(placed.withColumn("_block", F.floor(F.col("_budget_at") / block).cast("long")), "budget")
    sized = placed.where("_size > 0").select("_block", "_budget_at", "_size")
    blocks = materialize(sized.groupBy("_block").agg(F.sum("_size").alias("sum"), F.min("_size").alias("least"), F.max("_size").alias("most")), "budget-blocks")
    whole, walked, at, left = [], [], -1, budget
    while True:
        # of the blocks from here on that hold a row that may fit: the first that doesn't fit whole, with the sum of those before
        some = blocks.where((F.col("_block") > at) & (F.col("least") <= left))
        spread = some.withColumn("_range", F.floor(F.col("_block") / block))
        sums = spread.groupBy("_range").agg(F.sum("sum").alias("n"))  # a row for each BLOCK of blocks
        ahead = sums.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("ahead"))
        run = spread.join(ahead, "_range").withColumn("upto", F.col("ahead") + F.sum("sum").over(Window.partitionBy("_range").orderBy("_block")))
        over = run.where(F.col("upto") > left).agg(F.min(F.struct("_block", (F.col("upto") - F.col("sum")).alias("before"))).alias("first")).first()["first"]
        if over is None:
            whole.append((at, None, left))
            break
        whole.append((at, over["_block"], left))
        left, at = left - over["before"], over["_block"]
        inside = sized.where(F.col("_block") == at).agg(F.sort_array(F.collect_list(F.struct("_budget_at", "_size"))).alias("rows"))  # BLOCK rows at most
        step = lambda s, x: F.when(x["_size"] <= s["left"], F.struct((s["left"] - x["_size"]).alias("left"), F.array_append(s["taken"], x["_budget_at"]).alias("taken"))).otherwise(s)
        start = F.struct(F.lit(left).cast("long").alias("left"), F.array().cast("array<long>").alias("taken"))
        fold = materialize(inside.select(F.aggregate("rows", start, step).alias("s")), "budget-walk")
        left = fold.select("s.left").first()[0]
        walked.append(fold.select(F.explode("s.taken").alias("_budget_at")))
    fits = F.lit(False)
    for begin, end, rest in whole:
        here = (F.col("_block") > begin) & (F.col("least") <= rest)
        fits = fits | (here if end is None else here & (F.col("_block") < end))
    taken = sized.join(blocks.where(fits).select("_block"), "_block", "left_semi").select("_budget_at")
    for one in walked:
        taken = taken.unionByName(one)
    return placed.join(taken.withColumn("taken", F.lit(True)), "_budget_at", "left").withColumn("taken", F.coalesce("taken", F.col("_size") <= 0, F.lit(False))).drop("_budget_at", "_block", "_size")
