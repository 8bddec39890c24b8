"""Joins of tables that grow with the program they tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is dealt by key, however small its file: ids and names compress so well that a file which Spark takes for a small one, to be sent whole through the driver, is twenty times as large in memory."""
    return rows.hint("merge")


def spread_nulls(key: str | Column, *others: str | Column) -> Column:
    """``key`` of a left join, a text; where it is null, a text that equals no id or name, of ``others``: else all rows without a key are one task's."""
    return F.coalesce(key, F.concat_ws("\0", F.lit(""), *others))
