"""Names for helper columns that a caller's table doesn't use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def first_rows(df: DataFrame, per: Sequence[str | Column], order: Sequence[str | Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in the given order, which should be total."""
    rank = free_name(df, "rank")
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return numbered.where(F.col(rank) <= k).drop(rank)


def row_digest(df: DataFrame) -> Column:
    """A number that tells rows apart, to order those that are otherwise alike."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
