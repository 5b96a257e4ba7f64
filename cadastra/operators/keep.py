"""Choosing rows: best of a key, top k, buckets, agreement among the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(df: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The row of each key with the largest ``rank`` (a struct that decides ties).

    An aggregate, not a window: rows meet in the map-side combine, and no key is gathered or sorted.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, rank).alias("_best")).select("_best.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank; the engine limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def conflict(df: DataFrame, keys: list[str], order: list[Column], value: str, k: int = 3) -> DataFrame:
    """(keys, distinct_values, conflict): whether the first ``k`` rows of a key disagree."""
    best = top_k(df, keys, order, k)
    return best.groupBy(*keys).agg(F.countDistinct(value).alias("distinct_values")).withColumn("conflict", F.col("distinct_values") > 1)


def zero_filled_pivot(df: DataFrame, keys: list[str], column: str, values: list[str], amount: Column) -> DataFrame:
    """One column for each of the stated ``values``, 0 where a key has none."""
    sums = [F.round(F.sum(F.when(F.col(column) == v, amount).otherwise(0.0)), 2).alias(v.lower()) for v in values]
    return df.groupBy(*keys).agg(*sums)
