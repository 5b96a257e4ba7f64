"""Reconciling several readings of one thing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreement(df: DataFrame, keys: list[str], value: str, tolerance: float = 1.0) -> DataFrame:
    """(keys, readings, spread, verdict, agreed): at least two readings within ``tolerance`` agree on their mean."""
    spread = F.max(value) - F.min(value)
    verdict = F.when(F.count(value) < 2, "single").when(spread <= tolerance, "agree").otherwise("disagree")
    return df.groupBy(*keys).agg(
        F.count(value).alias("readings"), F.round(spread, 2).alias("spread"), verdict.alias("verdict"), F.when((F.count(value) >= 2) & (spread <= tolerance), F.round(F.avg(value), 2)).alias("agreed")
    )


def first_with_text(df: DataFrame, keys: list[str], provider: str, rank: dict[str, int], text: str) -> DataFrame:
    """Of each key the reading of the best ranked provider that has any text."""
    order = F.coalesce(*[F.when(F.col(provider) == p, F.lit(r)) for p, r in rank.items()], F.lit(len(rank)))
    present = df.where(F.length(F.trim(text)) > 0)
    return present.groupBy(*keys).agg(F.min_by(F.struct(provider, text), F.struct(order, F.col(provider), F.col(text))).alias("_m")).select(*keys, "_m.*")


def union_distinct(primary: DataFrame, other: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Rows of both, equal ones by ``keys`` once, those of ``primary`` first and then the first by ``order``."""
    both = primary.withColumn("_source", F.lit(0)).unionByName(other.withColumn("_source", F.lit(1)))
    names = [f"_k{i}" for i in range(len(keys))]
    both = both.withColumns(dict(zip(names, keys, strict=True)))
    whole = F.struct(*[F.col(c) for c in primary.columns])
    return both.groupBy(*names).agg(F.min_by(whole, F.struct("_source", *order)).alias("_row")).select("_row.*")


def flag_union(df: DataFrame, keys: list[str], flags: str) -> DataFrame:
    """The sorted distinct flags of each key, from arrays of flags."""
    exploded = df.select(*keys, F.explode(flags).alias("_flag"))
    return exploded.groupBy(*keys).agg(F.array_sort(F.collect_set("_flag")).alias(flags))


def union_all(frames: list[DataFrame], source: str | None = None) -> DataFrame:
    """All rows of several frames by the names of their columns, those a frame lacks as NULL; ``source`` counts the frames from 0."""
    numbered = [f.withColumn(source, F.lit(i)) for i, f in enumerate(frames)] if source else frames
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
