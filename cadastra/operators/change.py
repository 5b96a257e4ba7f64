"""Changing keyed tables: upsert, fill from another table, append what is new, delete, and constraint checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of equal ``key`` replaced by those of ``updates``, and its new rows added."""
    b, u = base.alias("b"), updates.alias("u")
    new = F.col(f"u.{key}").isNotNull()
    return b.join(u, F.col(f"b.{key}") == F.col(f"u.{key}"), "full_outer").select(*[F.when(new, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns])


def fill_from(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with its NULLs in ``columns`` filled from the row of ``other`` with equal ``key``."""
    side = other.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(side, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in base.columns])


def append_new(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``base`` and the rows whose key it does not have."""
    return base.unionByName(rows.join(base.select(key), key, "left_anti").select(base.columns))


def delete_where_in(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks: its columns and ``rule``; a rule that is NULL counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def upsert_stamped(base: DataFrame, updates: DataFrame, key: str, stamp: str, now: Column) -> DataFrame:
    """``upsert`` in which rows that are new, or whose other columns change, get ``now`` as their ``stamp``; others keep theirs."""
    others = [c for c in base.columns if c not in (key, stamp)]
    b, u = base.alias("b"), updates.alias("u")
    known, new = F.col(f"b.{key}").isNotNull(), F.col(f"u.{key}").isNotNull()
    same = known & F.equal_null(F.struct(*[F.col(f"b.{c}") for c in others]), F.struct(*[F.col(f"u.{c}") for c in others]))
    pick = {c: F.when(new, F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")) for c in (key, *others)}
    pick[stamp] = F.when(new & ~same, now).otherwise(F.col(f"b.{stamp}"))
    return b.join(u, F.col(f"b.{key}") == F.col(f"u.{key}"), "full_outer").select(*[pick[c].alias(c) for c in base.columns])


def link(members: DataFrame, links: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(members with new links added, links refused because their key belongs to another owner already).

    Keys are compared in lower case; of several links of one key the smallest owner counts, the others are refused too.
    """
    lower = F.lower(F.trim(F.col(key)))
    first = links.groupBy(lower.alias("_k")).agg(F.min(owner).alias("_first"))
    held = members.groupBy(lower.alias("_k")).agg(F.min(owner).alias("_held"))
    judged = links.withColumn("_k", lower).join(first, "_k").join(held, "_k", "left").withColumn("_owner", F.coalesce("_held", "_first"))
    refused = judged.where(F.col(owner) != F.col("_owner")).select(*links.columns)
    added = judged.where((F.col(owner) == F.col("_owner")) & F.col("_held").isNull()).select(F.col("_k").alias(key), owner).distinct()
    return members.unionByName(added, allowMissingColumns=True), refused


def backfilled(tables: dict[str, DataFrame], known: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Every table that has both columns with its NULLs in ``column`` filled from ``known`` by ``key``; others as they are."""
    return {name: fill_from(t, known, key, [column]) if {key, column} <= set(t.columns) else t for name, t in tables.items()}


def readable(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    """Whether each of the stated tables (Parquet paths) can be read."""

    def one(path: str) -> bool:
        try:
            spark.read.parquet(path).schema
        except AnalysisException:
            return False
        return True

    return {path: one(path) for path in paths}
