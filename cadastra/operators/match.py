"""Joins by lookup: with a floor, by keyword, by priority, within a band, nearest, and longer of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_lookup(items: DataFrame, table: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``items`` with the ``value`` of their (key, at); before a key's first ``at`` its oldest value, in gaps and after NULL."""
    oldest = table.groupBy(key).agg(F.min(at).alias("_first"), F.min_by(value, at).alias("_oldest"))
    found = items.join(table.select(key, at, value), [key, at], "left").join(oldest, key, "left")
    return found.withColumn(value, F.coalesce(value, F.when(F.col(at) < F.col("_first"), F.col("_oldest")))).drop("_first", "_oldest")


def first_keyword(df: DataFrame, text: str, keywords: list[tuple[str, object]], name: str) -> DataFrame:
    """``df`` with the value of the first listed keyword that the text contains, by one expression without a join."""
    found = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(v)) for k, v in keywords])
    return df.withColumn(name, found)


def by_priority(items: DataFrame, table: DataFrame, keys: list[tuple[Column, str]], value: str) -> DataFrame:
    """``items`` with ``value`` from the first of several (item expression, unique table column) that finds a row."""
    names = []
    for i, (expression, column) in enumerate(keys):
        name = f"_found{i}"
        side = table.where(F.col(column).isNotNull()).select(F.col(column).alias(f"_key{i}"), F.col(value).alias(name))
        items = items.withColumn(f"_probe{i}", expression).join(side, F.col(f"_probe{i}") == F.col(f"_key{i}"), "left").drop(f"_probe{i}", f"_key{i}")
        names.append(name)
    return items.withColumn(value, F.coalesce(*names)).drop(*names)


def nearest_in_band(labels: DataFrame, values: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """For each label (key, label_id, label_at) the value (key, value_id, value_at) nearest to it within the band.

    Values and labels meet on buckets as wide as the band, so long keys do not pair all with all.
    """
    width = before + after
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    left = labels.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("label_at") - before) / width).cast("bigint"), F.floor((F.col("label_at") + after) / width).cast("bigint"))))
    met = left.join(values.withColumn("_bucket", bucket("value_at")), [key, "_bucket"]).where((F.col("value_at") - F.col("label_at")).between(-before, after))
    rank = F.struct(F.abs(F.col("value_at") - F.col("label_at")).alias("gap"), "value_at", "value_id")
    return met.groupBy(key, "label_id").agg(F.min(rank).alias("_m")).select(key, "label_id", F.col("_m.value_id").alias("value_id"), F.col("_m.gap").alias("gap"))


def nearest_anchor(points: DataFrame, anchors: list[tuple[str, float, float]], x: Column, y: Column, name: str) -> DataFrame:
    """``points`` with the name of the nearest of a stated list of anchors, rows weighing 2.5 times columns."""
    costs = [F.struct((F.abs(y - ay) * 2.5 + F.abs(x - ax)).alias("cost"), F.lit(i).alias("i"), F.lit(a).alias("name")) for i, (a, ax, ay) in enumerate(anchors)]
    best = F.array_min(F.array(*costs))
    return points.withColumn(name, best["name"]).withColumn("cost", best["cost"])


def longer_of(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """Full outer merge by key: the longer trimmed text, ties and lone rows to the left, and where it came from."""
    a, b = left.select(key, F.col(text).alias("_a")), right.select(key, F.col(text).alias("_b"))
    la, lb = F.length(F.trim(F.coalesce("_a", F.lit("")))), F.length(F.trim(F.coalesce("_b", F.lit(""))))
    first = F.col("_a").isNotNull() & (F.col("_b").isNull() | (la >= lb))
    return a.join(b, key, "full_outer").select(key, F.when(first, F.col("_a")).otherwise(F.col("_b")).alias(text), F.when(first, "left").otherwise("right").alias("origin"))


def mapped(df: DataFrame, column: str, table: dict[str, object], name: str, otherwise: str | None = None, flag: str | None = None) -> DataFrame:
    """``df`` with the value of its ``column`` in a stated table; unknown keys take that of ``otherwise`` and raise ``flag``."""
    found = F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in table.items()])
    out = df.withColumn(name, F.coalesce(found, F.lit(table[otherwise])) if otherwise is not None else found)
    return out.withColumn(flag, found.isNull()) if flag else out


def allowed(items: DataFrame, candidates: DataFrame, key: str, value: str, candidate: str) -> DataFrame:
    """``items`` with ``value`` kept only where it equals one of its key's candidates, as text or as a number; else NULL and ``rejected``."""
    both = candidates.select(F.col(key).alias("_key"), F.explode(F.array(F.trim(F.col(candidate).cast("string")), F.col(candidate).try_cast("double").cast("string"))).alias("_value")).where("_value IS NOT NULL").distinct()
    forms = F.explode(F.array(F.trim(F.col(value).cast("string")), F.col(value).try_cast("double").cast("string"))).alias("_value")
    fits = items.select(F.col(key).alias("_key"), F.col(value).alias("_shown"), forms).join(both, ["_key", "_value"]).select("_key", "_shown").distinct().withColumn("_fits", F.lit(True))
    joined = items.join(fits, (F.col(key) == F.col("_key")) & (F.col(value) == F.col("_shown")), "left")
    return joined.withColumn("rejected", F.col(value).isNotNull() & F.col("_fits").isNull()).withColumn(value, F.when(F.col("_fits"), F.col(value))).drop("_key", "_shown", "_fits")


def resolve_members(people: DataFrame, members: DataFrame, member_id: str, person_id: str, email: str) -> DataFrame:
    """``people`` (person_id, email) with the ``member_id`` of their member: by their own id, else by their email without case; and whether
    the member's missing id is to be filled in (``backfill``)."""
    lower = F.lower(F.trim(F.col(email)))
    by_id = members.where(F.col(person_id).isNotNull()).groupBy(F.col(person_id).alias("_p")).agg(F.min(member_id).alias("_by_id"))
    by_email = members.where(F.col(email).isNotNull()).groupBy(lower.alias("_e")).agg(F.min_by(F.struct(F.col(member_id).alias("m"), F.col(person_id).alias("p")), member_id).alias("_by_email"))
    joined = people.join(by_id, F.col(person_id) == F.col("_p"), "left").join(by_email, lower == F.col("_e"), "left")
    found = F.coalesce("_by_id", "_by_email.m")
    fill = F.col("_by_id").isNull() & F.col("_by_email.m").isNotNull() & F.col("_by_email.p").isNull()
    return joined.withColumn(member_id, found).withColumn("backfill", fill).drop("_p", "_e", "_by_id", "_by_email")
