"""Logic along an order: carrying forward, sections between headings, gaps, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text as texts
from cadastra.session import checkpointed


#: Rows of one key from which its order is cut into parts that are worked on apart.
HOT = 2_000_000


def _parts(df: DataFrame, key: str, order: list[str], hot: int) -> DataFrame | None:
    """``df`` with ``_part``, ranges of (key, order) in their order, if any key has more than ``hot`` rows; else None.

    The ranges are written, so that every branch that reads them sees the same ones.
    """
    if df.groupBy(key).count().where(F.col("count") > hot).isEmpty():
        return None
    return checkpointed(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))


def _before(summary: DataFrame, key: str, carried: dict[str, Column]) -> DataFrame:
    """For each part but a key's first, what its key's earlier parts carry into it; one row for each part that a key goes on in."""
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(key, "_part", *[F.last(c, ignorenulls=True).over(w).alias(name) for name, c in carried.items()]).where(" OR ".join(f"{n} IS NOT NULL" for n in carried))


def carry_forward(df: DataFrame, key: str, order: list[str], kind: str, fillable: Column, carried: str, name: str, hot: int = HOT) -> DataFrame:
    """``df`` with ``name``: fillable rows after a ``carried`` row take its kind, along whole runs of fillable rows.

    A key of more than ``hot`` rows is worked on in parts, and what stands at their ends is carried from one to the next.
    """
    stands = F.when(~fillable, F.col(kind))
    parts = _parts(df, key, order, hot)
    if parts is None:
        last = F.last(stands, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(name, F.when(fillable & (last == carried), F.lit(carried)).otherwise(F.col(kind)))
    ends = parts.where(stands.isNotNull()).groupBy(key, "_part").agg(F.max_by(stands, F.struct(*order)).alias("_end"))
    every = parts.select(key, "_part").distinct().join(ends, [key, "_part"], "left")
    within = F.last(stands, ignorenulls=True).over(Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    last = F.coalesce("_within", "_before")
    joined = parts.withColumn("_within", within).join(_before(every, key, {"_before": F.col("_end")}), [key, "_part"], "left")
    return joined.withColumn(name, F.when(fillable & (last == carried), F.lit(carried)).otherwise(F.col(kind))).drop("_within", "_before", "_part")


def headings(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, pos, heading): group 1 of every match of ``pattern``, positions from 1."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("at", "heading")
    return df.select(key, found).select(key, (F.col("at") + 1).cast("bigint").alias("pos"), "heading")


HEADING = r"(?i)\bSCHEDULE\s+([A-F])\b"


def parts_of(text: Column, heading: str = HEADING, last_only: bool = False) -> Column:
    """(pos, letter, body) of the sections of a text as an array, positions from 1; ``body`` begins after its heading.

    What precedes the first heading is no section. With ``last_only`` a letter that comes again takes the place of its former
    section. One expression within the row: the text is split before each heading.
    """
    flags, plain = ("(?i)", heading[4:]) if heading.startswith("(?i)") else ("", heading)
    read = F.transform(F.split(text, rf"{flags}(?={plain})"), lambda part: F.struct(F.upper(F.regexp_extract(part, rf"{flags}^{plain}", 1)).alias("letter"), F.regexp_replace(part, rf"{flags}^{plain}\s*|\s+$", "").alias("body")))
    found = F.filter(read, lambda p: p["letter"] != "")
    placed = F.transform(found, lambda p, i: F.struct((i + 1).cast("bigint").alias("pos"), p["letter"].alias("letter"), p["body"].alias("body")))
    if not last_only:
        return placed
    return texts.let(placed, lambda ps: F.filter(ps, lambda p: ~F.exists(F.slice(ps, p["pos"].cast("int") + 1, F.size(ps)), lambda later: later["letter"] == p["letter"])))


def sections(df: DataFrame, key: str, text: str, heading: str = HEADING, last_only: bool = False) -> DataFrame:
    """(key, pos, letter, body): the text between one heading and the next, as ``parts_of`` reads it; a narrow map."""
    return df.select(key, F.explode(parts_of(F.col(text), heading, last_only)).alias("s")).select(key, "s.*")


def gap_segments(df: DataFrame, key: str, order: list[str], at: Column, gap: float, name: str, hot: int = HOT) -> DataFrame:
    """``df`` with the number of its segment, a new one after every gap larger than ``gap``; numbers from 1.

    A key of more than ``hot`` rows is worked on in parts; the last place of each and the number of its segments are carried on.
    """
    df = df.withColumn("_at", at)
    parts = _parts(df, key, order, hot)
    if parts is None:
        w = Window.partitionBy(key).orderBy(*order)
        starts = F.when(F.col("_at") - F.lag("_at").over(w) <= gap, 0).otherwise(1)
        return df.withColumn("_start", starts).withColumn(name, F.sum("_start").over(w).cast("bigint")).drop("_start", "_at")
    ends = parts.groupBy(key, "_part").agg(F.max_by("_at", F.struct(*order)).alias("_end"))
    here = parts.join(_before(ends, key, {"_last": F.col("_end")}), [key, "_part"], "left")
    w = Window.partitionBy(key, "_part").orderBy(*order)
    starts = F.when(F.col("_at") - F.coalesce(F.lag("_at").over(w), F.col("_last")) <= gap, 0).otherwise(1)
    here = here.withColumn("_start", starts).withColumn("_own", F.sum("_start").over(w))
    counts = here.groupBy(key, "_part").agg(F.sum("_start").alias("_n"))
    sofar = counts.select(key, "_part", F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_sofar")).where("_sofar IS NOT NULL")
    out = here.join(sofar, [key, "_part"], "left").withColumn(name, (F.col("_own") + F.coalesce("_sofar", F.lit(0))).cast("bigint"))
    return out.drop("_at", "_start", "_own", "_sofar", "_part", "_last")


def offset_rows(df: DataFrame, year: str, factors: list[float]) -> DataFrame:
    """A row for each factor: the years before ``year`` with their offsets, and one for all earlier years."""
    values = F.array(*[F.lit(float(f)) for f in [*factors, factors[-1]]])
    rows = df.select("*", F.posexplode(values).alias("offset", "factor"))
    return rows.withColumn("offset", F.col("offset").cast("bigint")).withColumn("acquired", (F.col(year) - 1 - F.col("offset")).cast("bigint")).withColumn("prior", F.col("offset") == len(factors))
