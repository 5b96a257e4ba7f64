"""Writers: review records, summaries and the queue, partitioned by district."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.text import safe_stem
from cadastra.session import checkpointed
from cadastra.sources.readers import QUEUE

QUEUE_TYPES = dict(c.split() for c in QUEUE.split(", "))


def _slugged(df: DataFrame) -> DataFrame:
    return df.withColumn("district_slug", F.coalesce(F.nullif(F.col("district_slug"), F.lit("")), F.lit("shared")))


def review_json(df: DataFrame, path: str, stem: str = "file_name") -> None:
    """Records as JSON lines, one folder a district; a record takes the place of the one of its district and file stem, others stay.

    Only the folders of this batch's districts are read and written again.
    """
    spark = df.sparkSession
    new = _slugged(df).withColumn("stem", safe_stem(F.col(stem)))
    new = checkpointed(new.groupBy("district_slug", "stem").agg(F.max_by(F.struct(*[F.col(c) for c in new.columns]), F.xxhash64(*new.columns)).alias("r")).select("r.*"))
    whole = new
    try:
        old = spark.read.json(path, pathGlobFilter="*.json*").where(F.col("district_slug").isNotNull())
    except AnalysisException:
        old = None
    if old is not None and "stem" in old.columns:
        kept = old.withColumn("district_slug", F.col("district_slug").cast("string")).join(new.select("district_slug").distinct(), "district_slug", "left_semi").join(new.select("district_slug", "stem"), ["district_slug", "stem"], "left_anti")
        kept = kept.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) if c in new.columns else F.col(c) for c in kept.columns])
        whole = checkpointed(new.unionByName(kept, allowMissingColumns=True))  # read before its folders are replaced
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("district_slug").json(path)


def pages_json(pages: DataFrame, path: str, file: str = "file") -> None:
    """One JSON object a file with its pages in order, as ``readers.pages_json`` reads them."""
    columns = [c for c in pages.columns if c != file]
    listed = pages.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("page_number", *[c for c in columns if c != "page_number"]))).alias("pages"))
    listed.select(F.to_json(F.struct(F.col(file), "pages")).alias("value")).write.mode("overwrite").text(path)


def backfill(legacy: DataFrame, district: DataFrame, key: str = "file_name") -> DataFrame:
    """The rows of an older output whose file the district's output does not have yet, once each, to be appended to it."""
    newest = legacy.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in legacy.columns]), F.xxhash64(*legacy.columns)).alias("r")).select("r.*")
    return newest.join(district.select(key).distinct(), key, "left_anti").select(legacy.columns)


def summary_csv(df: DataFrame, path: str) -> None:
    """One line a record; arrays are joined by `` | ``."""
    flat = df.select(*[F.array_join(F.col(c), " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def append_queue(df: DataFrame, path: str) -> None:
    """Queue rows appended with every column of the queue in its order and type, one folder a district; missing columns are NULL."""
    full = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in QUEUE_TYPES.items()])
    _slugged(full).write.mode("append").partitionBy("district_slug").parquet(path)


def report(df: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """One text a record: the title, then a line ``field: value`` for each field, ``-`` for none."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("-"))) for f in fields]
    return df.select(F.concat_ws("\n", F.lit(title), *lines).alias("report"))
