"""Structured Streaming over the queue: ingest with exact-once upserts, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest ``order``; ties go to the row with the larger hash of all columns, so a replay keeps the same."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(whole, F.struct(F.col(order), F.xxhash64(*df.columns))).alias("_r")).select("_r.*")


def ingest_latest(spark: SparkSession, source: str, schema: StructType, key: str, order: str, table: str, state: str, buckets: int = 64, files: int = 1000) -> DataFrame:
    """Reads all files of ``source`` as a stream and keeps the latest row of each key under ``table``, in ``buckets`` by the hash of the key.

    A batch reads and writes only the buckets its keys fall into: each bucket has two slots, the batch writes the slot that does not
    hold the bucket's last version, and then one small manifest of all buckets' slots. A batch that is run again finds the
    manifest of the batch before it and writes the same files again. Returns the last version of all buckets.
    """
    bucketed = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))

    def manifest(number: int) -> dict[int, int]:
        """Slots by bucket after a batch."""
        return {r["bucket"]: r["slot"] for r in spark.read.parquet(f"{table}_manifest/batch={number}").collect()} if number >= 0 else {}

    def held(slots: dict[int, int]) -> DataFrame | None:
        paths = [f"{table}/slot={s}/_bucket={b}" for b, s in sorted(slots.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def merge(batch: DataFrame, number: int) -> None:
        rows = bucketed(latest_by_key(batch, key, order)).persist()
        touched = sorted(r["_bucket"] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets``
        before = manifest(number - 1)
        old = held({b: before[b] for b in touched if b in before})
        whole = bucketed(latest_by_key((old.unionByName(rows.drop("_bucket")) if old is not None else rows.drop("_bucket")), key, order))
        for slot in (0, 1):
            ours = [b for b in touched if before.get(b, 1) != slot]
            if ours:
                whole.where(F.col("_bucket").isin(ours)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{table}/slot={slot}")
        after = {**before, **{b: 1 - before.get(b, 1) for b in touched}}
        spark.createDataFrame(sorted(after.items()), "bucket INT, slot INT").coalesce(1).write.mode("overwrite").parquet(f"{table}_manifest/batch={number}")
        spark.createDataFrame([(number,)], "batch INT").write.mode("overwrite").parquet(f"{table}_last")
        rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{table}_last").first()["batch"]
    return held(manifest(last))


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of each kind in windows of event time; rows later than the watermark are left out of a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
