"""Session helpers: table access, shared checkpoints, Arrow row functions."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own; on a
    cluster that is an error, as executors could not read each other's files. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` the engine deletes what is no longer used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "cadastra-checkpoints"))
    return df.checkpoint()


#: Bytes of Arrow data that are made into Python objects at once (fixed value); these take ten to thirty times that.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in parts of at most ``PIECE`` bytes or of one row."""
    if batch.num_rows <= 1 or batch.nbytes <= PIECE:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))


def flat_map(df: DataFrame, function: Callable[[list], list], schema: str | StructType, arrow_in: bool = False) -> DataFrame:
    """Applies ``function`` to pieces of Arrow batches of ``df``: columns as Python lists in, columns as Python lists or Arrow arrays out.

    With ``arrow_in`` the columns come as Arrow arrays. What a task holds follows from ``PIECE`` and the longest row, not from the
    engine's batches, of which one of long rows is too much.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for piece in (p for batch in batches for p in pieces(batch)):
            if piece.num_rows:
                columns = function(piece.columns if arrow_in else [column.to_pylist() for column in piece.columns])
                yield pa.RecordBatch.from_arrays(
                    [values if isinstance(values, pa.Array) else pa.array(values, type=field.type) for values, field in zip(columns, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, out)
