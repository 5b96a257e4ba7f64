"""Readers: page JSON and text folders, overrides, CSV tables, queues, and files of a directory."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "STRUCT<text: STRING, x0: DOUBLE, x1: DOUBLE, top: DOUBLE, y0: DOUBLE, y1: DOUBLE, confidence: DOUBLE, source: STRING, rotation: INT>"
PAGE = f"STRUCT<page_number: INT, page: INT, i: INT, text: STRING, page_text: STRING, content: STRING, ocr_blocks: ARRAY<{WORD}>, blocks: ARRAY<{WORD}>, ocr: ARRAY<{WORD}>, text_source: STRING>"
QUEUE = "processed_at STRING, file_name STRING, district_id STRING, district_slug STRING, district_name STRING, tax_year STRING, owner_name STRING, account_number STRING, status STRING, recommended_value DOUBLE, value_source STRING, confidence STRING, issues STRING, agent_status STRING"
OVERRIDE = "attachment_total DOUBLE, good_faith_value DOUBLE, historical_cost DOUBLE, acquisition_year INT, life_years INT, notes STRING"


def pages_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_number, text, words, text_source) of page files: a list, or an object with ``pages`` or ``document_pages``.

    A file of another shape gives one row with ``error``.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    held = f"STRUCT<pages: ARRAY<{PAGE}>, document_pages: ARRAY<{PAGE}>>"
    pages = F.when(F.startswith("value", F.lit("[")), F.from_json("value", f"ARRAY<{PAGE}>")).otherwise(
        F.coalesce(F.from_json("value", held)["pages"], F.from_json("value", held)["document_pages"])
    )
    read = raw.withColumn("pages", pages)
    rows = read.select("file", F.when(F.col("pages").isNull(), "no list of pages").alias("error"), F.posexplode_outer("pages").alias("at", "p"))
    return rows.select(
        "file",
        F.coalesce("p.page_number", "p.page", "p.i", F.col("at") + 1).alias("page_number"),
        F.trim(F.regexp_replace(F.coalesce("p.text", "p.page_text", "p.content", F.lit("")), r"(?U)\s+", " ")).alias("text"),
        F.coalesce("p.ocr_blocks", "p.blocks", "p.ocr").alias("words"),
        "p.text_source",
        "error",
    )


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(folder, page_number, text) of the text files of folders, pages numbered by file name within each folder."""
    from pyspark.sql import Window

    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    raw = raw.withColumn("folder", F.regexp_replace("file", r"/[^/]*$", ""))
    order = Window.partitionBy("folder").orderBy(F.regexp_extract("file", r"([^/]*)$", 1))
    return raw.select("folder", F.row_number().over(order).alias("page_number"), F.trim(F.regexp_replace("value", r"(?U)\s+", " ")).alias("text"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Overrides from JSON objects, one a file, with missing members NULL and missing notes empty; one row of these without any file."""
    try:
        return spark.read.schema(OVERRIDE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path")).fillna({"notes": ""})
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(None,) * 7], f"{OVERRIDE}, file STRING").fillna({"notes": ""})


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a stated schema; blank lines are skipped."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def keyword_table(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The keywords of a small CSV file in their order, which decides between them."""
    rows = spark.read.schema("keyword STRING, life_years INT").csv(path, header=True).where("keyword IS NOT NULL").collect()
    return [(r["keyword"].strip().lower(), r["life_years"]) for r in rows]


def queue_csv(spark: SparkSession, path: str) -> DataFrame:
    """Queue rows of CSV files, the latest first; each file is read by its own header, columns it lacks are NULL.

    Headers are the first lines of the files; files of one header are read together, so there is one scan for each
    generation of the header. Columns that no queue has are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")
    heads = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
    read = []
    for head in sorted(r["head"] for r in heads.select("head").distinct().collect() if r["head"]):
        names = [n.strip().strip('"').lower() for n in head.lstrip("\ufeff").split(",")]
        schema = ", ".join(f"`{n if n and names.index(n) == i else f'_{i}'}` STRING" for i, n in enumerate(names))
        rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, quote='"', escape='"').withColumn("_file", F.col("_metadata.file_path"))
        rows = rows.join(heads.where(F.col("head") == head).select(F.col("file").alias("_file")), "_file", "left_semi")
        wanted = [(c.split()[0], c.split()[1]) for c in QUEUE.split(", ")]
        read.append(rows.select(*[(F.col(c) if c in names else F.lit(None)).try_cast(kind).alias(c) for c, kind in wanted]))
    every = reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], QUEUE)
    return every.orderBy(F.desc_nulls_last("processed_at"))


def final_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Final records of ``*_final.json`` files, the latest file first; unreadable files give a row of NULLs."""
    read = spark.read.text(path, wholetext=True, pathGlobFilter="*_final.json")
    return read.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("modified_at"), F.try_parse_json("value").alias("record")).orderBy(F.desc("modified_at"), "file_name")


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modified_at, length) of the files of a directory, contents unread; the newest is ``orderBy(desc).limit(1)``."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return listed.select("path", F.col("modificationTime").alias("modified_at"), "length")


def newest_file(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return files(spark, path, pattern).orderBy(F.desc("modified_at"), "path").limit(1)
