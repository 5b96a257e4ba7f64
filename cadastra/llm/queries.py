"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm import leakage, owners, packing, personal, reading, sql, survivors
from cadastra.session import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row and the source of the account of each rendition queued at least twice."""
    return survivors.survivors(table(spark, sf_dir, "review_queue"), table(spark, sf_dir, "status_trust"))


def p1_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per rendition queued at least twice: account_number, processed_at and status of its best rows and of the consensus."""
    return survivors.representatives(table(spark, sf_dir, "review_queue"), table(spark, sf_dir, "status_trust"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of different owner names that mean the same owner."""
    tables = [table(spark, sf_dir, name) for name in ("review_queue", "sample_rendition_summary")]
    return owners.owner_pairs(checkpointed(owners.owner_groups(owners.all_names(tables))))


def p5_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every owner name with its group, a representative and the number of spellings."""
    tables = [table(spark, sf_dir, name) for name in ("review_queue", "sample_rendition_summary")]
    return owners.represented(checkpointed(owners.owner_groups(owners.all_names(tables))))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a container of each capacity."""
    documents = table(spark, sf_dir, "documents")
    path = spark.conf.get("spark.cadastra.tokenizer", packing.TOKENIZER)
    lanes = spark.conf.get("spark.cadastra.lanes", None)
    return packing.pack(checkpointed(packing.token_counts(documents, path)), table(spark, sf_dir, "container_sizes"), lanes=int(lanes) if lanes else None)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces, tokens and the share of filled space for each capacity."""
    sizes = table(spark, sf_dir, "container_sizes")
    pieces = p6_containers(spark, sf_dir)
    return (
        pieces.groupBy("size_name", "container_id")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
        .groupBy("size_name")
        .agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
        .join(F.broadcast(sizes), "size_name")
        .select("size_name", "capacity_tokens", "containers", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("filled"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that take over passages of test items, with the items."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses that are taken out of the test items as common property, with the texts they stand in."""
    return leakage.common_clauses(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _terms(spark: SparkSession, sf_dir: str) -> Broadcast:
    documents = table(spark, sf_dir, "documents").select("text")
    notes = table(spark, sf_dir, "sample_rendition_summary").select(F.col("appraiser_notes").alias("text"))
    return spark.sparkContext.broadcast(personal.disclosure(documents.unionByName(notes)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every personal item of the documents and of the appraisers' notes."""
    terms = _terms(spark, sf_dir)
    documents = personal.find_items(table(spark, sf_dir, "documents"), "documents", "doc_id", "text", terms)
    notes = personal.find_items(table(spark, sf_dir, "sample_rendition_summary"), "sample_rendition_summary", "summary_id", "appraiser_notes", terms)
    return documents.unionByName(notes)


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and notes with typed placeholders in place of their personal items."""
    terms = _terms(spark, sf_dir)
    documents = personal.redact(table(spark, sf_dir, "documents"), "doc_id", "text", terms)
    notes = personal.redact(table(spark, sf_dir, "sample_rendition_summary"), "summary_id", "appraiser_notes", terms)
    return documents.withColumn("source_table", F.lit("documents")).unionByName(notes.withColumn("source_table", F.lit("sample_rendition_summary")))


#: Kinds of running prose, and the shortest text that is graded.
PROSE = ("letter", "guide", "memo", "notice", "minutes", "faq")
LEAST_CHARS = 400


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading band of every English document of running prose."""
    documents = table(spark, sf_dir, "documents").where(F.col("doc_kind").isin(*PROSE) & (F.col("n_chars") >= LEAST_CHARS))
    return reading.graded(documents, reading.fit(table(spark, sf_dir, "level_samples"))).select("doc_id", "band")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, mean prediction and its spread in each band, by source."""
    documents = table(spark, sf_dir, "documents").where(F.col("doc_kind").isin(*PROSE) & (F.col("n_chars") >= LEAST_CHARS))
    graded = reading.graded(documents, reading.fit(table(spark, sf_dir, "level_samples")))
    return (
        graded.join(documents.select("doc_id", "source"), "doc_id")
        .groupBy("source", "band")
        .agg(F.count("*").alias("documents"), F.round(F.avg("prediction"), 3).alias("mean_prediction"), F.round(F.stddev_pop("prediction"), 3).alias("spread"))
    )


def queries() -> dict:
    return {"p2_found": p2_found, "p2_redacted": p2_redacted, "p5_found": p5_found, "p5_owners": p5_owners, "p6_containers": p6_containers, "p6_fill": p6_fill, "p8_found": p8_found, "p8_profile": p8_profile, "p7_found": p7_found, "p7_common": p7_common, "p1_found": p1_found, "p1_representative": p1_representative}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": sql.P1}
