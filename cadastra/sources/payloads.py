"""Vendor payloads of text recognition as pages: nested JSON read with a schema and reshaped by expressions.

Each function takes a DataFrame with a string column ``payload`` and its key, and gives one row per page:
(key, page_number, text, words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANCHOR = "textAnchor: STRUCT<textSegments: ARRAY<STRUCT<startIndex: STRING, endIndex: STRING>>>"
_POLY = "boundingPoly: STRUCT<vertices: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>, normalizedVertices: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
_LAYOUT = f"layout: STRUCT<{_ANCHOR}, {_POLY}, confidence: DOUBLE>"
_CELLS = f"ARRAY<STRUCT<cells: ARRAY<STRUCT<{_LAYOUT}>>>>"
_DOCUMENT = (
    f"text: STRING, pages: ARRAY<STRUCT<pageNumber: INT, dimension: STRUCT<width: DOUBLE, height: DOUBLE>, imageQualityScores: STRUCT<qualityScore: DOUBLE>, lines: ARRAY<STRUCT<{_LAYOUT}>>, "
    f"tokens: ARRAY<STRUCT<{_LAYOUT}, confidence: DOUBLE>>, tables: ARRAY<STRUCT<{_LAYOUT}, bodyRows: {_CELLS}>>, formFields: ARRAY<STRUCT<fieldName: STRUCT<{_ANCHOR}>, fieldValue: STRUCT<{_ANCHOR}>, valueType: STRING>>>>"
)
DOCUMENT = f"STRUCT<document: STRUCT<{_DOCUMENT}>, {_DOCUMENT}>"
ANALYSIS = "STRUCT<analyzeResult: STRUCT<content: STRING, pages: ARRAY<STRUCT<pageNumber: INT, lines: ARRAY<STRUCT<content: STRING>>, words: ARRAY<STRUCT<content: STRING, polygon: ARRAY<DOUBLE>, confidence: DOUBLE>>>>>>"
ANNOTATION = (
    "STRUCT<fullTextAnnotation: STRUCT<text: STRING, pages: ARRAY<STRUCT<blocks: ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<words: ARRAY<STRUCT<"
    "boundingBox: STRUCT<vertices: ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>, confidence: DOUBLE, symbols: ARRAY<STRUCT<text: STRING>>>>>>>>>>>>"
)


def anchored(text: Column, segments: Column) -> Column:
    """The parts of a text that an anchor's segments name, run together."""
    part = lambda s: F.substring(text, F.coalesce(s["startIndex"].cast("int"), F.lit(0)) + 1, F.greatest(s["endIndex"].cast("int") - F.coalesce(s["startIndex"].cast("int"), F.lit(0)), F.lit(0)))
    return F.aggregate(F.coalesce(segments, F.array().cast("ARRAY<STRUCT<startIndex: STRING, endIndex: STRING>>")), F.lit(""), lambda a, s: F.concat(a, F.coalesce(part(s), F.lit(""))))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _box(xs: Column, ys: Column) -> list[Column]:
    return [F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("top"), F.array_max(ys).alias("y1")]


def _corner(layout: Column, page: Column, axis: str, size: str) -> Column:
    """Coordinates of a layout: absolute ones, else the relative ones times the page's size."""
    absolute = F.transform(layout["boundingPoly"]["vertices"], lambda v: F.coalesce(v[axis], F.lit(0.0)))
    relative = F.transform(layout["boundingPoly"]["normalizedVertices"], lambda v: F.coalesce(v[axis], F.lit(0.0)) * page["dimension"][size])
    return F.when(F.size(absolute) > 0, absolute).otherwise(relative)


def _documents(df: DataFrame, key: str) -> DataFrame:
    """(key, whole, pages) of replies that are a document or wrap one in ``document``."""
    read = df.select(key, F.from_json("payload", DOCUMENT).alias("d"))
    return read.select(key, F.coalesce("d.document.text", "d.text").alias("whole"), F.coalesce("d.document.pages", "d.pages").alias("pages"))


def _text(anchor: Column) -> Column:
    return anchored(F.col("whole"), anchor["textSegments"])


def document_pages(df: DataFrame, key: str) -> DataFrame:
    """Pages with lines and tokens anchored in one text, a token's own confidence before its layout's; a text without pages is one page."""
    pages = _documents(df, key).select(key, "whole", F.posexplode_outer("pages").alias("at", "p"))

    def word(t: Column) -> Column:
        layout = t["layout"]
        return F.struct(_strip(_text(layout["textAnchor"])).alias("text"), *_box(_corner(layout, F.col("p"), "x", "width"), _corner(layout, F.col("p"), "y", "height")), F.coalesce(t["confidence"], layout["confidence"]).alias("confidence"))

    words = F.filter(F.transform("p.tokens", word), lambda w: w["text"] != "")
    lines = F.array_join(F.filter(F.transform("p.lines", lambda x: _strip(_text(x["layout"]["textAnchor"]))), lambda x: x != ""), "\n")
    text = F.coalesce(F.nullif(lines, F.lit("")), F.nullif(F.array_join(F.transform("words", lambda w: w["text"]), " "), F.lit("")), F.when(F.col("p").isNull(), _strip(F.col("whole"))), F.lit(""))
    return pages.withColumn("words", words).select(key, F.coalesce("p.pageNumber", F.col("at") + 1, F.lit(1)).alias("page_number"), text.alias("text"), "words")


def document_tables(df: DataFrame, key: str) -> DataFrame:
    """(key, page_number, table_number, row_number, cells, confidence) of the body rows of every table, numbers from 1."""
    pages = _documents(df, key).select(key, "whole", F.posexplode("pages").alias("at", "p"))
    tables = pages.select(key, "whole", F.coalesce("p.pageNumber", F.col("at") + 1).alias("page_number"), F.posexplode("p.tables").alias("t", "table"))
    rows = tables.select(key, "whole", "page_number", (F.col("t") + 1).alias("table_number"), F.col("table.layout.confidence").alias("confidence"), F.posexplode("table.bodyRows").alias("r", "row"))
    cells = F.transform("row.cells", lambda c: F.coalesce(_text(c["layout"]["textAnchor"]), F.lit("")))
    return rows.select(key, "page_number", "table_number", (F.col("r") + 1).alias("row_number"), cells.alias("cells"), "confidence")


def document_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, page_number, field_number, name, value, kind) of every form field, numbers from 1."""
    pages = _documents(df, key).select(key, "whole", F.posexplode("pages").alias("at", "p"))
    fields = pages.select(key, "whole", F.coalesce("p.pageNumber", F.col("at") + 1).alias("page_number"), F.posexplode("p.formFields").alias("n", "f"))
    return fields.select(key, "page_number", (F.col("n") + 1).alias("field_number"), _text(F.col("f.fieldName.textAnchor")).alias("name"), _text(F.col("f.fieldValue.textAnchor")).alias("value"), F.col("f.valueType").alias("kind"))


def document_layout(df: DataFrame, key: str) -> DataFrame:
    """(key, page_number, width, height, quality) of every page."""
    pages = _documents(df, key).select(key, F.posexplode("pages").alias("at", "p"))
    return pages.select(key, F.coalesce("p.pageNumber", F.col("at") + 1).alias("page_number"), F.col("p.dimension.width").alias("width"), F.col("p.dimension.height").alias("height"), F.col("p.imageQualityScores.qualityScore").alias("quality"))


def document_confidence(df: DataFrame, key: str) -> DataFrame:
    """(key, confidence): the mean over the quality of the pages and the confidence of their tokens together, 0 without any."""

    def of_page(p: Column) -> Column:
        own = F.array(p["imageQualityScores"]["qualityScore"])
        tokens = F.transform(p["tokens"], lambda t: F.coalesce(F.nullif(t["confidence"], F.lit(0.0)), t["layout"]["confidence"]))
        return F.array_compact(F.concat(own, F.coalesce(tokens, F.array().cast("ARRAY<DOUBLE>"))))

    every = F.flatten(F.transform(F.coalesce("pages", F.slice("pages", 1, 0)), of_page))
    mean = F.aggregate("every", F.lit(0.0), lambda a, x: a + x) / F.size("every")
    return _documents(df, key).withColumn("every", every).select(key, F.when(F.size("every") > 0, F.round(mean, 3)).otherwise(0.0).alias("confidence"))


def analysis_pages(df: DataFrame, key: str) -> DataFrame:
    """Pages with lines and flat polygons; content without pages is one page, and neither gives none."""
    read = df.select(key, F.from_json("payload", ANALYSIS)["analyzeResult"].alias("r")).where("r.content IS NOT NULL OR size(r.pages) > 0")
    pages = read.select(key, F.col("r.content").alias("content"), F.posexplode_outer("r.pages").alias("at", "p"))

    def word(w: Column) -> Column:
        axis = lambda k: F.filter(w["polygon"], lambda _, i: i % 2 == k)
        return F.struct(F.trim(w["content"]).alias("text"), *_box(axis(0), axis(1)), w["confidence"].alias("confidence"))

    lines = F.array_join(F.transform("p.lines", lambda x: x["content"]), "\n")
    return pages.select(
        key, F.coalesce("p.pageNumber", F.col("at") + 1, F.lit(1)).alias("page_number"), F.coalesce(F.nullif(lines, F.lit("")), F.when(F.col("p").isNull(), F.col("content")), F.lit("")).alias("text"), F.transform("p.words", word).alias("words")
    )


def annotation_words(df: DataFrame, key: str) -> DataFrame:
    """(key, text, words): the words of blocks and paragraphs in reading order, symbols joined."""
    read = df.select(key, F.from_json("payload", ANNOTATION)["fullTextAnnotation"].alias("a"))
    words = F.flatten(F.flatten(F.flatten(F.transform("a.pages", lambda p: F.transform(p["blocks"], lambda b: F.transform(b["paragraphs"], lambda g: g["words"]))))))

    def word(w: Column) -> Column:
        axis = lambda k: F.transform(w["boundingBox"]["vertices"], lambda v: F.coalesce(v[k], F.lit(0.0)))
        xs, ys = axis("x"), axis("y")
        return F.struct(
            F.round(F.array_min(ys), 1).alias("row"), F.round(F.array_min(xs), 1).alias("column"), F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "").alias("text"), *_box(xs, ys), w["confidence"].alias("confidence")
        )

    ordered = F.array_sort(F.filter(F.transform(words, word), lambda w: w["text"] != ""))
    return read.select(key, F.coalesce("a.text", F.lit("")).alias("text"), F.transform(ordered, lambda w: w.dropFields("row", "column")).alias("words"))


def marked_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, text) of a reply with lines ``PAGE n:``; without them it is page 1."""
    parts = F.split(F.col(text), r"(?m)(?=^\s*PAGE \d+:\s*$)")
    rows = df.select(key, F.explode(parts).alias("part")).withColumn("n", F.regexp_extract("part", r"(?m)^\s*PAGE (\d+):\s*$", 1))
    body = _strip(F.regexp_replace("part", r"(?m)^\s*PAGE \d+:\s*$", ""))
    return rows.select(key, F.coalesce(F.nullif("n", F.lit("")).cast("int"), F.lit(1)).alias("page_number"), body.alias("text")).where("text <> ''")


def error_kind(error: Column, terminal: list[str], retryable: list[str]) -> Column:
    """``terminal``, ``retry`` or ``other`` by the words in a lower-case message."""
    low = F.lower(F.coalesce(error, F.lit("")))
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(any_of(terminal), "terminal").when(any_of(retryable), "retry").otherwise("other")


def error_summary(error: Column, most: int = 240) -> Column:
    """An error on one line, cut to ``most`` characters with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(error, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)
