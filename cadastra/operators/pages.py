"""Pages of documents: merging two readings, what a document lacks, its quality and flags, its metadata, and what each provider read.

A document's pages are combined by one aggregate; a document is bounded by its own pages.

Defined results: NULL texts count as empty; a document without pages has no row; page numbers that come twice keep both pages
where pages are added up, and the first by text where two readings are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import text as texts

# The words that a readable document holds, the schedules and columns that a whole one has, and the measures of both.
TERMS = ("rendition", "schedule", "market value", "good faith", "historical cost", "property owner", "total fixed assets")
LEAST_TERMS, CHARS_A_PAGE, LETTERS_A_PAGE, DIGITS_A_PAGE = 2, 75, 25, 10
ODD_TOKENS, ODD_TOKENS_A_PAGE = 12, 6
SCHEDULES = ("A", "B", "C", "D", "E")
COLUMNS = ("good faith", "historical cost", "year acquired", "inventory", "actual cost", "supplies")
WHOLE_PAGE = 700.0
WEIGHTS = {"length": 0.35, "schedules": 0.35, "columns": 0.2, "letters": 0.1}
USABLE, READABLE_COLUMNS, USABLE_SCHEDULES = 0.55, 0.34, 2
LOW_TEXT = 50
# Where the fields of a document's head stand, the first pattern that matches.
TAX_YEAR = (r"\b(20[0-4]\d)\s+(?:business personal property|rendition)", r"(?:tax year|year)\D{0,15}(20[0-4]\d)")
OWNER = (r"(?:property owner|owner name|name of owner)\s*[:\-]?\s*([A-Z0-9&., '\-]{3,80})", r"(?:owner)\s*[:\-]?\s*([A-Z0-9&., '\-]{3,80})")
ACCOUNT = (
    r"\b(P\s*[-#]?\s*\d{4,10})\b", r"(?:account number|account no\.?|acct\.?|property id|pid)\s*[:#\-]?\s*([A-Z0-9\-]{4,30})", r"(?:appraisal district account|account)\D{0,30}(P\s*[-#]?\s*\d{4,10})",
    r"\b(?:account|acct)\D{0,10}([0-9]{4,30})\b",
)
SIGNED = (r"(?:date signed|signed date|date)\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",)


def merged_blocks(first: Column, second: Column) -> Column:
    """Word boxes of both readings, those of the first before, equal ones (text, whole height, whole position) once."""

    def once(both: Column) -> Column:
        keys = F.transform(both, lambda b: F.concat_ws("|", F.trim(b["text"]), F.rint(F.coalesce(b["top"], F.lit(0.0))), F.rint(F.coalesce(b["x0"], F.lit(0.0)))))
        return texts.let(keys, lambda ks: F.filter(both, lambda b, i: F.array_position(ks, F.get(ks, i)) == i + 1))

    both = F.concat(F.coalesce(first, F.slice(second, 1, 0)), F.coalesce(second, F.slice(first, 1, 0)))
    return texts.let(F.filter(both, lambda b: F.length(F.trim(F.coalesce(b["text"], F.lit("")))) > 0), once)


def merge_readings(left: DataFrame, right: DataFrame, key: list[str], names: tuple[str, str]) -> DataFrame:
    """(key, text, words, preferred, sources, error) of the pages of two readings by ``key``: text, words, error.

    The reading with the longer trimmed text comes first, the left one on ties; its empty text gives way to the other's. An error
    is kept only where no text is.
    """
    side = lambda df, p: df.groupBy(*key).agg(F.max_by(F.struct("text", "words", "error"), F.struct(F.length("text"), "text")).alias(p))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    size = lambda c: F.length(F.trim(F.coalesce(F.col(f"{c}.text"), F.lit(""))))
    right_first = size("r") > size("l")
    first, second = F.when(right_first, F.col("r")).otherwise(F.col("l")), F.when(right_first, F.col("l")).otherwise(F.col("r"))
    text = F.coalesce(F.nullif(first["text"], F.lit("")), second["text"], F.lit(""))
    sources = F.array_compact(F.array(F.when(size("l") > 0, F.lit(names[0])), F.when(size("r") > 0, F.lit(names[1]))))
    error = F.coalesce(F.nullif(F.col("l.error"), F.lit("")), F.nullif(F.col("r.error"), F.lit("")))
    preferred = F.when(first.isNotNull(), F.when(right_first, names[1]).otherwise(names[0]))
    return both.select(*key, text.alias("text"), merged_blocks(first["words"], second["words"]).alias("words"), preferred.alias("preferred"), sources.alias("sources"), F.when(F.length(F.trim(text)) == 0, error).alias("error"))


def _whole(pages: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """(key, pages, whole): the texts of each document in the order of its pages, one to a line."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(*key).agg(F.count("*").alias("pages"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("whole"))


def needs_reading(pages: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """(key, pages, characters, letters, digits, odd_tokens, terms, reason): why a document should be read by recognition, NULL if not.

    Reasons, the first that holds: ``little text``, ``few letters and digits``, ``odd tokens`` (letters and digits mixed, or signs of
    misreading), ``few terms``.
    """
    tokens = F.regexp_extract_all("whole", F.lit(r"(?U)\b\S+\b"), F.lit(0))
    odd = F.filter(tokens, lambda t: ((F.length(t) >= 4) & t.rlike("[A-Za-z]") & t.rlike(r"\d")) | F.contains(t, F.lit("\\")) | F.contains(t, F.lit("€")))
    count = lambda pattern: F.regexp_count("whole", F.lit(pattern)).cast("bigint")
    mended = texts.mended_lower(F.col("whole"))
    terms = texts.let(mended, lambda m: sum((F.when(F.contains(m, F.lit(t)), 1).otherwise(0) for t in TERMS), F.lit(0)))
    read = _whole(pages, key, page, text).select(
        *key, "pages", F.length(F.regexp_replace("whole", r"(?U)^\s+|\s+$", "")).cast("bigint").alias("characters"), count(r"\p{L}").alias("letters"), count(r"\p{Nd}").alias("digits"), F.size(odd).cast("bigint").alias("odd_tokens"), terms.cast("bigint").alias("terms")
    )
    reason = (
        F.when(F.col("characters") < CHARS_A_PAGE * F.col("pages"), "little text")
        .when((F.col("letters") < LETTERS_A_PAGE * F.col("pages")) & (F.col("digits") < DIGITS_A_PAGE * F.col("pages")), "few letters and digits")
        .when(F.col("odd_tokens") >= F.greatest(F.lit(ODD_TOKENS), ODD_TOKENS_A_PAGE * F.col("pages")), "odd tokens")
        .when(F.col("terms") < LEAST_TERMS, "few terms")
    )
    return read.withColumn("reason", reason)


def quality(text: Column, pages: Column) -> Column:
    """(score, usable, missing_schedules, missing_columns, columns_unreadable) of a document's text: its length, schedules, columns and letters."""

    def read(t: Column) -> Column:
        lacks = lambda names, said: F.array_compact(F.array(*[F.when(~F.contains(t, F.lit(said(n))), F.lit(n)) for n in names]))
        schedules, columns = lacks(SCHEDULES, lambda n: f"schedule {n.lower()}"), lacks(COLUMNS, lambda n: n)
        n = F.length(t)
        share = {
            "length": F.least(F.lit(1.0), n / (WHOLE_PAGE * F.greatest(pages, F.lit(1)))),
            "schedules": (len(SCHEDULES) - F.size(schedules)) / len(SCHEDULES),
            "columns": (len(COLUMNS) - F.size(columns)) / len(COLUMNS),
            "letters": F.when(n > 0, F.regexp_count(t, F.lit(r"\p{L}")) / n).otherwise(0.0),
        }
        score = F.round(sum((share[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), 3)
        usable = (n > 0) & (score >= USABLE) & (len(SCHEDULES) - F.size(schedules) >= USABLE_SCHEDULES)
        return F.struct(score.alias("score"), usable.alias("usable"), schedules.alias("missing_schedules"), columns.alias("missing_columns"), (share["columns"] < READABLE_COLUMNS).alias("columns_unreadable"))

    return texts.let(F.lower(texts.collapse(F.coalesce(text, F.lit("")))), read)


def flags(pages: DataFrame, key: list[str], text: str, error: str, unavailable: str) -> DataFrame:
    """(key, low_text, unavailable, errors): what is wrong with a document's pages; errors sorted, each once."""
    errors = F.array_sort(F.collect_set(F.nullif(F.col(error), F.lit(""))))
    return pages.groupBy(*key).agg(
        (F.coalesce(F.sum(F.length(text)), F.lit(0)) < LOW_TEXT).alias("low_text"), F.coalesce(F.bool_or(unavailable), F.lit(False)).alias("unavailable"), errors.alias("errors")
    )


def by_provider(pages: DataFrame, key: list[str], provider: str, page: str, text: str, source: str) -> DataFrame:
    """(key, provider, pages, characters, text_source) of each provider that read any text; the source of its first page that names one."""
    return (
        pages.groupBy(*key, provider)
        .agg(
            F.count("*").alias("pages"),
            F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"),
            F.min_by(source, F.when(F.col(source).isNotNull(), F.col(page))).alias("text_source"),
            F.coalesce(F.bool_or(F.length(F.trim(text)) > 0), F.lit(False)).alias("any"),
        )
        .where("any")
        .drop("any")
    )


def metadata(pages: DataFrame, key: list[str], page: str, text: str, words: str | None = None) -> DataFrame:
    """(key, tax_year, owner_name, account_number, signed_date) from the first two pages of each document.

    The tax year stands on the first page; the account also in the words of the pages.
    """
    shown = F.array_join(F.transform(words, lambda w: F.coalesce(w["text"], F.lit(""))), " ") if words else F.lit("")
    two = F.slice(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(shown, F.lit("")).alias("w")))), 1, 2)
    read = pages.groupBy(*key).agg(two.alias("two"))
    both, boxes = F.array_join(F.transform("two", lambda x: x["t"]), "\n"), F.array_join(F.filter(F.transform("two", lambda x: x["w"]), lambda w: w != ""), " ")
    account = texts.first_of(F.concat_ws("\n", both, boxes), list(ACCOUNT))
    return read.select(
        *key,
        texts.first_of(F.get("two", 0)["t"], list(TAX_YEAR)).alias("tax_year"),
        texts.first_of(both, list(OWNER)).alias("owner_name"),
        F.regexp_replace(F.upper(account), "[^A-Z0-9]", "").alias("account_number"),
        texts.first_of(both, list(SIGNED)).alias("signed_date"),
    )
