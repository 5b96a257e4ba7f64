"""From pages to the fields of a document: kinds of pages, candidates by kind, scores, the best of each field.

Kinds and candidates are expressions within a page's row; the only shuffles are the order of a document's pages (for pages that
go on from a schedule) and the choice among its candidates, both by document and with a map-side combine for the choice.

Defined results: NULL texts count as empty; a document without candidates has no fields; equal scores go to the candidate that
comes first, by page, then by the order of the fields; equal candidates count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text as texts
from cadastra.operators import keep, labels, rows, scoring, sequence
from cadastra.operators.layout import page_subsection_rows

# The labels of each field; for each kind of page the fields that are looked for, with base confidence, reach and the
# words one of which the page must hold; what a kind of page adds to a field's confidence or takes from it.
ALIASES = {
    "historical_cost": ["historical cost", "original cost", "reported cost", "acquisition cost", "purchase cost", "cost new"],
    "acquisition_year": ["year acquired", "date acquired", "acquisition year", "purchase year", "acquired"],
    "rendered_value": ["rendered value", "value rendered", "total rendered value", "rendered market value"],
    "good_faith_value": ["good faith estimate", "good faith value", "good faith", "market value", "owner's estimate", "owners estimate"],
    "attachment_total": ["attachment total", "summary total", "schedule total", "total cost", "grand total", "total market value", "current value", "depreciated value", "total"],
}
LOOKED_FOR = {
    "main_form": (("good_faith_value", 0.78, 140, ("good faith", "market value")), ("rendered_value", 0.80, 160, ())),
    "attachment": (("historical_cost", 0.84, 180, ("cost", "historical", "original")), ("acquisition_year", 0.74, 120, ("acquired",)), ("rendered_value", 0.82, 180, ())),
    "schedule": (("attachment_total", 0.82, 220, ()), ("rendered_value", 0.80, 180, ())),
}
LIFE, LIFE_CONFIDENCE, MOST_LIFE = r"(?i)(?:useful life|life)\D{0,20}(\d{1,2})", 0.72, 50
TABLE_WORDS, DETAIL_WORDS, LARGEST_CONFIDENCE = ("schedule", "schidule", "fixtures", "machinery", "equipment"), ("schedule e", "furniture", "computer equipment"), 0.68
BOOSTS = {("good_faith_value", "main_form"): 0.10, ("historical_cost", "attachment"): 0.10, ("acquisition_year", "attachment"): 0.08, ("life_years", "attachment"): 0.08, ("attachment_total", "schedule"): 0.12}
PENALTIES = {
    ("historical_cost", "main_form"): 0.15, ("historical_cost", "signature"): 0.25, ("good_faith_value", "attachment"): 0.10, ("good_faith_value", "signature"): 0.25, ("attachment_total", "main_form"): 0.08,
    ("attachment_total", "signature"): 0.25,
}
GOES_ON, GOES_ON_SCORE = 60, 0.22
# Labels guessed from the words around an amount, in their order, with their scores; what kinds of pages, words and
# amounts add or take.
CONTEXT_LABELS = (
    ("schedule_e_total", ("schedule e", "total market value", "inventory"), 12), ("rendered_value", ("rendered value", "total rendered value", "value rendered"), 11), ("good_faith_value", ("good faith", "good faith estimate"), 10),
    ("market_value", ("market value", "appraised value"), 9), ("historical_cost", ("original cost", "historical cost", "reported cost", "purchase cost", "cost new", "cost"), 8),
    ("attachment_total", ("attachment total", "summary total", "schedule total", "grand total", "total cost", "total value"), 8), ("total_value", ("total", "value"), 5),
)
CONTEXT_KINDS = (("schedule_e", ("schedule e", "machinery and equipment")), ("attachment", ("see attached", "attachment", "summary")), ("cover_page", ("rendition", "affirmation", "section 5")))
KIND_ADDS = {"schedule_e": (6, ("schedule_e_total", "market_value", "total_value")), "attachment": (5, ("attachment_total", "rendered_value", "total_value")), "cover_page": (4, ("good_faith_value", "rendered_value"))}
WORDS_ADD = {"total market value": 5, "rendered value": 5, "good faith": 5, "original cost": 4, "historical cost": 4, "market value": 3, "total": 2, "value": 1}
NEAR_WORDS, NEAR_ADDS = ("schedule e", "rendered value", "good faith", "market value", "original cost"), 4
NOISE_WORDS, NOISE_TAKES = (
    ("phone", 2), ("fax", 1), ("page", 1), ("date", 1), ("year", 1), ("zip", 1), ("account number", 1), ("parcel", 1), ("statement", 1), ("form", 1), ("mailing address", 1), ("section 5", 1), ("20,000 or more", 1), ("125,000", 1),
    ("not more than", 1), ("or less", 1),
), 6
SMALL, SMALL_TAKES, FIRST_PAGE_ADDS, LIMIT_TAKES = 500, 4, 1.5, 15
AROUND_MONEY, AROUND_YEAR = 90, 80
FIELD_OF = {"schedule_e_total": "attachment_total", "total_value": "attachment_total", "market_value": "good_faith_value"}
CONTEXT_MONEY = r"(?<!\d)\$?(?:\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d{2,}(?:\.\d{2})?)(?!\d)"
YEAR_WORDS, YEAR_SCORE, YEAR_CONFIDENCE = ("year acquired", "acquired", "purchase year", "acquisition year"), 15.0, 0.75
CANDIDATE = "STRUCT<field: STRING, value: DOUBLE, raw: STRING, rule: STRING, confidence: DOUBLE, evidence: STRING>"


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(True)


def classified(pages: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """``pages`` with ``page_type`` and ``score``; a page of unknown kind with enough text after one of a schedule goes on with it."""
    typed = scoring.classify(pages, F.col(text)).withColumn("_long", F.length(texts.mended_lower(F.coalesce(F.col(text), F.lit("")))) > GOES_ON)
    typed = typed.withColumn("_doc", F.struct(*key))
    kind = sequence.carry_forward(typed, "_doc", [page], "page_type", (F.col("page_type") == "unknown") & F.col("_long"), "schedule", "_kind")
    score = F.when(F.col("_kind") != F.col("page_type"), GOES_ON_SCORE).otherwise(F.col("score"))
    return kind.withColumn("score", score).withColumn("page_type", F.col("_kind")).drop("_kind", "_long", "_doc")


def _candidate(field: str, value: Column, raw: Column, rule: Column, confidence: Column, evidence: Column) -> Column:
    parts = {"field": F.lit(field), "value": value.cast("double"), "raw": raw, "rule": rule, "confidence": confidence, "evidence": evidence}
    return F.struct(*[c.alias(n) for n, c in parts.items()]).cast(CANDIDATE)


def _found(field: str, base: float, reach: int) -> Column:
    page, mended, money, years = (F.col(c) for c in labels.MEASURES)
    year = field == "acquisition_year"
    best = labels.best_year(mended, years, ALIASES[field], base, after=reach) if year else labels.best_amount(mended, money, ALIASES[field], base, after=reach)

    def row(b: Column) -> Column:
        raw = b["value"].cast("string") if year else b["raw"]
        return F.when(b.isNotNull(), _candidate(field, b["value"], raw, F.concat(F.lit("near_label:"), b["label"]), b["confidence"], texts.evidence(page, b["start"], b["end"])))

    return texts.let(best, row)


def _of_kind(kind: str) -> Column:
    page, low = F.col("_page"), F.col("_low")
    found = [F.when(_holds(low, words), _found(field, base, reach)) for field, base, reach, words in LOOKED_FOR[kind]]
    if kind == "attachment":
        life = F.nullif(F.regexp_extract(page, LIFE, 1), F.lit("")).cast("int")
        found.append(F.when(life.between(1, MOST_LIFE), _candidate("life_years", life, life.cast("string"), F.lit("first_number"), F.lit(LIFE_CONFIDENCE), F.lit(None))))
    if kind == "schedule":
        largest = F.array_max(F.transform("_money", lambda m: m["value"]))
        fits = _holds(low, TABLE_WORDS) & ~_holds(low, DETAIL_WORDS) & largest.isNotNull()
        instead = F.when(fits, _candidate("attachment_total", largest, largest.cast("string"), F.lit("largest_plausible_schedule_amount"), F.lit(LARGEST_CONFIDENCE), F.substring(page, 1, 250)))
        found[0] = F.coalesce(found[0], instead)
    return F.array_compact(F.array(*found))


def page_candidates(pages: DataFrame, key: list[str], page: str, text: str, words: str | None = None) -> DataFrame:
    """(key, page, page_type, seq, field, value, raw, rule, confidence, evidence) of the fields that each kind of page is read for.

    ``pages`` has ``page_type``; with ``words`` the boxes' texts follow the page's own. Pages of kinds that hold no field are not read.
    """
    shown = F.array_join(F.transform(words, lambda w: F.coalesce(w["text"], F.lit(""))), " ") if words else F.lit("")
    whole = texts.collapse(F.concat_ws(" ", F.coalesce(F.col(text), F.lit("")), shown))
    read = labels.measured(pages.where(F.col("page_type").isin(*LOOKED_FOR)).select(*key, page, "page_type", whole.alias("_whole")), F.col("_whole")).withColumn("_low", F.lower("_page"))
    by_kind = F.coalesce(*[F.when(F.col("page_type") == kind, _of_kind(kind)) for kind in LOOKED_FOR])
    exploded = read.select(*key, page, "page_type", F.posexplode(by_kind).alias("seq", "c"))
    return exploded.select(*key, page, "page_type", F.col("seq").cast("bigint").alias("seq"), "c.*")


def context_candidates(pages: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """(key, page, page_type, seq, field, label, value, raw, score, confidence, evidence) of every amount and year by the words around it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(texts.collapse(whole))
    kind = F.coalesce(*[F.when(_holds(low, words), name) for name, words in CONTEXT_KINDS], F.lit("unknown"))
    read = pages.withColumn("_kind", kind)

    def around(s: Column, n: int) -> Column:
        start = F.greatest(s["start"] - n, F.lit(0))
        return F.substring(whole, start + 1, s["end"] + n - start)

    def amount(s: Column) -> Column:
        context = around(s, AROUND_MONEY)
        said = F.lower(texts.collapse(context))
        return texts.let(F.struct(texts.number(s["value"]).alias("value"), said.alias("said"), F.trim(context).alias("evidence"), s["value"].alias("raw")), _scored)

    def _scored(a: Column) -> Column:
        said, value, k = a["said"], a["value"], F.col("_kind")

        def with_label(label: Column) -> Column:
            base = F.coalesce(*[F.when(label == name, float(points)) for name, _, points in CONTEXT_LABELS], F.lit(0.0))
            of_kind = sum((F.when((k == name) & label.isin(*fits), float(points)).otherwise(0.0) for name, (points, fits) in KIND_ADDS.items()), F.lit(0.0))
            of_words = sum((F.when(F.contains(said, F.lit(w)), float(points)).otherwise(0.0) for w, points in WORDS_ADD.items()), F.lit(0.0))
            noise = sum((F.when(F.contains(said, F.lit(w)), float(NOISE_TAKES * n)).otherwise(0.0) for w, n in NOISE_WORDS), F.lit(0.0))
            limits = F.when(texts.form_limit(value, texts.DOLLAR_LIMITS) & _holds(said, ("or more", "section 5")), float(LIMIT_TAKES)).otherwise(0.0)
            score = base + of_kind + of_words - noise - limits - F.when(value < SMALL, float(SMALL_TAKES)).otherwise(0.0) + F.when(F.col(page) == 1, FIRST_PAGE_ADDS).otherwise(0.0) + F.when(_holds(said, NEAR_WORDS), float(NEAR_ADDS)).otherwise(0.0)
            faith = label.isin("good_faith_value", "market_value")
            dropped = faith & ((k.isin("attachment", "schedule_e", "unknown") & ~F.contains(said, F.lit("total"))) | _holds(said, ("not more than", "or less")))
            field = F.coalesce(*[F.when(label == a_, F.lit(b_)) for a_, b_ in FIELD_OF.items()], label)
            return F.struct(field.alias("field"), label.alias("label"), value.alias("value"), a["raw"].alias("raw"), score.alias("score"), F.round(F.least(F.greatest(score / 20, F.lit(0.05)), F.lit(0.95)), 3).alias("confidence"), a["evidence"].alias("evidence"), dropped.alias("dropped"))

        return texts.let(F.coalesce(*[F.when(_holds(said, words), name) for name, words, _ in CONTEXT_LABELS], F.lit("unknown")), with_label)

    def year(s: Column) -> Column:
        context = around(s, AROUND_YEAR)
        label = F.lit("acquisition_year")
        return F.struct(label.alias("field"), label.alias("label"), s["value"].cast("double").alias("value"), s["value"].alias("raw"), F.lit(YEAR_SCORE).alias("score"), F.lit(YEAR_CONFIDENCE).alias("confidence"), F.trim(context).alias("evidence"), (~_holds(F.lower(texts.collapse(context)), YEAR_WORDS)).alias("dropped"))

    money = F.filter(texts.spans(whole, CONTEXT_MONEY), lambda s: texts.let(texts.number(s["value"]), lambda v: (v >= 100) & ~texts.year_like(v, 1900, 2100)))
    every = F.concat(F.transform(money, amount), F.transform(texts.spans(whole, texts.YEAR_IN_TEXT), year))
    kept = F.filter(every, lambda c: ~c["dropped"] & (c["score"] > 0))
    out = read.select(*key, page, F.col("_kind").alias("page_type"), F.posexplode(kept).alias("seq", "c")).select(*key, page, "page_type", F.col("seq").cast("bigint").alias("seq"), "c.*")
    return out.withColumn("score", F.round("score", 2)).drop("dropped")


def scored(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``score``: the confidence with what the kind of the page adds or takes, at least 0."""
    of = lambda table: F.coalesce(*[F.when((F.col("field") == f) & (F.col("page_type") == k), F.lit(v)) for (f, k), v in table.items()], F.lit(0.0))
    return candidates.withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("confidence") + of(BOOSTS) - of(PENALTIES)), 4))


def deduped(candidates: DataFrame, key: list[str], page: str) -> DataFrame:
    """Candidates of equal field, value, page and kind once: the best scored, then the first."""
    return keep.best_of(candidates, [*key, "field", "value", page, "page_type"], F.struct(F.col("score"), (-F.col("seq")).alias("s")))


def best_fields(candidates: DataFrame, key: list[str], page: str) -> DataFrame:
    """The best scored candidate of each field of a document, the first on ties."""
    first = F.struct(F.col("score"), (-F.col(page)).alias("p"), (-F.col("seq")).alias("s"))
    return keep.best_of(candidates, [*key, "field"], first)


def buckets(candidates: DataFrame, key: list[str], page: str, most: int | None = None) -> DataFrame:
    """The candidates of each field in the order of their scores, with their rank; the first ``most`` of them."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "field").orderBy(F.desc("score"), page, "seq")).cast("bigint"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def resolved(pages: DataFrame, key: list[str], page: str, text: str, words: str | None = None) -> DataFrame:
    """(key, field, value, page_type, rule, score) of every field of every document, from its pages."""
    found = page_candidates(classified(pages, key, page, text), key, page, text, words)
    return best_fields(scored(found), key, page).select(*key, "field", "value", "page_type", "rule", "score")


def overridden(fields: DataFrame, overrides: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """``fields`` (key, field, value) with the values that ``overrides`` (key, field, value) states, and the fields it adds."""
    side = overrides.where(F.col(value).isNotNull()).select(*key, "field", F.col(value).alias("_stated"))
    joined = fields.join(side, [*key, "field"], "full_outer")
    return joined.withColumn("overridden", F.col("_stated").isNotNull()).withColumn(value, F.coalesce("_stated", value)).drop("_stated")


ITEM_KEY = ("schedule", "subsection", "year_acquired", "historical_cost", "good_faith_value", "exact_value")


def line_items(pages: DataFrame, key: list[str], page: str, page_id: str, text: str, words: str) -> DataFrame:
    """(key, page, schedule, subsection, year_acquired, historical_cost, good_faith_value, exact_value, raw_text, confidence) of all pages, equal items of a page once.

    Schedules A to D come from the lines of their sections, E from the places of the words on pages that name it; from its lines
    only where a page has no words. ``page_id`` is a unique number of the page.
    """
    base = [*key, page]
    of_text = rows.schedule_rows(pages, [*base, page_id, words], text).withColumn("boxed", F.coalesce(F.size(words), F.lit(0)) > 0)
    columns = [*base, "schedule", "subsection", "year_acquired", "historical_cost", "good_faith_value", "exact_value", "raw_text", "confidence"]
    lines = of_text.where("schedule <> 'E' OR NOT boxed").select(columns)
    with_e = pages.where(F.contains(texts.mended_upper(F.col(text)), F.lit("SCHEDULE E")))
    boxed = page_subsection_rows(with_e, page_id, words).join(with_e.select(F.col(page_id).cast("bigint").alias("page_id"), *base), "page_id")
    boxed = boxed.select(*base, F.lit("E").alias("schedule"), "subsection", F.col("year").alias("year_acquired"), F.col("cost").alias("historical_cost"), F.col("value").alias("good_faith_value"), F.lit(None).cast("double").alias("exact_value"), F.col("row_text").alias("raw_text"), "confidence")
    every = lines.unionByName(boxed).withColumn("subsection", texts.section_name(F.col("subsection"))).withColumn("_text", F.upper(texts.collapse(F.col("raw_text"))))
    return keep.best_of(every, [*base, *ITEM_KEY, "_text"], F.struct("confidence", "raw_text")).drop("_text")
