"""Amounts and years beside their labels in page text: a band join of label places and spans, within the row.

Labels and spans of one page are arrays of that page's row, so the join of every label with every span in its band is an
expression over two short arrays: nothing is exploded and nothing is shuffled, however many pages there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import text as texts

# How far a span may stand before its label and after it, what closeness and the words around add or take, and
# the words that do; amounts that the form prints itself don't count beside words of a limit.
BEFORE_MONEY, AFTER_MONEY, CLOSE_MONEY = 40, 180, 0.10
BEFORE_YEAR, AFTER_YEAR, CLOSE_YEAR = 30, 120, 0.08
AROUND = 35
TOTAL_WORD, TOTAL_ADDS = "total", 0.04
NOISE, NOISE_TAKES = ("phone", "fax", "zip", "account", "page"), 0.20
LIMIT_WORDS, LIMIT_TAKES = ("not more than", "or less", "under $20", "$20,000 or more"), 0.60
DROP_WORDS = ("not more than", "or less", "under", "or more", "tax code")
MOST_MONEY_CONFIDENCE, MOST_YEAR_CONFIDENCE = 0.98, 0.96


def label_places(mended: Column, labels: list[str]) -> Column:
    """(at, label, first) of the first place of each label in a mended lower-case text, from 0; ``first`` is minus its number."""
    places = [F.struct((F.locate(label, mended) - 1).alias("at"), F.lit(label).alias("label"), F.lit(-i).alias("first")) for i, label in enumerate(labels)]
    return F.filter(F.array(*places), lambda h: h["at"] >= 0)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _closeness(distance: Column, after: int, most: float) -> Column:
    return F.greatest(F.lit(0.0), (after - F.abs(distance)) / after) * most


def measured(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with what all fields of a page are looked for in: ``_page`` its text, ``_mended``, ``_money`` and ``_years`` the spans in it."""
    staged = df.withColumn("_page", F.coalesce(text, F.lit("")))
    return staged.withColumns({"_mended": texts.mended_lower(F.col("_page")), "_money": texts.money_spans(F.col("_page")), "_years": texts.year_spans(F.col("_page"))})


MEASURES = ("_page", "_mended", "_money", "_years")


def best_amount(mended: Column, money: Column, labels: list[str], base: float, before: int = BEFORE_MONEY, after: int = AFTER_MONEY) -> Column:
    """The amount that best fits any of the labels: (score, value, raw, label, start, end, confidence), NULL if none is in the band.

    Ties in score go to the larger amount, then to the label listed first, then to the amount that stands first.
    """

    def pair(h: Column, m: Column) -> Column:
        low = F.greatest(h["at"] - AROUND, F.lit(0))
        return F.struct(h.alias("h"), m.alias("m"), F.substring(mended, low + 1, m["end"] + AROUND - low).alias("around"))

    def score(p: Column) -> Column:
        words = p["around"]
        plus = F.when(F.contains(words, F.lit(TOTAL_WORD)), TOTAL_ADDS).otherwise(0.0)
        minus = F.when(_any_of(words, NOISE), NOISE_TAKES).otherwise(0.0) + F.when(_any_of(words, LIMIT_WORDS), LIMIT_TAKES).otherwise(0.0)
        s = F.lit(base) + _closeness(p["m"]["start"] - p["h"]["at"], after, CLOSE_MONEY) + plus - minus
        return F.struct(
            s.alias("score"), p["m"]["value"].alias("value"), p["h"]["first"].alias("first"), (-p["m"]["start"]).alias("place"),
            p["m"]["raw"].alias("raw"), p["h"]["label"].alias("label"), p["m"]["start"].alias("start"), p["m"]["end"].alias("end"),
        )

    near = F.flatten(F.transform(label_places(mended, labels), lambda h: F.transform(F.filter(money, lambda m: (m["start"] - h["at"]).between(-before, after)), lambda m: pair(h, m))))
    best = F.array_max(F.transform(F.filter(near, lambda p: ~(texts.form_limit(p["m"]["value"]) & _any_of(p["around"], DROP_WORDS))), score))
    return texts.let(best, lambda b: b.withField("confidence", F.round(F.least(b["score"], F.lit(MOST_MONEY_CONFIDENCE)), 3)))


def best_year(mended: Column, years: Column, labels: list[str], base: float, before: int = BEFORE_YEAR, after: int = AFTER_YEAR) -> Column:
    """The year nearest to any of the labels: (score, value, label, start, end, confidence), NULL if none is in the band.

    Ties go to the label listed first, then to the year that stands first.
    """

    def score(h: Column, y: Column) -> Column:
        s = F.lit(base) + _closeness(y["start"] - h["at"], after, CLOSE_YEAR)
        return F.struct(s.alias("score"), h["first"].alias("first"), (-y["start"]).alias("place"), y["value"].alias("value"), h["label"].alias("label"), y["start"].alias("start"), y["end"].alias("end"))

    near = F.flatten(F.transform(label_places(mended, labels), lambda h: F.transform(F.filter(years, lambda y: (y["start"] - h["at"]).between(-before, after)), lambda y: score(h, y))))
    return texts.let(F.array_max(near), lambda b: b.withField("confidence", F.round(F.least(b["score"], F.lit(MOST_YEAR_CONFIDENCE)), 3)))


def candidates(df: DataFrame, key: list[str], text: str, amounts: dict[str, tuple[list[str], float]], years: dict[str, tuple[list[str], float]] | None = None) -> DataFrame:
    """(key, field, value, raw, rule, confidence, evidence) of the best candidate of each field on each page.

    ``amounts`` and ``years`` give each field's labels and base confidence. Pages without a candidate give no row; NULL texts
    have none.
    """
    page, mended, money, spans = (F.col(c) for c in MEASURES)
    found = [texts.let(best_amount(mended, money, labels, base), _row(field, page, True)) for field, (labels, base) in amounts.items()]
    found += [texts.let(best_year(mended, spans, labels, base), _row(field, page, False)) for field, (labels, base) in (years or {}).items()]
    read = measured(df.select(*key, F.col(text).alias("_text")), F.col("_text"))
    return read.select(*key, F.explode(F.array_compact(F.array(*found))).alias("c")).select(*key, "c.*")


def _row(field: str, page: Column, amount: bool) -> Callable[[Column], Column]:
    """A function from the best candidate of a field to its row, NULL if there is none."""

    def row(best: Column) -> Column:
        raw = best["raw"] if amount else best["value"].cast("string")
        whole = F.struct(
            F.lit(field).alias("field"), best["value"].cast("double").alias("value"), raw.alias("raw"), F.concat(F.lit("near_label:"), best["label"]).alias("rule"), best["confidence"].alias("confidence"),
            texts.evidence(page, best["start"], best["end"]).alias("evidence"),
        )
        return F.when(best.isNotNull(), whole)

    return row
