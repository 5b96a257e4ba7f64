"""Rows in the text of schedule sections: lines with amounts and years, as line items; totals of a page's text.

Everything is an expression over the lines of one page, so pages are read where they are, without a shuffle.

Defined results: NULL and empty texts give no rows; lines without an amount are no rows; of a letter's sections the last counts;
equal lines each give a row (``keep.best_of`` takes equal rows as one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import text as texts
from cadastra.operators.sequence import parts_of

# The phrases that begin a subsection, the first of them that a line holds; confidence of the rows of each kind.
PHRASES = {
    "furniture_fixtures": ("furniture and fixtures", "furniture fixtures"),
    "machinery_equipment": ("machinery and equipment", "machinery equipment"),
    "office_equipment": ("office equipment",),
    "computer_equipment": ("computer equipment",),
    "pos_servers_mainframes": ("pos", "servers", "mainframes"),
    "other": ("other",),
}
CONFIDENCE = {"A": 0.66, "D": 0.66, "B": 0.7, "C": 0.7, "E": 0.58}
# Amounts with thousands, alone and after the words of a total.
_THOUSANDS = r"\b\d{1,3}(?:[,.]\d{3})+(?:\.\d{1,2})?\b"
_SPLIT = r"(\$?\s*\d(?:\s+)?\d{1,3}(?:[,.]\d{3})+(?:\.\d{1,2})?|\$?\s*\d{1,3}(?:[,.]\d{3})+(?:\.\d{1,2})?)"
SECTION_TOTALS = (rf"TOTAL(?:\s+[A-Z ]+)?[: ]+.*?{_SPLIT}", rf"GRAND\s+TOTAL(?:\s+[A-Z ]+)?[: ]+.*?{_SPLIT}")
_COMMAS = r"\$?\s*(?:\d\s+)?\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?"
ATTACHMENT_TOTALS = tuple(rf"{words}\s*({_COMMAS})" for words in (r"TOTAL\s+FIXED\s+ASSETS", r"GRAND\s+TOTAL", r"TOTAL\s+ASSETS", r"TOTAL\s+MARKET\s+VALUE"))
SUMMARY_CLUES = ("SUMMARY", "STATE CLASS", "REPORTED COST", "CURRENT VALUE", "RENDERED VALUE")


def _value(tokens: Column, at: int) -> Column:
    """The value of the token at a place, from the end if negative, NULL beyond the ends."""
    return F.get(tokens, F.size(tokens) + at if at < 0 else F.lit(at))["value"]


def _subsection(line: Column) -> Column:
    low = F.lower(line)
    holds = lambda phrases: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
    return F.coalesce(*[F.when(holds(phrases), F.lit(name)) for name, phrases in PHRASES.items()])


def _read(line: Column, letter: Column, running: Column) -> Column:
    """One line as a row of its section's kind: with a year or not, the amounts have other meanings."""

    def row(t: Column) -> Column:
        tokens, years = t["tokens"], t["years"]
        year = F.get(years, F.size(years) - 1)
        dated, several = year.isNotNull(), F.size(tokens) >= 2
        first_kind, exact_kind = letter.isin("A", "D"), letter.isin("B", "C")
        cost = F.when(first_kind & (dated | several), _value(tokens, -1)).when((letter == "E") & dated, _value(tokens, 0))
        value = F.when(first_kind, F.when(several, _value(tokens, -2)).when(~dated, _value(tokens, 0))).when((letter == "E") & (several | ~dated), _value(tokens, -1))
        return F.struct(
            F.when(letter == "E", running).alias("subsection"), F.when(~exact_kind, year).alias("year_acquired"), cost.alias("historical_cost"), value.alias("good_faith_value"),
            F.when(exact_kind, _value(tokens, -1)).alias("exact_value"), line.alias("raw_text"), F.transform(tokens, lambda m: m["raw"]).alias("money_tokens"), F.when(~exact_kind, years).alias("year_tokens"),
        )

    return texts.let(F.struct(texts.money_tokens(line).alias("tokens"), texts.years(line).alias("years")), row)


def schedule_rows(df: DataFrame, key: list[str], text: str, letters: str = "ABCDE") -> DataFrame:
    """(key, schedule, pos, subsection, year_acquired, historical_cost, good_faith_value, exact_value, raw_text, money_tokens, year_tokens, confidence).

    Rows of schedules A and D: with a year, the last amount is the cost and the one before it the value; without, two amounts are
    value and cost, one the value. B and C: the last amount, exactly. E: rows of the subsection whose phrase came last, with a year
    the first amount is the cost and the last of several the value, without one the last is the value. ``pos`` counts the lines
    of a section that may be rows.
    """

    def of_section(s: Column) -> Column:
        def with_marks(lines: Column) -> Column:
            marked = F.transform(lines, lambda x: F.struct(x.alias("line"), _subsection(x).alias("mark")))

            def rows(marked: Column) -> Column:
                running = lambda i: F.element_at(F.filter(F.slice(marked, 1, i + 1), lambda m: m["mark"].isNotNull()), -1)["mark"]
                return F.transform(marked, lambda m, i: F.struct(s["letter"].alias("schedule"), (i + 1).cast("bigint").alias("pos"), _read(m["line"], s["letter"], F.when(F.exists(F.slice(marked, 1, i + 1), lambda m: m["mark"].isNotNull()), running(i))).alias("r")))

            return texts.let(marked, rows)

        return texts.let(texts.candidate_lines(s["body"]), with_marks)

    sections = F.filter(parts_of(F.col(text), last_only=True), lambda s: s["letter"].isin(*letters))
    rows = df.select(*key, F.explode(F.flatten(F.transform(sections, of_section))).alias("x")).select(*key, "x.schedule", "x.pos", "x.r.*")
    confidence = F.coalesce(*[F.when(F.col("schedule") == letter, F.lit(c)) for letter, c in CONFIDENCE.items()])
    return rows.where((F.size("money_tokens") > 0) & ((F.col("schedule") != "E") | F.col("subsection").isNotNull())).withColumn("confidence", confidence)


def _labelled(text: Column, patterns: tuple[str, ...], limits: bool) -> Column:
    """The amounts after the words of any of the patterns."""
    values = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), texts.money) for p in patterns]))
    return F.filter(values, lambda v: v.isNotNull() & (~texts.form_limit(v) if limits else F.lit(True)))


def section_total(text: Column) -> Column:
    """(present, machinery, total) of the text of a page with SCHEDULE E: the largest labelled total, else the largest amount."""

    def read(t: Column) -> Column:
        every = F.filter(F.transform(F.regexp_extract_all(t, F.lit(_THOUSANDS), F.lit(0)), texts.money), lambda v: v.isNotNull() & ~texts.form_limit(v))
        present = F.contains(t, F.lit("SCHEDULE E"))
        total = F.coalesce(F.array_max(_labelled(t, SECTION_TOTALS, True)), F.array_max(every))
        machinery = F.contains(t, F.lit("MACHINERY AND EQUIPMENT")) | F.contains(t, F.lit("MACHINERY EQUIPMENT"))
        return F.struct(present.alias("present"), machinery.alias("machinery"), F.when(present, total).alias("total"))

    return texts.let(texts.mended_upper(text), read)


def attachment_summary(text: Column) -> Column:
    """(present, amounts, total) of the joined text of attachments: the largest labelled total, else, under a summary's words, the
    largest amount; ``amounts`` are the different ones, largest first."""

    def read(t: Column) -> Column:
        clues = sum((F.when(F.contains(t, F.lit(c)), 1).otherwise(0) for c in SUMMARY_CLUES), F.lit(0))
        every = F.filter(F.transform(F.regexp_extract_all(t, F.lit(_COMMAS + r"\b"), F.lit(0)), texts.money), lambda v: v.isNotNull() & ~texts.form_limit(v))
        labelled = _labelled(t, ATTACHMENT_TOTALS, False)
        amounts = F.sort_array(F.array_distinct(F.concat(every, labelled)), asc=False)
        present = (clues >= 2) | (F.size(labelled) > 0)
        return F.struct(present.alias("present"), amounts.alias("amounts"), F.coalesce(F.array_max(labelled), F.when(present, F.array_max(every))).alias("total"))

    return texts.let(texts.mended_upper(text), read)


def schedule_values(pages: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """(key, letter, pages, amounts, largest) of the schedules of a document: the pages they stand on, and the amounts with a dollar
    sign in their sections, each once, largest first."""
    sections = pages.select(*key, page, F.explode(parts_of(F.col(text), last_only=True)).alias("s"))
    seen = sections.select(*key, page, F.col("s.letter").alias("letter"), F.explode_outer(texts.reported_amounts(F.col("s.body"))).alias("v"))
    return seen.groupBy(*key, "letter").agg(F.array_sort(F.collect_set(page)).alias("pages"), F.sort_array(F.collect_set("v"), asc=False).alias("amounts"), F.max("v").alias("largest"))
