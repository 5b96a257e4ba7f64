"""Column functions over text: white space, repair, money, years, slugs, emails, file stems, lines, wrapping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amounts that forms print themselves, bounds of amounts and years, and the patterns of both in text.
FORM_LIMITS = (20_000.0, 50_000.0, 125_000.0, 150_000.0)
DOLLAR_LIMITS = (20_000.0, 125_000.0)
LEAST_MONEY, MOST_MONEY = 100.0, 1e9
MONEY_IN_TEXT = r"\$\s?\d[\d,]*(?:\.\d\d)?"
MONEY = r"(?<!\w)\(?\$?\s*(?:\d{1,3}(?:[\s,]\d{3})+(?:\.\d{1,2})?|\d{2,9}(?:\.\d{1,2})?)\)?(?!\w)"
MONEY_TOKEN = r"\$?\s*[0-9Oo][0-9Oo,\s.]{0,20}(?:\.\d{1,2})?"
YEAR_IN_TEXT = r"\b(?:19[5-9]\d|20[0-4]\d)\b"
# Misreadings and what they stand for, in the order in which they are mended.
LOWER_REPAIRS = {"|": "l", "\\": "", "/": "", "schidule": "schedule", "renditlon": "rendition", "rendilion": "rendition", "valuo": "value", "equipmenl": "equipment"}
UPPER_REPAIRS = {
    "AFIACIIED": "ATTACHED", "SCHIDULE": "SCHEDULE", "FUMILURE": "FURNITURE", "EQUIPMENL": "EQUIPMENT", "EQULPMENT": "EQUIPMENT", "MACHLNERY": "MACHINERY", "VALUO": "VALUE", "N,LA.KEL": "MARKET", "SECTTON": "SECTION",
    "ATRMALRON": "AFFIRMATION", "PROPORTY": "PROPERTY", "TAXABL6": "TAXABLE", "PROP€RTY": "PROPERTY", "AJSINESS": "BUSINESS", "FUMITURE": "FURNITURE", "L\\RACHINERY": "MACHINERY", "RENDITLON": "RENDITION", "RENDILION": "RENDITION",
}
#: Words of a table's head, which make a line no row.
HEAD_WORDS = ("GOOD FAITH", "HISTORICAL COST", "YEAR ACQUIRED", "ACTUAL COST")


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it, also inside of lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def collapse(text: Column) -> Column:
    """White space of any kind, also no-break blanks and NULs, as single blanks; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x00]+", " "))


def _mended(text: Column, repairs: dict[str, str]) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), repairs.items(), text)


def mended_lower(text: Column) -> Column:
    """A text on one line in lower case, usual misreadings mended; offsets may differ from those of the text."""
    return mended_line(collapse(text))


def mended_line(line: Column) -> Column:
    """``mended_lower`` of a text that is on one line already."""
    return _mended(F.lower(line), LOWER_REPAIRS)


def mended_upper(text: Column) -> Column:
    """A text in upper case, usual misreadings mended, blanks as one, lines kept."""
    return F.regexp_replace(_mended(F.upper(_blank(text)), UPPER_REPAIRS), r"(?U)[^\S\r\n]+", " ")


def money(text: Column) -> Column:
    """The amount written in a text, NULL if there is none.

    The letter O counts as zero. Parts between blanks run together, but a lone 2 to 9 before a part with thousands is a
    stray mark. The last separator alone decides: a point after commas, or alone, is the decimal mark; so is a comma
    that does not part thousands; several points part thousands.
    """
    plain = F.translate(F.regexp_replace(text, r"^[($)\s]+|[($)\s]+$", ""), "Oo$", "00")
    return let(F.split(F.trim(plain), r"\s+"), lambda parts: let(_run(parts), _amount))


def _run(parts: Column) -> Column:
    """The parts of an amount run together, without stray marks."""
    stray = lambda part, i: part.rlike(r"^[2-9]$") & F.coalesce(F.get(parts, i + 1).rlike(r"^\d{2,3},\d{3}(?:\.\d{1,2})?(?!\d)"), F.lit(False))
    return F.array_join(F.filter(parts, lambda part, i: ~stray(part, i)), "")


def _amount(run: Column) -> Column:
    """The number in digits and separators."""
    comma, points = F.contains(run, F.lit(",")), F.regexp_count(run, F.lit(r"\."))
    number = (
        F.when(comma & (points == 0) & ~run.rlike(r"^\d{1,3}(,\d{3})+$"), F.translate(run, ",", "."))
        .when(~comma & (points > 1), F.translate(run, ".", ""))
        .otherwise(F.translate(run, ",", ""))
    )
    return let(number, lambda n: F.when(n.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), n.try_cast("double")))


def year_like(value: Column, low: int = 1900, high: int = 2049) -> Column:
    """Whether an amount is a whole number that is more likely a year."""
    return (value == F.floor(value)) & value.between(low, high)


def plausible_money(value: Column, least: float = LEAST_MONEY, most: float = MOST_MONEY) -> Column:
    return value.between(least, most) & ~year_like(value)


def form_limit(value: Column, limits: tuple[float, ...] = FORM_LIMITS) -> Column:
    """Whether an amount is one that the form prints itself."""
    return value.isin(*limits)


def amounts(text: Column) -> Column:
    """The amounts with a dollar sign in a text, in reading order."""
    return F.transform(F.regexp_extract_all(text, F.lit(MONEY_IN_TEXT), F.lit(0)), lambda t: money(F.regexp_replace(t, r"[,\s]", "")))


def reported_amounts(text: Column) -> Column:
    """The plausible amounts with a dollar sign that are no limits of the form, in reading order."""
    return F.filter(amounts(text), lambda v: plausible_money(v) & ~form_limit(v, DOLLAR_LIMITS))


def money_tokens(text: Column) -> Column:
    """(raw, value) of the runs of digits, blanks and separators that read as an amount of at least 100 and no year.

    A run of bare numbers with a year among them is no amount.
    """
    raw = F.transform(F.regexp_extract_all(text, F.lit(MONEY_TOKEN), F.lit(0)), lambda t: F.trim(t))
    read = F.transform(raw, lambda t: F.struct(t.alias("raw"), money(t).alias("value")))

    def keeps(t: Column) -> Column:
        compact = F.trim(F.replace(t["raw"], F.lit("$"), F.lit("")))
        groups = F.regexp_extract_all(compact, F.lit(r"\d{3,4}"), F.lit(0))
        bare = F.contains(compact, F.lit(" ")) & ~compact.rlike("[,.]") & (F.size(groups) >= 2) & F.exists(groups, lambda g: g.rlike(rf"^{YEAR_IN_TEXT}$"))
        return (t["value"] >= LEAST_MONEY) & ~year_like(t["value"], 1900, 2100) & ~bare

    return F.filter(read, keeps)


def money_mark(text: Column) -> Column:
    """The first run of digits and separators in a text, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"\d[\d,.]{2,}", 0), F.lit(""))


def rereads(text: Column, again: Column) -> Column:
    """Whether a second reading of an amount mends the first: bare digits before, commas now, the same digits or one less."""
    return let(F.struct(money_mark(text).alias("a"), money_mark(again).alias("b")), _rereads)


def _rereads(read: Column) -> Column:
    a, b = read["a"], read["b"]
    x, y = F.regexp_replace(a, r"\D", ""), F.regexp_replace(b, r"\D", "")
    one_less = F.exists(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))) == y)
    mends = ~a.rlike("[,.]") & F.contains(b, F.lit(",")) & money(a).isNotNull() & money(b).isNotNull() & ((x == y) | ((F.length(x) == F.length(y) + 1) & one_less))
    return F.coalesce(mends, F.lit(False))


def number(text: Column) -> Column:
    """A number as typed into a table: one comma or point before three digits parts thousands, other commas do too."""
    raw = F.trim(F.replace(text, F.lit("$"), F.lit("")))
    plain = F.when(raw.rlike(r"^\d{1,3}[.,]\d{3}$"), F.regexp_replace(raw, "[.,]", "")).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    return F.when(plain.rlike(r"^-?\d+(\.\d*)?$|^-?\.\d+$"), plain.try_cast("double"))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR_IN_TEXT), F.lit(0)), lambda t: t.cast("int"))


def tax_year(text: Column) -> Column:
    """A tax year however it is written: 2021, TY2021, 2021.0, '21."""
    whole = F.regexp_extract(text, r"(20\d\d)", 1)
    return F.coalesce(F.nullif(whole, F.lit("")), F.concat(F.lit("20"), F.nullif(F.regexp_extract(text, r"'(\d\d)", 1), F.lit("")))).cast("int")


def spans(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match of ``pattern`` in reading order, offsets in characters from 0, end exclusive.

    The offsets come from the lengths of what stands between the matches; patterns must not match the empty string.
    """
    none = F.array().cast("ARRAY<STRUCT<start: INT, end: INT, value: STRING>>")

    def add(done: Column, m: Column) -> Column:
        start = done["at"] + m["gap"]
        end = start + F.length(m["value"])
        return F.struct(end.alias("at"), F.array_append(done["out"], F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))).alias("out"))

    def with_gaps(found: Column) -> Column:
        before = F.slice(F.split(_blank(text), pattern, -1), 1, F.size(found))
        pairs = F.zip_with(found, before, lambda v, g: F.struct(v.alias("value"), F.length(g).alias("gap")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda done: done["out"])

    return let(F.regexp_extract_all(_blank(text), F.lit(pattern), F.lit(0)), with_gaps)


def money_spans(text: Column) -> Column:
    """(start, end, raw, value) of every plausible amount in a text."""
    read = F.transform(spans(text, MONEY), lambda s: F.struct(s["start"], s["end"], F.trim(s["value"]).alias("raw"), money(s["value"]).alias("value")))
    return F.filter(read, lambda s: plausible_money(s["value"]))


def year_spans(text: Column) -> Column:
    """(start, end, value) of every year in a text."""
    return F.transform(spans(text, YEAR_IN_TEXT), lambda s: F.struct(s["start"], s["end"], s["value"].cast("int").alias("value")))


def first_of(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """Group 1, on one line, of the first of several patterns that matches with any; NULL if none does."""
    return F.coalesce(*[F.nullif(collapse(F.regexp_extract(text, flags + p, 1)), F.lit("")) for p in patterns])


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_blank(text))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def district_slug(name: Column) -> Column:
    """The slug of a district's name, its long ending shortened; ``district`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(slug(name), r"-(?:central-|county-)?appraisal-district$", "-cad"), F.lit("")), F.lit("district"))


def email(text: Column) -> Column:
    return F.lower(F.trim(text))


def email_domain(text: Column) -> Column:
    e = email(text)
    return F.when(F.contains(e, F.lit("@")), F.nullif(F.regexp_extract(e, r"^[^@]*@(.*)$", 1), F.lit("")))


def safe_stem(name: Column, otherwise: str = "rendition") -> Column:
    """The stem of a file name with anything unusual as ``_``."""
    last = F.regexp_replace(_blank(name), r"^.*/(?=[^/])|/+$", "")
    stem = F.regexp_replace(last, r"(?<=[^.])\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit(otherwise))


def safe_account(account: Column) -> Column:
    """An account's letters and digits in upper case, empty for NULL."""
    return F.upper(F.regexp_replace(_blank(account), r"[^A-Za-z0-9]", ""))


def section_name(name: Column) -> Column:
    """A subsection's name in lower case with ``_`` between its words, NULL if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(""))


def state_key(text: Column) -> Column:
    """A status without case, punctuation and surplus blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def snippet(text: Column, at: Column, around: int = 90) -> Column:
    """The text around a 1-based position, NULL where the position is 0."""
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.trim(F.substring(text, start, at + around - start)))


def evidence(text: Column, start: Column, end: Column, around: int = 90) -> Column:
    """A span of a text with what stands around it, on one line."""
    low = F.greatest(start - around, F.lit(0))
    return collapse(F.substring(text, low + 1, end + around - low))


def block(text: Column, start: str, stop: str) -> Column:
    """The text from ``start`` up to the next ``stop`` or the end, empty without ``start``."""
    at = F.locate(start, text)
    after = F.position(F.lit(stop), text, at)
    return F.when(at > 0, F.substring(text, at, F.when(after > 0, after - at).otherwise(F.length(text)))).otherwise("")


def dollars(value: Column) -> Column:
    """An amount for readers, ``-`` if there is none."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 2)), F.lit("-"))


def percent(value: Column) -> Column:
    return F.coalesce(F.concat(F.regexp_replace(F.format_number(value * 100, 2), ",", ""), F.lit("%")), F.lit("-"))


def shown(value: Column, kind: str = "string") -> Column:
    """A value for readers: lists joined by bars, truth as YES or NO, ``-`` for none."""
    if kind.startswith("array"):
        return F.coalesce(F.nullif(F.array_join(value, " | "), F.lit("")), F.lit("-"))
    if kind == "boolean":
        return F.when(value, "YES").otherwise("NO")
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("-"))


def candidate_lines(text: Column) -> Column:
    """Lines that may hold a row: not blank, no headings, heads or totals, at least four characters."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), collapse)
    return F.filter(lines, lambda x: (F.length(x) >= 4) & ~F.upper(x).rlike(rf"^SCHEDULE |TOTAL|{'|'.join(HEAD_WORDS)}"))


def wrapped(text: Column, width: int = 48, most: int | None = None) -> Column:
    """The words of a text in lines of at most ``width`` characters, the first ``most`` of them; longer words stand alone."""
    words = F.filter(F.split(_blank(text), r"(?U)\s+"), lambda w: w != "")

    def add(lines: Column, word: Column) -> Column:
        n = F.size(lines)
        last = F.get(lines, n - 1)
        fits = (n > 0) & (F.length(last) + 1 + F.length(word) <= width)
        longer = F.concat(F.slice(lines, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", last, word)))
        return F.when(fits, longer).otherwise(F.array_append(lines, word))

    lines = F.aggregate(words, F.array().cast("ARRAY<STRING>"), add)
    return lines if most is None else F.slice(lines, 1, most)


def missing(wanted: list[str], found: Column) -> Column:
    """The members of a stated list that an array lacks, in their order."""
    return F.array_except(F.array(*[F.lit(w) for w in wanted]), found)


def by_like(text: Column, cases: list[tuple[str, object]], otherwise: object = None) -> Column:
    """The value of the first LIKE pattern that a lower-case text matches."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.like(pattern), F.lit(value)) for pattern, value in cases], F.lit(otherwise))


# Marks of a checked box, and by flag the words that show it: anywhere on the page, or checked within a section's block.
CHECKED = r"[☑✓✔☒🗹X?]\s*"
PRESENT_FLAGS = {
    "see_attached": ("SEE ATTACHED", "SEE ATTAC"), "section_3_present": ("SECTION 3",), "section_5_present": ("SECTION 5",), "section_5_over_20k_detected": ("20,000", "20OOOO", "UNDER$2OOOO"),
    "section_5_125k_language_detected": ("125,000", "125 OOO OR", "125000 OR LESS"),
}
CHECKED_FLAGS = {
    "section_3_prior_year_checked": ("SECTION 3", "SECTION 4", r"BY CHECKING THIS BOX"), "section_5_under_20k_checked": ("SECTION 5", "SECTION 6", r"UNDER\s*\$?\s*20,000"),
    "section_5_20k_or_more_checked": ("SECTION 5", "SECTION 6", r"\$?\s*20,000\s+OR\s+MORE"), "section_5_125k_or_less_checked": ("SECTION 5", "SECTION 6", r"\$?\s*125,000\s+OR\s+LESS"),
    "section_5_more_than_125k_checked": ("SECTION 5", "SECTION 6", r"MORE\s+THAN\s+\$?\s*125,000"),
}
SIGNATURE_WORDS, LEAST_SIGNATURE_WORDS = ("SECTION 6", "AUTHORIZED INDIVIDUAL", "SUBSCRIBED AND SWORN", "PRINTED NAME", "DATE", "SIGN"), 2


def form_flags(page: Column) -> Column:
    """What the first page of a form shows, one BOOLEAN member a flag: words that stand on it, and boxes that are checked."""

    def read(t: Column) -> Column:
        holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w))
        flat = F.regexp_replace(t, r"\s+", " ")
        flags = [holds(words).alias(name) for name, words in PRESENT_FLAGS.items()]
        flags += [block(flat, start, stop).rlike(CHECKED + pattern).alias(name) for name, (start, stop, pattern) in CHECKED_FLAGS.items()]
        clues = sum((F.when(F.contains(t, F.lit(w)), 1).otherwise(0) for w in SIGNATURE_WORDS), F.lit(0))
        return F.struct(*flags, (clues >= LEAST_SIGNATURE_WORDS).alias("signature_block_detected"))

    return let(mended_upper(page), read)
