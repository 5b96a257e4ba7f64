"""Word boxes on pages: reading order, row bands, columns within a band, headings, year rows, subsection rows and totals.

Bands follow a running mean, which no built-in expression keeps, so Arrow functions read a page's words as an array: a
page is one row, bounded by what fits on paper, and pages never meet.

Defined results: NULL and empty pages give no rows; words without text are left out; NULL positions count as 0; repeated words
count each, repeated rows once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cadastra.session import flat_map

WORDS = "ARRAY<STRUCT<text: STRING, x0: DOUBLE, top: DOUBLE>>"
# Distances in the units of the page.
ROW, HEADING_ROW, TOTAL_ROW = 8.0, 12.0, 10.0
REACH = 220.0
LOWER_GROUP, GROUP_MARGIN = 200.0, 120.0
DOWN_WEIGHS = 2.5
LEAST_GAP, AFTER_TOTAL, BELOW_YEARS = 40.0, 20.0, 40.0
COLUMN_GAP, COLUMN_SHARE, COLUMN_EDGE = 160.0, 0.6, 25.0
LEAST_AMOUNT = 1000.0
SURE, UNSURE = 0.86, 0.74
LINE_HEIGHT, LETTER = 12.0, 6.0
#: The subsections with the words of their headings, in the order of their places on the form, three above and three below.
SUBSECTIONS = {
    "furniture_fixtures": ("FURNITURE AND FIXTURES", "FURNITURE FIXTURES"),
    "machinery_equipment": ("MACHINERY AND EQUIPMENT", "MACHINERY EQUIPMENT"),
    "office_equipment": ("OFFICE EQUIPMENT",),
    "computer_equipment": ("COMPUTER EQUIPMENT",),
    "pos_servers_mainframes": ("POS", "SERVERS", "MAINFRAMES"),
    "other": ("OTHER",),
}
#: A heading begins with one of these.
_HEADING_WORDS = frozenset(h.split()[0] for headings in SUBSECTIONS.values() for h in headings)
_YEAR = re.compile(r"20\d{2}")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\S+")
_AMOUNT = re.compile(r"\$?\d[\d,.\s]{2,}")
#: What a number may be written with.
_NUMBER_MARKS = re.compile(r"[\dOo,.\s$()-]+")
_STRAY = re.compile(r"(?<!\w)[2-9]\s+(?=\d{2,3},\d{3}(?!\d))")


class Word(NamedTuple):
    text: str
    x: float
    top: float


class Band(NamedTuple):
    top: float
    words: list[Word]


def placed(boxes: Iterable[dict] | None) -> list[Word]:
    """The words of a page that hold text."""
    read = (Word((b["text"] or "").strip(), b["x0"] or 0.0, b["top"] or 0.0) for b in boxes or ())
    return [w for w in read if w.text]


def lines_of(body: str | None, line_height: float = LINE_HEIGHT, letter: float = LETTER) -> Iterator[tuple[str, float, float]]:
    """(text, x, top) of the words of plain text: a line's number gives the height, a word's offset the position."""
    for n, line in enumerate((body or "").split("\n")):
        top = n * line_height
        for m in _WORD.finditer(line):
            yield m[0], m.start() * letter, top


def pages_of(column: pa.ListArray | pa.StringArray, may: Callable[[str], object] = bool) -> Iterator[list[Word]]:
    """``placed`` of each page of an Arrow column, without an object for each box.

    Texts are laid out as ``words_of_lines`` does, one after another; those that ``may`` refuses have no words.
    """
    if not pa.types.is_list(column.type):
        for text in column.to_pylist():
            yield [*map(Word._make, lines_of(text))] if text and may(text) else []
        return
    boxes = column.flatten()
    texts, lefts, tops = (a.to_pylist() for a in (dict(zip((f.name for f in boxes.type), boxes.flatten(), strict=True))[n] for n in ("text", "x0", "top")))
    words = ((Word(said, x or 0.0, y or 0.0) if t and (said := t.strip()) else None) for t, x, y in zip(texts, lefts, tops, strict=True))
    for n in pc.list_value_length(column).to_pylist():
        yield [w for w in islice(words, n or 0) if w]


def bands(words: Iterable[Word], tolerance: float) -> list[Band]:
    """Words by rows from the top: a word joins the first row whose mean height lies within ``tolerance``; in a row from the left.

    Means only grow as words come from the top, so rows that a word has left behind are never looked at again.
    """
    rows: list[list[Word]] = []
    sums: list[float] = []
    first = 0
    last = None
    for word in sorted(words, key=itemgetter(2)):
        if word.top == last:  # where the word before it went
            rows[first].append(word)
            sums[first] += last
            continue
        last = word.top
        while first < len(rows) and word.top - sums[first] / len(rows[first]) > tolerance:
            first += 1
        if first < len(rows):
            rows[first].append(word)
            sums[first] += word.top
        else:
            rows.append([word])
            sums.append(word.top)
    return [Band(s / len(r), sorted(r, key=itemgetter(1))) for r, s in zip(rows, sums, strict=True)]


def columns(row: list[Word], gap: float) -> list[list[Word]]:
    """Words of one row in runs without a gap wider than ``gap``."""
    cuts = [0, *[i for i in range(1, len(row)) if row[i].x - row[i - 1].x > gap], len(row)]
    return [row[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def read_amount(text: str) -> float | None:
    """The number a word shows: O is zero, a stray mark before thousands is none, the last kind of separator decides."""
    if not _NUMBER_MARKS.fullmatch(text):
        return None
    run = re.sub(r"\s", "", _STRAY.sub("", text.replace("$", "").translate(str.maketrans("Oo", "00")).strip("() ")))
    if "," in run and "." not in run and not re.fullmatch(r"\d{1,3}(,\d{3})+", run):
        run = run.replace(",", ".")
    run = run.replace(",", "")
    if run.count(".") > 1 and "," not in text:
        run = run.replace(".", "")
    return float(run) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", run) else None


def no_year(value: float | None) -> bool:
    return value is not None and not (value == int(value) and 1900 <= value <= 2100)


def amount(text: str) -> float | None:
    """The amount of a word that is nothing else: at least 1000 and no year."""
    value = read_amount(text) if _AMOUNT.fullmatch(text) else None
    return value if no_year(value) and value >= LEAST_AMOUNT else None


def loose_amount(text: str) -> float | None:
    """The amount of a word that stands in a row: any number from 1 on that is no year."""
    value = read_amount(text)
    return value if no_year(value) and value >= 1 else None


def loose_amounts(words: list[Word]) -> dict[str, float]:
    """The ``loose_amount`` of every text among ``words`` that has one; letters alone are never one."""
    return {t: v for t in {w.text for w in words} if not t.isalpha() and (v := loose_amount(t)) is not None}


def is_total(text: str) -> bool:
    return "TOTAL" in text.upper()


def year_rows(words: list[Word], tolerance: float = ROW, reach: float = REACH) -> list[tuple[int, float, float, float]]:
    """(year, amount, x, top) of the years with amounts beside them, the latest first.

    Words from the first total below the years on don't count. Each amount of a row, from the left, looks for its nearest year
    within reach; where that year has been taken the amount has none. An amount that a year has twice is the one farther right.
    """
    dates = [w for w in words if _YEAR.fullmatch(w.text)]
    sums = [(w, v) for w in words if not w.text.isalpha() and not _YEAR.fullmatch(w.text) and (v := amount(w.text)) is not None] if dates else []
    if not sums:
        return []
    below = min(w.top for w in dates) + BELOW_YEARS
    end = min((w.top for w in words if is_total(w.text) and w.top > below), default=float("inf")) - 10
    found: dict[tuple[int, int], tuple[int, float, float, float]] = {}
    for band in bands((w for w in dates if w.top < end), tolerance):
        taken = set()
        for word, value in sorted(((w, v) for w, v in sums if w.top < end and abs(w.top - band.top) <= tolerance), key=lambda s: s[0].x):
            nearest = min(band.words, key=lambda y: abs(y.x - word.x))
            place = (nearest.text, round(nearest.x))
            if abs(nearest.x - word.x) > reach or place in taken:
                continue
            taken.add(place)
            row = (int(nearest.text), value, word.x, band.top)
            known = found.get((row[0], round(value)))
            if known is None or word.x > known[2]:
                found[row[0], round(value)] = row
    return sorted(found.values(), key=lambda r: r[:2], reverse=True)


def heading_places(words: list[Word]) -> dict[str, tuple[float, float]]:
    """(x, top) of the topmost heading of each subsection, found as whole words side by side in one row."""
    found: dict[str, tuple[float, float]] = {}
    if _HEADING_WORDS.isdisjoint(" ".join([w.text for w in words]).upper().split()):
        return found
    for band in bands(words, HEADING_ROW):
        said = [w.text.upper() for w in band.words]
        begins = _HEADING_WORDS.intersection(said)
        if not begins:
            continue
        for name, headings in SUBSECTIONS.items():
            if name in found and found[name][1] <= band.top:
                continue
            for heading in (h.split() for h in headings):
                if heading[0] not in begins:
                    continue
                at = next((i for i in range(len(said) - len(heading) + 1) if said[i : i + len(heading)] == heading), None)
                if at is not None:
                    found[name] = (band.words[at].x, band.top)
                    break
    return found


def nearest_heading(x: float, top: float, headings: dict[str, tuple[float, float]]) -> str | None:
    """The heading nearest to a place, heights weighing more; a place above the lower group of headings belongs to the upper one."""
    tops = sorted({t for _, t in headings.values()})
    lower = next((t for t in tops[1:] if t - tops[0] > LOWER_GROUP), None)
    among = headings
    if lower is not None:
        cut = lower - GROUP_MARGIN
        among = {n: p for n, p in headings.items() if (p[1] < cut) == (top < cut)} or headings
    return min(among, key=lambda n: DOWN_WEIGHS * abs(among[n][1] - top) + abs(among[n][0] - x), default=None)


def halves(words: list[Word]) -> float:
    """The height that parts the upper half of a page from the lower: after the first total with words below it, else in the
    middle of the widest gap, else in the middle of all."""
    tops = sorted({w.top for w in words})
    if not tops:
        return 0.0
    totals = sorted({w.top for w in words if is_total(w.text)}) if is_total(" ".join([w.text for w in words])) else []
    others = sorted({w.top for w in words if not is_total(w.text)}) if totals else []
    for total in totals:
        later = next((t for t in others if t > total + AFTER_TOTAL), None)
        if later is not None:
            return (total + later) / 2
    steps = [tops[0]]
    for top in tops:
        if abs(top - steps[-1]) > HEADING_ROW:
            steps.append(top)
    gap, above = max(((b - a, -i) for i, (a, b) in enumerate(zip(steps, steps[1:], strict=False))), default=(0.0, 0))
    return (steps[-above] + steps[1 - above]) / 2 if gap >= LEAST_GAP else (tops[0] + tops[-1]) / 2


class Page:
    """The measures of a page that subsections are told by."""

    def __init__(self, words: list[Word]):
        self.words = words
        self.left = min(w.x for w in words)
        self.third = max(max(w.x for w in words) - self.left, 1.0) / 3

    @cached_property
    def split(self) -> float:
        return halves(self.words)

    @cached_property
    def headings(self) -> dict[str, tuple[float, float]]:
        return heading_places(self.words)

    def column(self, x: float) -> int:
        return min(2, max(0, int((x - self.left) / self.third)))

    def subsection(self, x: float, top: float) -> str:
        """The subsection of a place: by its nearest heading, without headings by its sixth of the page."""
        return nearest_heading(x, top, self.headings) or list(SUBSECTIONS)[self.column(x) + 3 * (top > self.split)]


def subsection_rows(words: list[Word]) -> list[tuple[str, int | None, float | None, float | None, str, float]]:
    """(subsection, year, cost, value, text, confidence) of the rows of a page, each once.

    A row is a run of a band with a year and an amount, or with two amounts, and is no total. With a year the first amount is the
    cost and the last of several the value, without one the last is the value.
    """
    amounts = loose_amounts(words)
    if not amounts:
        return []
    page, rows = Page(words), []
    for band in bands(words, ROW):
        if all(w.text not in amounts for w in band.words):
            continue
        for run in columns(band.words, max(COLUMN_GAP, COLUMN_SHARE * page.third)):
            sums = [(w, amounts[w.text]) for w in run if w.text in amounts]
            dates = [w for w in run if _YEAR.fullmatch(w.text)] if sums else []
            if not sums or (not dates and len(sums) < 2) or is_total(text := " ".join(w.text for w in run)):
                continue
            year = int(dates[0].text) if dates else None
            cost = sums[0][1] if dates else None
            value = sums[-1][1] if not dates or len(sums) > 1 else None
            anchor = dates[0] if dates else sums[0][0]
            rows.append((page.subsection(anchor.x, band.top), year, cost, value, text, SURE if dates else UNSURE))
    return list({(*r[:4], r[4].upper()): r for r in reversed(rows)}.values())[::-1]


def subsection_totals(words: list[Word]) -> list[tuple[str, float]]:
    """(subsection, total): beside each word of a total, the largest amount of its row within its column."""
    sums = [w for w in words if is_total(w.text)] if is_total(" ".join([w.text for w in words])) else []
    if not sums:
        return []
    page, totals, amounts = Page(words), {}, loose_amounts(words)
    shown = sorted((w for w in words if w.text in amounts and w.top == w.top), key=itemgetter(2))
    for word in sums:
        left = page.left + page.column(word.x) * page.third
        near = shown[bisect_left(shown, word.top - TOTAL_ROW - 1, key=itemgetter(2)) : bisect_right(shown, word.top + TOTAL_ROW + 1, key=itemgetter(2))]
        beside = [amounts[w.text] for w in near if abs(w.top - word.top) <= TOTAL_ROW and left - COLUMN_EDGE <= w.x <= left + page.third + COLUMN_EDGE]
        if beside:
            totals[page.subsection(word.x, word.top)] = max(beside)
    return list(totals.items())


def _by_page(pages: DataFrame, page_id: str, words: str, read: Callable[[list[Word]], list[tuple]], schema: str, may: Callable[[str], object] = bool) -> DataFrame:
    """``read`` of every page, whose ``words`` are boxes or plain text.

    Text is laid out in the same function that reads it, so no box of it is ever an Arrow value or a row of the engine, and no more
    than one page's boxes are held. ``may`` tells of a text whether ``read`` may find anything in it.
    """
    width = schema.count(",") + 2

    def run(cols: list[pa.Array]) -> list[list]:
        out: list[list] = [[] for _ in range(width)]
        for page, boxes in zip(cols[0].to_pylist(), pages_of(cols[1], may), strict=True):
            for row in read(boxes):
                for values, x in zip(out, (page, *row), strict=True):
                    values.append(x)
        return out

    return flat_map(pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(words).alias("words")), run, f"page_id BIGINT, {schema}", arrow_in=True)


def page_pairs(pages: DataFrame, page_id: str, words: str) -> DataFrame:
    """(page_id, year, amount, x, top) of every year row on every page; ``words`` are boxes or plain text."""
    return _by_page(pages, page_id, words, year_rows, "year INT, amount DOUBLE, x DOUBLE, top DOUBLE", _YEAR.search)


def page_subsection_rows(pages: DataFrame, page_id: str, words: str) -> DataFrame:
    """(page_id, subsection, year, cost, value, row_text, confidence) of every subsection row on every page; ``words`` are boxes or plain text."""
    return _by_page(pages, page_id, words, subsection_rows, "subsection STRING, year INT, cost DOUBLE, value DOUBLE, row_text STRING, confidence DOUBLE", _DIGIT.search)


def page_subsection_totals(pages: DataFrame, page_id: str, words: str) -> DataFrame:
    """(page_id, subsection, total) of every total on every page; ``words`` are boxes or plain text."""
    return _by_page(pages, page_id, words, subsection_totals, "subsection STRING, total DOUBLE", is_total)


def page_headings(pages: DataFrame, page_id: str, words: str) -> DataFrame:
    """(page_id, subsection, x, top) of every subsection's heading on every page."""
    return _by_page(pages, page_id, words, lambda w: [(n, *p) for n, p in heading_places(w).items()], "subsection STRING, x DOUBLE, top DOUBLE")


def reading_order(words: str) -> object:
    """The words of a page sorted by height and then position, both to one decimal, joined by blanks."""
    keyed = F.transform(words, lambda w: F.struct(F.round(w["top"], 1).alias("top"), F.round(w["x0"], 1).alias("x0"), w["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(F.filter(keyed, lambda w: F.trim(w["text"]) != "")), lambda w: w["text"]), " ")


def in_given_order(words: str) -> object:
    """The texts of a page's words as they come, joined by blanks."""
    return F.trim(F.array_join(F.filter(F.transform(words, lambda w: w["text"]), lambda t: t != ""), " "))


def words_of_lines(df: DataFrame, page_id: str, text: str, line_height: float = LINE_HEIGHT, letter: float = LETTER) -> DataFrame:
    """Word boxes laid out from plain text: a line's number gives the height, a word's offset the position; pages without words give no row."""

    boxes = to_arrow_type(StructType.fromDDL(f"words {WORDS}")["words"].dataType)

    def run(cols: list[list]) -> list:
        kept: list = []
        texts: list[str] = []
        lefts: list[float] = []
        tops: list[float] = []
        starts = [0]
        for page, body in zip(*cols, strict=True):
            for said, x, top in lines_of(body, line_height, letter):
                texts.append(said)
                lefts.append(x)
                tops.append(top)
            if len(texts) > starts[-1]:
                kept.append(page)
                starts.append(len(texts))
        fields = [pa.array(values, type=f.type) for values, f in zip((texts, lefts, tops), boxes.value_type, strict=True)]
        return [kept, pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.StructArray.from_arrays(fields, fields=list(boxes.value_type)), type=boxes)]

    kind = df.schema[page_id].dataType.simpleString()
    return flat_map(df.select(page_id, text), run, f"{page_id} {kind}, words {WORDS}")
