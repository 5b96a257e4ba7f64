"""Several values packed in one field (problem 4), by dictionary-guided segmentation.

Pass 1 learns the dictionary of whole values from fields whose own form shows where values end: JSON and
Python lists, fully quoted lists, and fields without any delimiter. Numbers are written as ``0`` so that one
entry stands for all its fillings. A value of any length seen ``MIN_COUNT`` times is known, however many other
values there are, so rows added to a table make no value unknown.

Pass 2 segments each field: a multi-pattern automaton finds the known whole values and dynamic programming
picks the cover with the fewest unknown characters, then the fewest pieces, so delimiters inside a known or
quoted value are protected. Text that no entry covers is cut at its strong delimiters (bars, semicolons, tabs, lines,
bullets, double slashes, numbers of a list); a comma or a slash in it may belong to a value and stays.

Both passes are narrow maps, and only the partial counts of the dictionary are shuffled, after being summed in each
batch. A dictionary of at most ``BROADCAST_CHARS`` characters is broadcast; a larger one is looked up by a join of the spans
between delimiters with the entries, which finds the same values (``located``).

Defined results: NULL, blank and empty-list fields give no rows; positions count from 1 over the non-empty
values; a repeated value keeps each of its positions; an unclosed quote is ordinary text; further columns are ignored.
"""

from __future__ import annotations

import ast
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, flat_map

MIN_COUNT = 2
BROADCAST_CHARS = 4_000_000

NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?(?<!,)")
ENUMERATOR = re.compile(r"(?:\(0\)|0[.)])\s+")
BULLET = re.compile(r"[•·▪◦*‣–-]\s+")
#: Delimiters that always end a piece of unknown text; others do so only next to known values.
STRONG = re.compile(r"\s*(?:[|;\t\r\n•·▪◦‣]|\s//\s)\s*")
PLAIN = re.compile(r"[|;,/\t\r\n\"•·▪◦‣\[\]]")
EMPTY = {"[]", "{}", "null", "None"}
_SPACE = " \t\r\n\f\v\xa0"


def read_list(text: str) -> list[str] | None:
    """The members of a JSON or Python list, else None."""
    if not (text.startswith("[") and text.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text)
        except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
            continue
        if isinstance(value, list) and not any(isinstance(v, (list, dict, set)) for v in value):
            return [str(v).strip() for v in value if v is not None and str(v).strip()]
    return None


def generalise(text: str) -> tuple[str, list[int]]:
    """``text`` with each number as ``0``, and for each of its characters (and the end) the offset in ``text``."""
    parts, offsets, end = [], [], 0
    for m in NUMBER.finditer(text):
        parts.append(text[end : m.start()])
        offsets.extend(range(end, m.start()))
        parts.append("0")
        offsets.append(m.start())
        end = m.end()
    parts.append(text[end:])
    offsets.extend(range(end, len(text) + 1))
    return "".join(parts), offsets


def certain_values(text: str | None) -> list[str]:
    """The values of a field whose form leaves no doubt where they end, generalised."""
    text = (text or "").strip(_SPACE)
    if not text or text in EMPTY:
        return []
    values = read_list(text)
    if values is None:
        if PLAIN.search(text):
            values = quoted_list(text)
        else:
            values = [text] if not (BULLET.match(text) or re.match(r"\(?\d+[.)]\s", text)) else []
    return [g for v in values or [] if (g := NUMBER.sub("0", v)) and not CODES.fullmatch(g)]


def quoted_end(text: str, start: int) -> int:
    """The offset after the quoted value that begins at ``start``, or -1; doubled quotes belong to the value."""
    i = start + 1
    while (i := text.find('"', i)) >= 0:
        if text[i + 1 : i + 2] == '"':
            i += 2
        else:
            return i + 1
    return -1


def quoted_list(text: str) -> list[str] | None:
    """The values of a list in which every value is quoted, else None."""
    values, i = [], 0
    while i < len(text):
        if text[i] != '"' or (end := quoted_end(text, i)) < 0:
            return None
        values.append(text[i + 1 : end - 1].replace('""', '"').strip())
        m = re.compile(r"\s*(?:[|;,\t\r\n]|$)\s*").match(text, end)
        if not m:
            return None
        i = m.end()
    return [v for v in values if v]


def automaton(entries: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry in entries:
        machine.add_word(entry, len(entry))
    if entries:
        machine.make_automaton()
    return machine


#: A code word: a name without spaces that holds an underscore. Code words may also be parted by blanks or plus signs.
CODE = re.compile(r"[^\W_]\w*_\w+")
CODES = re.compile(rf"{CODE.pattern}(?:\s*[\s+]\s*{CODE.pattern})+")
_AFTER_DELIMITER, _QUOTE_ENDS = re.compile(r"[|;,\t\r\n/]\s*$"), re.compile(r"\s*(?:$|[|;,\t\r\n]|//?\s)")
_EDGE_BEFORE = re.compile(r"(?:^|[|;,\t\r\n•·▪◦‣\]\[\"]|//|\s[/+]|\s[*–-]|^[*–-]|\(0\)|0[.)])\s*$")
_EDGE_AFTER = re.compile(r"\s*(?:$|[|;,\t\r\n•·▪◦‣\"]|//|[/+]\s|\(0\)\s|0[.)]\s|[*–-]\s)")


def _whole(text: str, i: int, j: int) -> bool:
    """Whether text[i:j] stands between delimiters; a code word only needs to be no part of a longer word."""
    if CODE.fullmatch(text, i, j):
        return not (text[j : j + 1].isalnum() or text[j : j + 1] == "_" or (i and (text[i - 1].isalnum() or text[i - 1] in "_'")))
    return bool(_EDGE_AFTER.match(text, j) and _EDGE_BEFORE.search(text[max(0, i - 8) : i] if i > 8 else text[:i]))


def located(text: str, machine) -> list[tuple[int, int]]:
    """Spans of the entries of ``machine`` that stand as whole values in a generalised ``text``."""
    return [(last + 1 - length, last + 1) for last, length in machine.iter(text) if _whole(text, last + 1 - length, last + 1)] if len(machine) else []


def places(text: str, longest: int) -> list[tuple[int, int]]:
    """Every span of a generalised ``text``, of at most ``longest`` characters, at which an entry could stand as a whole value."""
    starts = [i for i in range(len(text)) if text[i] not in _SPACE and (i == 0 or _EDGE_BEFORE.search(text[max(0, i - 8) : i] if i > 8 else text[:i]))]
    ends = [j for j in range(1, len(text) + 1) if text[j - 1] not in _SPACE and _EDGE_AFTER.match(text, j)]
    spans = {(i, j) for i in starts for j in ends if i < j <= i + longest}
    spans.update(m.span() for m in CODE.finditer(text))
    return [(i, j) for i, j in sorted(spans) if _whole(text, i, j)]


def segment(text: str, found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the values in a generalised ``text`` where known ones are ``found``; quoted values come with their quotes."""
    n = len(text)
    ends: dict[int, list[int]] = {}  # where a known or quoted value begins: where it may end
    for i, j in found:
        ends.setdefault(i, []).append(j)
    first = n - len(text.lstrip())
    for m in re.finditer('"', text):
        i = m.start()
        if i <= first or _AFTER_DELIMITER.search(text[max(0, i - 4) : i]):
            j = quoted_end(text, i)
            if j > 0 and _QUOTE_ENDS.match(text, j):
                ends.setdefault(i, []).append(j)
    # best[i]: (unknown characters, pieces, next) of the cheapest cover of text[i:]; a gap may only hold delimiters
    best: list[tuple[int, int, int, bool]] = [(0, 0, n, False)] * (n + 1)
    for i in range(n - 1, -1, -1):
        unknown, pieces, _, known = best[i + 1]
        blank = text[i] in _SPACE or text[i] in "|;,+•·▪◦‣"
        choice = (unknown + (not blank), pieces, i + 1, False)
        for j in ends.get(i, ()):
            u, p, _, _ = best[j]
            if (u, p + 1) < choice[:2] or (not choice[3] and (u, p + 1) == choice[:2]):
                choice = (u, p + 1, j, True)
        best[i] = choice
    spans: list[tuple[int, int]] = []
    i = gap = 0
    while i < n:
        _, _, nxt, known = best[i]
        if known:
            spans += unknown_spans(text, gap, i)
            spans.append((i, nxt))
            gap = nxt
        i = nxt
    return spans + unknown_spans(text, gap, n)


def unknown_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Pieces of text between known values, cut at strong delimiters; delimiters, enumerators and bullets are no pieces."""
    part, spans = text[start:end], []
    if not part.strip(_SPACE + "|;,/+•·▪◦‣*–-"):
        return []
    cuts = [m.span() for m in STRONG.finditer(part)]
    for a, b in zip([0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(part)], strict=True):
        items = [m for m in re.finditer(r"(?:^|\s)(?:\(0\)|0[.)])\s+", part[a:b])]
        stops = [a, *[a + m.start() for m in items if m.start()], b] if items and not part[a : a + items[0].start()].strip() else [a, b]
        for c, d in zip(stops, stops[1:], strict=False):
            piece = part[c:d]
            while True:
                lead = len(piece) - len(piece.lstrip(_SPACE + ","))
                m = ENUMERATOR.match(piece, lead) or BULLET.match(piece, lead)
                if m is None:
                    break
                c, piece = c + m.end(), piece[m.end() :]
            c, piece = c + lead, piece[lead:]
            for tail in (" /", " //", ","):
                piece = piece.rstrip(_SPACE).removesuffix(tail)
            piece = piece.rstrip(_SPACE + ",")
            if CODES.fullmatch(piece):
                spans += [(start + c + m.start(), start + c + m.end()) for m in CODE.finditer(piece)]
            elif piece and (not re.fullmatch(r"[/+*–-]+|\(0\)|0[.)]", piece)):
                if start == 0 and end == len(text) or not re.fullmatch(r"0[.)]?|\(0\)", piece):
                    spans.append((start + c, start + c + len(piece)))
    return spans


def values_at(text: str, spans: Callable[[str], list[tuple[int, int]]]) -> list[str]:
    """The values of a field, given a function from its generalised text to their spans."""
    text = (text or "").strip(_SPACE)
    if not text or text in EMPTY:
        return []
    listed = read_list(text)
    if listed is not None:
        return listed
    general, offsets = generalise(text)
    values = []
    for a, b in spans(general):
        value = text[offsets[a] : offsets[b]].strip(_SPACE)
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = value[1:-1].replace('""', '"').strip(_SPACE)
        if value:
            values.append(value)
    return values


def splitter(entries: list[str]) -> Callable[[str | None], list[str]]:
    """A function from a field to its values, with the spans of each generalised text kept for its repetitions."""
    machine, kept = automaton(entries), {}

    def spans(general: str) -> list[tuple[int, int]]:
        found = kept.get(general)
        if found is None:
            if len(kept) > 200_000:
                kept.clear()
            found = kept[general] = segment(general, located(general, machine))
        return found

    return lambda text: values_at(text, spans)


def learn_dictionary(fields: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(value) of the whole values known from ``fields`` (one column ``text``), written once."""

    def count(columns: list[list]) -> list[list]:
        seen = Counter(v for text in columns[0] for v in certain_values(text))
        return [list(seen), list(seen.values())]

    counts = flat_map(fields.select("text"), count, "value STRING, n BIGINT").groupBy("value").agg(F.sum("n").alias("n"))
    return checkpointed(counts.where(F.col("n") >= least).select("value"))


def held(entries: DataFrame, most_chars: int = BROADCAST_CHARS) -> Broadcast | DataFrame:
    """The entries as a broadcast list if they are small enough, else as they are."""
    size = entries.agg(F.sum(F.length("value") + 8).alias("chars")).first()["chars"] or 0
    if size > most_chars:
        return entries
    return entries.sparkSession.sparkContext.broadcast(sorted(r["value"] for r in entries.collect()))


def split_fields(df: DataFrame, source_table: str, row_id: str, fields: list[str], entries: Broadcast | DataFrame) -> DataFrame:
    """(source_table, row_id, field_name, pos, item): one row per value of ``fields``, in their order."""
    out = "source_table STRING, row_id BIGINT, field_name STRING, pos INT, item STRING"
    chosen = df.select(F.col(row_id).cast("bigint").alias("row_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    if isinstance(entries, DataFrame):
        return _split_by_join(chosen, source_table, fields, entries, out)
    made: list[Callable[[str | None], list[str]]] = []  # once a task

    def run(columns: list[list]) -> list[list]:
        if not made:
            made.append(splitter(entries.value))
        split = made[0]
        ids, names, positions, items = [], [], [], []
        for row, *texts in zip(*columns, strict=True):
            for name, text in zip(fields, texts, strict=True):
                for pos, item in enumerate(split(text), 1):
                    ids.append(row), names.append(name), positions.append(pos), items.append(item)
        return [[source_table] * len(ids), ids, names, positions, items]

    return flat_map(chosen, run, out)


def _split_by_join(chosen: DataFrame, source_table: str, fields: list[str], entries: DataFrame, out: str) -> DataFrame:
    """``split_fields`` with a dictionary too large to broadcast: entries meet the spans between delimiters by a join."""
    longest = entries.agg(F.max(F.length("value")).alias("n")).first()["n"] or 0
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("p")
    rows = chosen.select("row_id", packed).select("row_id", "p.*").where(F.length("text") > 0)

    def candidates(columns: list[list]) -> list[list]:
        found: list[list] = [[], [], [], []]
        for text in columns[0]:
            general = generalise(text.strip(_SPACE))[0]
            for i, j in places(general, longest):
                for values, x in zip(found, (text, i, j, general[i:j]), strict=True):
                    values.append(x)
        return found

    met = flat_map(rows.select("text").distinct(), candidates, "text STRING, i INT, j INT, value STRING").join(entries, "value", "left_semi")
    spans = met.groupBy("text").agg(F.collect_list(F.struct("i", "j")).alias("spans"))  # bounded by the text itself

    def run(columns: list[list]) -> list[list]:
        found: list[list] = [[], [], [], [], []]
        for row, name, text, at in zip(*columns, strict=True):
            known = [(x["i"], x["j"]) for x in at or ()]
            for pos, item in enumerate(values_at(text, lambda general, known=known: segment(general, known)), 1):
                for values, x in zip(found, (source_table, row, name, pos, item), strict=True):
                    values.append(x)
        return found

    return flat_map(rows.join(spans, "text", "left").select("row_id", "field_name", "text", "spans"), run, out)


def stacked(df: DataFrame, fields: list[str]) -> DataFrame:
    """The values of ``fields`` as one column ``text``, without empty ones."""
    return df.select(F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("text")).where(F.length("text") > 2)
