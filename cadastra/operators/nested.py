"""Deeply nested semi-structured records as flat tables (problem 3), by Dewey labelling.

Every node of a JSON value gets an ordinal path identifier (its Dewey label) and a schema path. Nodes are grouped by
schema path: the path alone tells the table that a node belongs to (``Shape.role``), or the column of its row. The
parent of a row is found by truncating its label to the depth that the path names, so a child needs no key of its
own, and positions are the order of the labels. The labels of one record depend on that record alone: the operator
is one narrow map over the rows, with no shuffle, and as wide as the input.

Defined results: NULL, empty, unreadable or cut-off JSON gives no rows; several JSON values after one another in one
field (one to a line, say) count as a list of them, and give no rows if one of them is unreadable; null elements give
no row and take no position; a lone value counts as a list of one; JSON text inside a JSON string is opened;
repeated records give repeated rows under their own ids; further columns of the input are ignored. Values come out
as they are written; members of a row that its table has no column for are in ``rest``. Counts and page numbers
beside a list of rows, and members of a schedule beside its rows, are no part of the flat tables.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions import text as texts
from cadastra.session import flat_map

Label = tuple[int, ...]
#: The keys on the way to a node, None for an element of a list.
Path = tuple[str | None, ...]
#: Members of the rows that are columns of their tables.
YEAR_ROW = ("subsection", "year_acquired", "historical_cost", "good_faith_value")
LINE_ITEM = ("schedule", *YEAR_ROW, "calculated_value", "depreciation_factor", "exact_value", "raw_text", "source_page", "confidence")
AMOUNTS = ("historical_cost", "good_faith_value", "calculated_value", "exact_value")
#: The field that each flat table comes from.
FIELD = {"form_flag": "form_flags", "year_row": "schedule_e", "year_row_money": "schedule_e", "line_item": "line_items", "line_item_flag": "line_items", "line_item_money": "line_items"}


class Shape:
    """How the schema paths of one field map to its tables.

    Rows stand at paths made of list elements and ``wrappers`` only, members whose objects merely hold a list of rows
    with counts or page numbers beside it. ``children`` are the paths from a row on to its child tables. ``rooted``:
    whether a lone object at the root is a row itself.
    """

    def __init__(self, table: str, columns: tuple[str, ...], children: dict[str, Path], wrappers: frozenset[str], rooted: bool):
        self.table, self.columns, self.children, self.wrappers, self.rooted = table, columns, children, wrappers, rooted
        self.role = cache(self._role)

    def _within(self, path: Path, at: int) -> int:
        while at < len(path) and (path[at] is None or path[at] in self.wrappers):
            at += 1
        return at

    def _role(self, path: Path) -> tuple[str | None, int]:
        """(table or "" for a column of the row, depth of the row) of the nodes at ``path``."""
        depth = self._within(path, 0)
        if depth == len(path):
            return (self.table if depth or self.rooted else None), depth
        for child, member in self.children.items():
            if path[depth : depth + len(member)] == member and self._within(path, depth + len(member)) == len(path):
                return child, depth
        return "", depth

    def holds_rows(self, node: object) -> bool:
        """Whether an object only wraps a list of rows."""
        return isinstance(node, dict) and any(k in node and isinstance(node[k], (list, dict, type(None))) for k in self.wrappers)


_HOLDERS = frozenset({"items", "rows", "year_rows", "line_items", "data"})
SHAPES = {
    "schedule_e": Shape("year_row", YEAR_ROW, {"year_row_money": ("raw_values", "money_tokens")}, _HOLDERS, False),
    "line_items": Shape("line_item", LINE_ITEM, {"line_item_flag": ("flags",), "line_item_money": ("raw_values", "money_tokens")}, _HOLDERS, True),
}


class Number(float):
    """A JSON number that keeps the text it was written as."""

    def __new__(cls, text: str):
        number = super().__new__(cls, text)
        number.text = text
        return number


_DECODERS = {kind: json.JSONDecoder(parse_int=kind, parse_float=kind) for kind in (float, Number)}


def parse(text: str | None, number: type[float] = float):
    """The JSON value of ``text``, a list of them if several stand after one another, or None if any is unreadable.

    Where only shape and order matter, plain floats do for ``number``.
    """
    decoder = _DECODERS[number]
    for _ in range(4):
        if not isinstance(text, str):
            return text
        values, at, end = [], 0, len(text)
        while at < end:
            if text[at].isspace() or (text[at] in ",\x1e﻿" and at + 1 < end):
                at += 1
                continue
            try:
                value, at = decoder.raw_decode(text, at)
            except (ValueError, RecursionError):
                return None
            values.append(value)
        if not values:
            return None
        text = values[0] if len(values) == 1 else values
    return None


def dewey(value, root: Label = (), path: Path = ()) -> Iterator[tuple[Label, Path, object]]:
    """(label, path, value) of every non-null node below ``value`` in reading order."""
    stack = [(root, path, value)]
    while stack:
        label, at, node = stack.pop()
        if node is None:
            continue
        yield label, at, node
        if isinstance(node, dict):
            stack.extend([(label + (i,), at + (key,), child) for i, (key, child) in enumerate(node.items())][::-1])
        elif isinstance(node, list):
            inside = at + (None,)
            stack.extend([(label + (i,), inside, child) for i, child in enumerate(node)][::-1])


@cache
def shown(path: Path) -> str:
    """A schema path for readers: ``.items[].flags``, ``$`` for none."""
    return "".join("[]" if key is None else f".{key}" for key in path) or "$"


def dotted(label: Label) -> str:
    return ".".join(map(str, label))


def written(node) -> str | None:
    """The text of a node as it is written; of objects and lists their JSON."""
    return node if isinstance(node, str) else getattr(node, "text", None) or json.dumps(node)


def flag_nodes(value) -> list[tuple[Label, str, object]]:
    """(label, flat name, value) of the non-null flags: plain members, groups, and lists of named values.

    A flat name is made of the keys of the schema path; a ``value`` beside a ``flag``, ``name`` or ``key`` goes by that
    name, which is found under the same parent label. An object at the root that holds ``flags`` only wraps them.
    """
    within: str | None = "flags" if isinstance(value, dict) and isinstance(value.get("flags"), (dict, list)) else None
    named: dict[Label, str] = {}
    found = []
    for label, path, node in dewey(value):
        if within and path and path[0] != within:
            continue
        if isinstance(node, dict):
            key = next((k for k in ("flag", "name", "key") if isinstance(node.get(k), str)), None)
            if key and "value" in node:
                named[label] = node[key]
        elif not isinstance(node, list):
            parts, skip = [], False
            for depth, key in enumerate(path):
                if key is not None and not (within and depth == 0):
                    name = named.get(label[:depth])
                    skip |= name is not None and key != "value"
                    parts.append(key if name is None else name)
            if parts and not skip:
                found.append((label, "_".join(parts), node))
    return found


def grouped(shape: Shape, value, members: bool) -> tuple[list[tuple[Label, object]], dict[str, list[tuple[Label, Label, object]]], dict[Label, dict[str, list[str]]]]:
    """The nodes of a field grouped by schema path.

    (label, node) of the rows; by child table (parent label, label, node) of its rows; and with ``members`` by row label
    its scalars as they are written, by schema path from the row on.
    """
    rows: list[tuple[Label, object]] = []
    children: dict[str, list[tuple[Label, Label, object]]] = {child: [] for child in shape.children}
    scalars: dict[Label, dict[str, list[str]]] = {}
    at = set()
    for label, path, node in dewey(value):
        table, depth = shape.role(path)
        if table is None or isinstance(node, list) or shape.holds_rows(node):
            continue
        if table == shape.table:
            rows.append((label, node))
            at.add(label)
            if members and not isinstance(node, dict):
                scalars[label] = {"$": [written(node)]}
        elif (parent := label[:depth]) in at:  # the parent's label is the node's, cut to the depth of its row
            if table:
                children[table].append((parent, label, node))
            elif members and not isinstance(node, dict):
                scalars.setdefault(parent, {}).setdefault(shown(path[depth:]), []).append(written(node))
    return rows, children, scalars


def shred(field: str, text: str | None) -> list[tuple[str, int, str]]:
    """(child table, parent position, item) of every flat row in one field."""
    value = parse(text)
    if value is None:
        return []
    if field == "form_flags":
        return [("form_flag", -1, name) for _, name, _ in flag_nodes(value)]
    shape = SHAPES[field]
    rows, children, _ = grouped(shape, value, False)
    out = [(shape.table, -1, str(pos)) for pos in range(len(rows))]
    for child, found in children.items():
        out += [(child, parent, str(own)) for parent, _, own, _, _ in _placed(rows, found)]
    return out


def _placed(rows: list[tuple[Label, object]], found: list[tuple[Label, Label, object]]) -> Iterator[tuple[int, Label, int, Label, object]]:
    """(parent position, parent label, own position, label, node) of child rows."""
    at = {label: pos for pos, (label, _) in enumerate(rows)}
    own: dict[Label, int] = {}
    for parent, label, node in found:
        own[parent] = own.get(parent, -1) + 1
        yield at[parent], parent, own[parent], label, node


def table_rows(child: str, text: str | None) -> list[tuple]:
    """The rows of the flat table ``child`` in one field, without the record's id."""
    value = parse(text, Number)
    if value is None:
        return []
    if child == "form_flag":
        return [(dotted(label), name, written(node)) for label, name, node in flag_nodes(value)]
    shape = SHAPES[FIELD[child]]
    rows, children, scalars = grouped(shape, value, child == shape.table)
    if child != shape.table:
        return [(parent, dotted(above), own, dotted(label), written(node)) for parent, above, own, label, node in _placed(rows, children[child])]
    out = []
    for pos, (label, _) in enumerate(rows):
        paths = scalars.get(label, {})
        values = [paths.pop(f".{name}", [None])[0] for name in shape.columns]
        out.append((pos, dotted(label), *values, json.dumps(paths) if paths else None))
    return out


def flatten_records(df: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(child, record_id, parent_pos, item) of the JSON ``fields`` of ``df``."""

    def run(columns: list[list]) -> list[list]:
        child, record, parent, item = [], [], [], []
        for row_id, *texts in zip(*columns, strict=True):
            for field, text in zip(fields, texts, strict=True):
                for c, p, i in shred(field, text):
                    child.append(c), record.append(row_id), parent.append(p), item.append(i)
        return [child, record, parent, item]

    chosen = df.select(F.col(record_id).cast("bigint").alias("record_id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return flat_map(chosen, run, "child STRING, record_id BIGINT, parent_pos INT, item STRING")


def amount(text: Column) -> Column:
    """The number in a value as it is written: a JSON number, else an amount."""
    return F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double")).otherwise(texts.money(text))


def flat_table(df: DataFrame, record_id: str, child: str) -> DataFrame:
    """The flat table ``child`` of the field it comes from, with its values and the keys of its parents.

    form_flag: (record_id, dewey, flag, value). year_row, line_item: (record_id, pos, dewey), the members as they are
    written, ``rest`` (JSON of all other scalars, by schema path), year and amounts as numbers. Their children:
    (record_id, parent_pos, parent_dewey, pos, dewey, value), with the amount of a money token.
    """
    if child == "form_flag":
        schema = "record_id BIGINT, dewey STRING, flag STRING, value STRING"
    elif child in ("year_row", "line_item"):
        members = YEAR_ROW if child == "year_row" else LINE_ITEM
        schema = f"record_id BIGINT, pos INT, dewey STRING, {', '.join(f'{m} STRING' for m in members)}, rest STRING"
    else:
        schema = "record_id BIGINT, parent_pos INT, parent_dewey STRING, pos INT, dewey STRING, value STRING"
    width = schema.count(",") + 1

    def run(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(width)]
        for row_id, text in zip(*columns, strict=True):
            for row in table_rows(child, text):
                for values, x in zip(out, (row_id, *row), strict=True):
                    values.append(x)
        return out

    flat = flat_map(df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(FIELD[child]).cast("string").alias("text")), run, schema)
    if child in ("year_row", "line_item"):
        flat = flat.withColumn("year", amount(F.col("year_acquired")).try_cast("int"))
        return flat.withColumns({f"{m}_amount": amount(F.col(m)) for m in AMOUNTS if m in flat.columns})
    return flat.withColumn("amount", amount(F.col("value"))) if child.endswith("_money") else flat


def dewey_nodes(df: DataFrame, record_id: str, field: str) -> DataFrame:
    """Every non-null node of ``field``: (record_id, dewey, parent_dewey, schema_path, value).

    ``dewey`` is the dotted label, ``parent_dewey`` the label cut by one step (NULL at the root), ``value`` the
    scalar's text as it is written (NULL for objects and lists).
    """

    def run(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for row_id, text in zip(*columns, strict=True):
            for label, path, node in dewey(parse(text, Number)):
                parent = dotted(label[:-1]) if label else None
                scalar = None if isinstance(node, (dict, list)) else written(node)
                for values, x in zip(out, (row_id, dotted(label), parent, shown(path), scalar), strict=True):
                    values.append(x)
        return out

    chosen = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(field).cast("string").alias("text"))
    return flat_map(chosen, run, "record_id BIGINT, dewey STRING, parent_dewey STRING, schema_path STRING, value STRING")


def schema_paths(df: DataFrame, field: str) -> DataFrame:
    """(schema_path, nodes, scalars, linked) of ``field``: its nodes, those with a value and those with a parent, summed in each batch first."""

    def run(columns: list[list]) -> list[list]:
        nodes: Counter = Counter()
        scalars: Counter = Counter()
        for text in columns[0]:
            for _, path, node in dewey(parse(text)):
                nodes[path] += 1
                scalars[path] += not isinstance(node, (dict, list))
        return [[shown(p) for p in nodes], list(nodes.values()), [scalars[p] for p in nodes], [n if p else 0 for p, n in nodes.items()]]

    counted = flat_map(df.select(F.col(field).cast("string").alias("text")), run, "schema_path STRING, nodes BIGINT, scalars BIGINT, linked BIGINT")
    return counted.groupBy("schema_path").agg(*[F.sum(c).alias(c) for c in ("nodes", "scalars", "linked")])
