"""Queries over packed and nested records (problems 3 and 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import nested, packed
from cadastra.session import table

#: (table, row id, packed fields)
PACKED = (("review_queue", "queue_id", ["issues"]), ("sample_rendition_summary", "summary_id", ["issues", "agent_flags"]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flat row of the JSON fields, linked to its parent."""
    results = nested.flatten_records(table(spark, sf_dir, "rendition_result"), "result_id", ["form_flags", "schedule_e"])
    values = nested.flatten_records(table(spark, sf_dir, "valuation_result"), "valuation_id", ["line_items"])
    return results.unionByName(values)


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of the forms with its value."""
    return nested.flat_table(table(spark, sf_dir, "rendition_result"), "result_id", "form_flag")


def p3_year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year row of the schedules with its members."""
    return nested.flat_table(table(spark, sf_dir, "rendition_result"), "result_id", "year_row")


def p3_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with its members."""
    return nested.flat_table(table(spark, sf_dir, "valuation_result"), "valuation_id", "line_item")


def p3_item_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of a line item, linked to the item."""
    return nested.flat_table(table(spark, sf_dir, "valuation_result"), "valuation_id", "line_item_flag")


def p3_money_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every money token, linked to its year row (child year_row_money) or line item (line_item_money)."""
    years = nested.flat_table(table(spark, sf_dir, "rendition_result"), "result_id", "year_row_money")
    items = nested.flat_table(table(spark, sf_dir, "valuation_result"), "valuation_id", "line_item_money")
    return years.withColumn("child", F.lit("year_row_money")).unionByName(items.withColumn("child", F.lit("line_item_money")))


def p3_schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, records and scalars of every schema path of the three fields."""
    fields = (("rendition_result", "result_id", "form_flags"), ("rendition_result", "result_id", "schedule_e"), ("valuation_result", "valuation_id", "line_items"))
    counted = [nested.schema_paths(table(spark, sf_dir, name), field).withColumn("field_name", F.lit(field)) for name, _, field in fields]
    return reduce(DataFrame.unionByName, counted).select("field_name", "schema_path", "nodes", "scalars", "linked")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields with its position."""
    frames = [(table(spark, sf_dir, name), name, row_id, fields) for name, row_id, fields in PACKED]
    entries = packed.held(packed.learn_dictionary(reduce(DataFrame.unionByName, [packed.stacked(df, fields) for df, _, _, fields in frames])))
    return reduce(DataFrame.unionByName, [packed.split_fields(df, name, row_id, fields, entries) for df, name, row_id, fields in frames])


def queries() -> dict:
    flat = {"p3_flags": p3_flags, "p3_year_rows": p3_year_rows, "p3_line_items": p3_line_items, "p3_item_flags": p3_item_flags, "p3_money_tokens": p3_money_tokens}
    return {"p3_found": p3_found, **flat, "p3_schema_paths": p3_schema_paths, "p4_found": p4_found}


_NODES = r"""
WITH fields AS (
  SELECT 'form_flags' AS field, result_id AS record_id, form_flags AS t FROM rendition_result
  UNION ALL SELECT 'schedule_e', result_id, schedule_e FROM rendition_result
  UNION ALL SELECT 'line_items', valuation_id, line_items FROM valuation_result),
opened AS (SELECT field, record_id, CASE WHEN json_valid(t) AND json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END AS t FROM fields WHERE trim(t) <> ''),
listed AS (SELECT *, '[' || regexp_replace(t, '\}\s*\n\s*\{', '},{', 'g') || ']' AS l FROM opened),
whole AS (SELECT field, record_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) WHEN json_valid(l) THEN CAST(l AS JSON) END AS j FROM listed),
nodes AS (
  SELECT field, record_id, n.id, n.parent, n.key, n.type, n.atom, n.fullkey, replace(regexp_replace(substr(n.fullkey, 2), '\[\d+\]', '[]', 'g'), '"', '') AS path
  FROM whole, json_tree(j) n WHERE n.type <> 'NULL')
"""
_PATHS = _NODES + """
SELECT field AS field_name, CASE WHEN path = '' THEN '$' ELSE path END AS schema_path, count(*) AS nodes, count(*) FILTER (type NOT IN ('OBJECT', 'ARRAY')) AS scalars, count(parent) AS linked
FROM nodes GROUP BY 1, 2
"""
_FOUND = _NODES + r""",
holders AS (SELECT DISTINCT field, record_id, parent AS id FROM nodes WHERE key IN ('items', 'rows', 'year_rows', 'line_items', 'data') AND type IN ('OBJECT', 'ARRAY')),
flat_rows AS (
  SELECT field, record_id, id, fullkey, row_number() OVER (PARTITION BY field, record_id ORDER BY id) - 1 AS pos
  FROM nodes ANTI JOIN holders USING (field, record_id, id)
  WHERE type <> 'ARRAY' AND regexp_matches(path, '^(\[\]|\.(items|rows|year_rows|line_items|data))*$') AND (field = 'line_items' OR field = 'schedule_e' AND path <> '')),
members AS (
  SELECT field, record_id, id, 'money' AS part, regexp_extract(fullkey, '^(.*)\.raw_values\.money_tokens(\[\d+\])*$', 1) AS above FROM nodes WHERE type <> 'ARRAY' AND regexp_matches(path, '\.raw_values\.money_tokens(\[\])*$')
  UNION ALL SELECT field, record_id, id, 'flag', regexp_extract(fullkey, '^(.*)\.flags(\[\d+\])*$', 1) FROM nodes WHERE type <> 'ARRAY' AND field = 'line_items' AND regexp_matches(path, '\.flags(\[\])*$')),
linked AS (
  SELECT m.field, m.record_id, part, r.pos AS parent_pos, row_number() OVER (PARTITION BY m.field, m.record_id, part, r.pos ORDER BY m.id) - 1 AS pos
  FROM members m JOIN flat_rows r ON r.field = m.field AND r.record_id = m.record_id AND r.fullkey = m.above),
wrapped AS (SELECT DISTINCT record_id FROM nodes WHERE field = 'form_flags' AND path = '.flags' AND type IN ('OBJECT', 'ARRAY')),
flags AS (
  SELECT n.record_id, CASE WHEN w.record_id IS NULL THEN path ELSE regexp_replace(path, '^\.flags', '') END AS path, s.name
  FROM (SELECT * FROM nodes WHERE field = 'form_flags' AND type NOT IN ('OBJECT', 'ARRAY')) n
  LEFT JOIN wrapped w ON w.record_id = n.record_id
  LEFT JOIN (SELECT record_id, parent, json_extract_string(atom, '$') AS name FROM nodes WHERE field = 'form_flags' AND key IN ('flag', 'name') AND type = 'VARCHAR') s ON s.record_id = n.record_id AND s.parent = n.parent
  WHERE (w.record_id IS NULL OR starts_with(path, '.flags')) AND (s.name IS NULL OR n.key = 'value'))
SELECT CASE field WHEN 'schedule_e' THEN 'year_row' ELSE 'line_item' END AS child, record_id, CAST(-1 AS INTEGER) AS parent_pos, CAST(pos AS VARCHAR) AS item FROM flat_rows
UNION ALL SELECT CASE field WHEN 'schedule_e' THEN 'year_row_' ELSE 'line_item_' END || part, record_id, CAST(parent_pos AS INTEGER), CAST(pos AS VARCHAR) FROM linked
UNION ALL SELECT 'form_flag', record_id, -1, coalesce(name, replace(replace(ltrim(path, '[].'), '[]', ''), '.', '_')) FROM flags
"""


_LABELS = """,
every AS (
  SELECT field, record_id, n.id, n.parent, row_number() OVER (PARTITION BY field, record_id, n.parent ORDER BY n.id) - 1 AS ord
  FROM whole, json_tree(j) n),
dewey AS (
  SELECT field, record_id, id, '' AS label FROM every WHERE parent IS NULL
  UNION ALL SELECT e.field, e.record_id, e.id, CASE WHEN d.label = '' THEN '' ELSE d.label || '.' END || e.ord FROM dewey d JOIN every e ON e.field = d.field AND e.record_id = d.record_id AND e.parent = d.id)
"""
_WRITTEN = "CASE n.type WHEN 'VARCHAR' THEN json_extract_string(n.atom, '$') ELSE CAST(n.atom AS VARCHAR) END"


def _with_labels(select: str) -> str:
    """``select`` over the rows, links and flags of ``_FOUND``, with the Dewey labels of all nodes."""
    found = _FOUND[: _FOUND.index("SELECT CASE field WHEN 'schedule_e' THEN 'year_row' ELSE")].rstrip()
    found = found.replace("SELECT m.field, m.record_id, part, r.pos AS parent_pos,", "SELECT m.field, m.record_id, m.id, r.id AS row_id, part, r.pos AS parent_pos,")
    found = found.replace("SELECT n.record_id, CASE WHEN w.record_id IS NULL", "SELECT n.record_id, n.id, CASE WHEN w.record_id IS NULL")
    return found.replace("WITH fields", "WITH RECURSIVE fields") + _LABELS + select


_LINKED = "linked l JOIN nodes n ON n.field = l.field AND n.record_id = l.record_id AND n.id = l.id JOIN dewey d ON d.field = l.field AND d.record_id = l.record_id AND d.id = l.id JOIN dewey p ON p.field = l.field AND p.record_id = l.record_id AND p.id = l.row_id"
_ITEM = f"l.record_id, CAST(l.parent_pos AS INTEGER) AS parent_pos, p.label AS parent_dewey, CAST(l.pos AS INTEGER) AS pos, d.label AS dewey, {_WRITTEN} AS value"
_TABLES = {
    "p3_flags": f"SELECT f.record_id, d.label AS dewey, coalesce(f.name, replace(replace(ltrim(f.path, '[].'), '[]', ''), '.', '_')) AS flag, {_WRITTEN} AS value FROM flags f JOIN nodes n ON n.field = 'form_flags' AND n.record_id = f.record_id AND n.id = f.id JOIN dewey d ON d.field = 'form_flags' AND d.record_id = f.record_id AND d.id = f.id",
    "p3_item_flags": f"SELECT {_ITEM} FROM {_LINKED} WHERE l.part = 'flag'",
    "p3_money_tokens": f"SELECT {_ITEM}, TRY_CAST(regexp_replace({_WRITTEN}, '[$, ]', '', 'g') AS DOUBLE) AS amount, CASE l.field WHEN 'schedule_e' THEN 'year_row_money' ELSE 'line_item_money' END AS child FROM {_LINKED} WHERE l.part = 'money'",
}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _FOUND, "p3_schema_paths": _PATHS, **{name: _with_labels(select) for name, select in _TABLES.items()}}
