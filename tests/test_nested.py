"""Flat tables of nested records."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.operators import nested

ROW = {"schedule": "E", "flags": ["a", None, "b"], "raw_values": {"money_tokens": ["1", None, "2"]}}


def items(field, text, child):
    return [(p, i) for c, p, i in nested.shred(field, text) if c == child]


@pytest.mark.parametrize("text", [None, "", "  ", "{", '{"a": 1', "null", '"', "nope", "[" * 3000])
def test_unreadable_text_gives_no_rows(text):
    assert all(nested.shred(f, text) == [] for f in ("form_flags", "schedule_e", "line_items"))


@pytest.mark.parametrize("shape", [[ROW], ROW, {"items": [ROW], "count": 1}, [{"page": 1, "items": [None, ROW]}], [[ROW]], [None, ROW]])
def test_containers_of_line_items(shape):
    for text in (json.dumps(shape), json.dumps(json.dumps(shape))):
        assert items("line_items", text, "line_item") == [(-1, "0")]
        assert items("line_items", text, "line_item_flag") == [(0, "0"), (0, "1")]
        assert items("line_items", text, "line_item_money") == [(0, "0"), (0, "1")]


def test_lone_values_count_as_lists_of_one():
    text = json.dumps([{"schedule": "A"}, {"schedule": "B", "flags": "x", "raw_values": {"money_tokens": "9"}}])
    assert items("line_items", text, "line_item_flag") == [(1, "0")]
    assert items("line_items", text, "line_item_money") == [(1, "0")]


def test_year_rows_under_either_name():
    row = {"year_acquired": 2020, "raw_values": {"money_tokens": ["5", "6"]}}
    for key in ("rows", "year_rows"):
        text = json.dumps({"present": True, key: [row, None, row]})
        assert items("schedule_e", text, "year_row") == [(-1, "0"), (-1, "1")]
        assert items("schedule_e", text, "year_row_money") == [(0, "0"), (0, "1"), (1, "0"), (1, "1")]
    assert nested.shred("schedule_e", json.dumps({"present": True, "year_rows": None})) == []


def test_flags_of_every_shape():
    flat = {"see_attached": True, "section_3_present": 0, "section_5_present": None}
    group = {"see_attached": True, "section_3": {"present": 0}, "section_5": {"present": None}}
    named = [{"flag": "see_attached", "value": True}, {"name": "section_3_present", "value": 0}, {"name": "section_5_present", "value": None}]
    for value in (flat, group, named, {"page": 1, "flags": flat}):
        assert sorted(i for _, i in items("form_flags", json.dumps(value), "form_flag")) == ["section_3_present", "see_attached"]


values = st.recursive(st.none() | st.booleans() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=20)


@given(values)
def test_truncated_labels_are_parents(value):
    labels = {label: node for label, _, node in nested.dewey(value)}
    for label, node in labels.items():
        if label:
            parent = labels[label[:-1]]
            children = list(parent.values()) if isinstance(parent, dict) else parent
            assert children[label[-1]] == node


def test_operator_over_a_table(spark):
    df = spark.createDataFrame([(1, json.dumps([ROW]), "x"), (2, None, "y"), (3, "{", "z"), (3, json.dumps(ROW), "z")], "id BIGINT, line_items STRING, parent_pos STRING")
    rows = nested.flatten_records(df, "id", ["line_items"]).groupBy("record_id").count().collect()
    assert {r["record_id"]: r["count"] for r in rows} == {1: 5, 3: 5}
    assert nested.flatten_records(df.limit(0), "id", ["line_items"]).count() == 0
    nodes = nested.dewey_nodes(df, "id", "line_items")
    assert nodes.alias("n").join(nodes.alias("p"), "record_id").where("n.parent_dewey = p.dewey").count() > 0


def test_flat_tables_have_values_and_parent_keys(spark):
    flags = json.dumps({"see_attached": "yes", "section_3": {"present": 0, "checked": None}})
    schedule = '{"present": true, "year_rows": [null, {"year_acquired": "$ 2,015.00", "historical_cost": 1e3, "raw_values": {"money_tokens": ["1,200", null, "7"], "year_tokens": ["2015"]}}]}'
    items = '[{"page": 1, "items": [{"schedule": "E", "raw_text": "2019 46,796", "historical_cost": "46,796", "flags": ["a", null, "b"], "raw_values": {"money_tokens": "46,796", "region": {"x_index": 2}}}]}, "lone"]'
    df = spark.createDataFrame([(1, flags, schedule, items), (2, None, "{", "")], "id BIGINT, form_flags STRING, schedule_e STRING, line_items STRING")

    def rows(child, *columns):
        return sorted(map(tuple, nested.flat_table(df, "id", child).select(*columns).collect()))

    assert rows("form_flag", "record_id", "dewey", "flag", "value") == [(1, "0", "see_attached", "yes"), (1, "1.0", "section_3_present", "0")]
    assert rows("year_row", "record_id", "pos", "dewey", "year_acquired", "year", "historical_cost", "historical_cost_amount", "rest") == [(1, 0, "1.1", "$ 2,015.00", 2015, "1e3", 1000.0, '{".raw_values.year_tokens[]": ["2015"]}')]
    assert rows("line_item", "pos", "dewey", "schedule", "raw_text", "historical_cost_amount", "rest") == [(0, "0.1.0", "E", "2019 46,796", 46796.0, '{".raw_values.region.x_index": ["2"]}'), (1, "1", None, None, None, '{"$": ["lone"]}')]
    link = ("record_id", "parent_pos", "parent_dewey", "pos", "dewey", "value")
    assert rows("line_item_flag", *link) == [(1, 0, "0.1.0", 0, "0.1.0.3.0", "a"), (1, 0, "0.1.0", 1, "0.1.0.3.2", "b")]
    assert rows("year_row_money", *link, "amount") == [(1, 0, "1.1", 0, "1.1.2.0.0", "1,200", 1200.0), (1, 0, "1.1", 1, "1.1.2.0.2", "7", 7.0)]
    assert rows("line_item_money", *link, "amount") == [(1, 0, "0.1.0", 0, "0.1.0.4.0", "46,796", 46796.0)]


def test_flat_tables_hold_the_rows_that_are_found():
    from cadastra.plans import record_queries as q

    values = {"form_flags": ['{"flags": {"a": 1, "b": {"c": null, "d": "x"}}}', '[{"flag": "a", "value": false}]'], "schedule_e": ['{"rows": [[{"year_acquired": 1}], {"items": [{"raw_values": {"money_tokens": ["1", ["2"]]}}]}]}'], "line_items": [json.dumps([ROW, [ROW, None], {"items": [ROW], "count": 1}, 5])]}
    for field, texts in values.items():
        for text in texts:
            flat = []
            for child in (c for c, f in nested.FIELD.items() if f == field):
                for row in nested.table_rows(child, text):
                    flat.append((child, -1, row[1] if child == "form_flag" else str(row[0])) if len(row) != 5 else (child, row[0], str(row[2])))
            assert sorted(flat) == sorted(nested.shred(field, text)) != []
    assert {"p3_flags", "p3_year_rows", "p3_line_items", "p3_item_flags", "p3_money_tokens"} <= q.queries().keys()


def test_values_after_one_another_are_a_list():
    lines = "\n".join(json.dumps({**ROW, "seq": n}) for n in range(3))
    for text in (lines, lines.replace("\n", "\r\n") + "\n", lines.replace("\n", ""), lines.replace("\n", ",\n")):
        assert items("line_items", text, "line_item") == [(-1, "0"), (-1, "1"), (-1, "2")]
        assert items("line_items", text, "line_item_flag") == [(r, i) for r in range(3) for i in "01"]
    assert items("line_items", lines + "\nnull\n[" + json.dumps(ROW) + "]", "line_item") == [(-1, str(i)) for i in range(4)]
    for cut in (lines[:-5], lines + "\n{", lines + " x", '{"a": 1} ]'):
        assert nested.shred("line_items", cut) == []


def test_wrapped_rows_and_wrapped_children():
    text = json.dumps({"count": 2, "items": [{"page": 1, "rows": [ROW, [{"raw_values": {"money_tokens": {"count": 2, "items": ["7", "8"]}}}]]}]})
    assert items("line_items", text, "line_item") == [(-1, "0"), (-1, "1")]
    assert items("line_items", text, "line_item_money") == [(0, "0"), (0, "1"), (1, "0"), (1, "1")]
    assert items("line_items", json.dumps({"count": 0, "items": None}), "line_item") == []


def test_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(1, '{"a": 9007199254740993, "b": 2021, "c": 1.50}')], "id BIGINT, line_items STRING")
    assert {r["schema_path"]: r["value"] for r in nested.dewey_nodes(df, "id", "line_items").collect()} == {"$": None, ".a": "9007199254740993", ".b": "2021", ".c": "1.50"}


def test_schema_paths_count_the_nodes(spark):
    df = spark.createDataFrame([(1, json.dumps([ROW, ROW])), (2, "{"), (3, None), (4, json.dumps(ROW))], "id BIGINT, line_items STRING")
    nodes = nested.dewey_nodes(df, "id", "line_items").groupBy("schema_path").agg(F.count("*").alias("nodes"), F.count("value").alias("scalars"), F.count("parent_dewey").alias("linked"))
    assert sorted(map(tuple, nested.schema_paths(df, "line_items").collect())) == sorted(map(tuple, nodes.collect())) != []
