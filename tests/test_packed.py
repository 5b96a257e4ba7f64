"""Values packed in one field."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cadastra.operators import packed

KNOWN = ["Prior year form used", "Amount over 0, check for a misplaced comma", "Pages 0; 0 and 0 repeat the same rows", "Reported total is zero", "Columns A|B merged", "low_ink_page", "rotated_page"]
A, B, C = "Prior year form used", "Amount over 1,234.50, check for a misplaced comma", "Pages 2; 3 and 14 repeat the same rows"


@pytest.fixture(scope="module")
def split():
    return packed.splitter(KNOWN)


@pytest.mark.parametrize("text", [None, "", "  ", "[]", "null", " | ", ";;", "\n\n"])
def test_nothing(split, text):
    assert split(text) == []


@pytest.mark.parametrize("glue", [" | ", "|", "; ", ";", "\n", "\r\n", "\n\n", " // ", " / ", ", ", "\t", " ;"])
def test_delimiters_inside_known_values_are_kept(split, glue):
    assert split(glue.join([A, B, C, A])) == [A, B, C, A]


def test_lists_quotes_and_numbering(split):
    odd = 'Note says "same; again", twice'
    assert split(json.dumps([A, odd])) == [A, odd]
    assert split(str([A, "Agent's letter"])) == [A, "Agent's letter"]
    quoted = '"' + odd.replace('"', '""') + '"'
    assert split(quoted) == [odd]
    assert split(f'{quoted};"{A}"') == [odd, A]
    assert split(f"1. {A}\n2. {B}") == [A, B]
    assert split(f"1) {A} 2) {C}") == [A, C]
    assert split(f"(1) {A}; (2) {B}") == [A, B]
    assert split(f"• {A} • {B}") == [A, B]
    assert split(f"- {A}\n- new one") == [A, "new one"]
    assert split(f"| {A} || {B} | |") == [A, B]


def test_unknown_text_and_codes(split):
    assert split("first, with comma | second") == ["first, with comma", "second"]
    assert split("low_ink_page rotated_page") == ["low_ink_page", "rotated_page"]
    assert split("new_code + other_code") == ["new_code", "other_code"]
    assert split('"not closed | Reported total is zero') == ['"not closed', "Reported total is zero"]
    assert split("x" * 100_000 + "|" + A) == ["x" * 100_000, A]


@given(st.lists(st.sampled_from([A, B, C, "Reported total is zero", "Columns A|B merged"]), min_size=1, max_size=8), st.sampled_from([" | ", ";", "\n", " // "]))
def test_round_trip(values, glue):
    assert packed.splitter(KNOWN)(glue.join(values)) == values


def test_dictionary_and_operator(spark):
    rows = [(i, v, "x") for i, v in enumerate([A, A, json.dumps([B, C]), json.dumps([B, C]), f"{A}|{C}", None, "", f"{B}; {A}"])]
    df = spark.createDataFrame(rows, "id BIGINT, issues STRING, pos STRING")
    entries = packed.learn_dictionary(packed.stacked(df, ["issues"]))
    assert {r["value"] for r in entries.collect()} == {packed.NUMBER.sub("0", v) for v in (A, B, C)}
    out = packed.split_fields(df, "t", "id", ["issues"], packed.held(entries)).collect()
    assert sorted((r["row_id"], r["pos"], r["item"]) for r in out if r["row_id"] in (4, 7)) == [(4, 1, A), (4, 2, C), (7, 1, B), (7, 2, A)]
    nothing = packed.learn_dictionary(packed.stacked(df.limit(0), ["issues"]))
    assert nothing.count() == 0 and packed.split_fields(df.limit(0), "t", "id", ["issues"], packed.held(nothing)).count() == 0


def test_unrelated_rows_make_no_value_unknown_and_long_values_are_learnt(spark):
    long = "See the note; " + "x" * 900
    fields = [(json.dumps([long, A]),)] * 2 + [(f"{long}|{A}",)]
    other = [(f"something else number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}",) for i in range(3000)]
    for rows in (fields, fields + other):
        df = spark.createDataFrame(rows, "issues STRING").selectExpr("monotonically_increasing_id() AS id", "issues")
        known = packed.held(packed.learn_dictionary(packed.stacked(df, ["issues"])))
        out = packed.split_fields(df.where(f"issues = '{long}|{A}'"), "t", "id", ["issues"], known).collect()
        assert [(r["pos"], r["item"]) for r in out] == [(1, long), (2, A)]


def test_a_dictionary_too_large_to_broadcast_gives_the_same_rows(spark):
    glued = [g.join(v) for g in (" | ", ";", ", ", " / ", "\n") for v in ([A, B, C], [C, C], ["new, value", A], ["low_ink_page", "rotated_page"])]
    texts = [*glued, A, json.dumps([A, C]), f'"{B}";"{C}"', "low_ink_page rotated_page", None, "", f"1. {A}\n2. {C}", f"• {A} • {B}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id BIGINT, issues STRING")
    entries = spark.createDataFrame([(k,) for k in KNOWN], "value STRING")
    assert isinstance(packed.held(entries, 10), type(entries))
    by_join, held = (sorted(map(tuple, packed.split_fields(df, "t", "id", ["issues"], e).collect())) for e in (entries, packed.held(entries)))
    assert by_join == held != []
