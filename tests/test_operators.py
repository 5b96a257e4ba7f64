"""Core operators and functions on small literal inputs, with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import change, keep, match, reconcile, scoring, sequence


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("raw", "amount"),
    [("$ 1 84,724.43", 184724.43), ("$ 9,000.00", 9000.0), ("34,798.73", 34798.73), ("6 45,442", 45442.0), ("1O,424", 10424.0), ("(5,000)", 5000.0), ("12,5", 12.5), ("1.234.567", 1234567.0), ("", None), ("abc", None), (None, None), ("5d", None), ("12 345", 12345.0), ("1,234.5.6", None), ("7 12,500.25", 12500.25), ("1 12,500", 112500.0), ("9 450", 9450.0)],
)
def test_money(spark, raw, amount):
    df = spark.createDataFrame([(raw,)], "t STRING").select(text.money(F.col("t")).alias("v"))
    assert df.first()["v"] == amount


def test_text_functions(spark):
    df = spark.createDataFrame([("  Mesel  Hema  County Appraisal District ", "TY2021", " A@B.example "), (None, None, None), ("", "'22", "nobody")], "a STRING, y STRING, e STRING")
    out = df.select(text.collapse(F.col("a")).alias("c"), text.district_slug(F.col("a")).alias("s"), text.tax_year(F.col("y")).alias("y"), text.email_domain(F.col("e")).alias("d"))
    assert values(out, "c", "s", "y", "d") == sorted([("Mesel Hema County Appraisal District", "mesel-hema-cad", 2021, "b.example"), (None, "district", None, None), ("", "district", 2022, None)], key=str)
    assert spark.range(1).select(text.dollars(F.lit(1234.5)).alias("a"), text.dollars(F.lit(None).cast("double")).alias("b")).first() == ("$1,234.50", "-")
    assert not spark.range(1).select(text.plausible_money(F.lit(2024.0)).alias("a")).first()["a"]


def test_keep(spark):
    df = spark.createDataFrame([(1, "a", 5.0, 1), (1, "b", 5.0, 2), (1, "c", None, 3), (None, "d", 1.0, 4)], "k INT, v STRING, w DOUBLE, seq INT")
    assert values(keep.best_of(df, ["k"], F.struct("w", (-F.col("seq")).alias("s"))), "k", "v") == [(1, "a"), (None, "d")]
    assert values(keep.top_k(df, ["k"], [F.desc("w"), F.asc("seq")], 2), "v", "rank") == [("a", 1), ("b", 2), ("d", 1)]
    assert keep.best_of(df.limit(0), ["k"], F.struct("seq")).count() == 0


def test_floor_lookup(spark):
    table = spark.createDataFrame([(9, 2010, 0.1), (9, 2017, 0.1), (9, 2025, 0.9)], "life INT, year INT, factor DOUBLE")
    items = spark.createDataFrame([(9, 2025), (9, 2000), (9, 2026), (9, 2011), (7, 2017), (9, None)], "life INT, year INT")
    got = {(r["life"], r["year"]): r["factor"] for r in match.floor_lookup(items, table, "life", "year", "factor").collect()}
    assert got == {(9, 2025): 0.9, (9, 2000): 0.1, (9, 2026): None, (9, 2011): None, (7, 2017): None, (9, None): None}


def test_keyword_order_decides(spark):
    df = spark.createDataFrame([("Bank deposit slip",), ("portable table",), ("none",), (None,)], "t STRING")
    out = match.first_keyword(df, "t", [("pos", 5), ("portable", 4), ("table", 9)], "life")
    assert values(out, "t", "life") == sorted([("Bank deposit slip", 5), ("portable table", 4), ("none", None), (None, None)], key=str)


def test_longer_of_and_agreement(spark):
    a = spark.createDataFrame([(1, "long text"), (2, "same"), (3, None)], "k INT, t STRING")
    b = spark.createDataFrame([(1, "short"), (2, "tied"), (4, "alone")], "k INT, t STRING")
    assert values(match.longer_of(a, b, "k", "t"), "k", "t", "origin") == [(1, "long text", "left"), (2, "same", "left"), (3, None, "right"), (4, "alone", "right")]
    r = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0), ("y", 9.0), ("z", None), ("z", 3.0)], "k STRING, v DOUBLE")
    assert values(reconcile.agreement(r, ["k"], "v"), "k", "verdict", "agreed") == [("x", "agree", 1.5), ("y", "disagree", None), ("z", "single", None)]


def test_carry_forward_matches_a_loop(spark):
    import random

    random.seed(5)
    rows = [(d, n, random.choice(["schedule", "unknown", "unknown", "attachment"]), random.random() < 0.7) for d in range(30) for n in range(8)]
    df = spark.createDataFrame(rows, "doc INT, n INT, kind STRING, long BOOLEAN")
    fill = (F.col("kind") == "unknown") & F.col("long")
    got = {(r["doc"], r["n"]): r["out"] for r in sequence.carry_forward(df, "doc", ["n"], "kind", fill, "schedule", "out").collect()}
    for doc in range(30):
        before = None
        for d, n, kind, long in rows:
            if d == doc:
                if kind == "unknown" and long and before == "schedule":
                    kind = "schedule"
                before = kind
                assert got[d, n] == kind


def test_sections_last_of_a_letter(spark):
    df = spark.createDataFrame([(1, "SCHEDULE B\nfirst\nschedule c x\nSchedule B last"), (2, None)], "id INT, t STRING")
    assert values(sequence.sections(df, "id", "t", last_only=True), "id", "pos", "letter", "body") == [(1, 2, "C", "x"), (1, 3, "B", "last")]


def test_sections_keep_their_order(spark):
    df = spark.createDataFrame([(1, "intro\nSCHEDULE B\n18,250\nSCHEDULE C\n725\nSCHEDULE B\nx"), (2, "none"), (3, None), (4, "")], "id INT, t STRING")
    assert values(sequence.sections(df, "id", "t"), "id", "pos", "letter", "body") == [(1, 1, "B", "18,250"), (1, 2, "C", "725"), (1, 3, "B", "x")]


def test_page_types(spark):
    texts = ["Business Personal Property RENDITION", "see attached list, original cost", "", None, "notary signature", "Schidule of machinery and equipment: description, cost", "| 12 | 13 | 14 | 15 | 16 | 17 | 18 | a b c d e f g h i j k l m n o p q r s t u v w x y z | 19 | 20 |"]
    out = scoring.classify(spark.createDataFrame([(t,) for t in texts], "t STRING"), F.col("t")).collect()
    assert [r["page_type"] for r in out] == ["main_form", "attachment", "unknown", "unknown", "signature", "schedule", "schedule"]
    assert out[5]["score"] == 1.08  # schedule, schedul, machinery, equipment, description, description + cost, machinery + equipment


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k INT, v STRING")
    news = spark.createDataFrame([(2, "b"), (3, "c")], "k INT, v STRING")
    assert values(change.upsert(base, news, "k"), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert values(change.fill_from(base, news, "k", ["v"]), "k", "v") == [(1, "a"), (2, "b")]
    assert values(change.append_new(base, news, "k"), "k", "v") == [(1, "a"), (2, None), (3, "c")]
    assert values(change.delete_where_in(base, news, "k"), "k") == [(1,)]
    assert values(change.violations(base, {"v": F.col("v").isNotNull(), "k": F.col("k") > 1}), "k", "rule") == [(1, "k"), (2, "v")]
    assert change.upsert(base.limit(0), news, "k").count() == 2


def test_nearest_in_band_equals_all_pairs(spark):
    import random

    random.seed(2)
    labels = [(d, f"l{i}", random.randint(0, 300)) for d in range(4) for i in range(6)]
    amounts = [(d, f"v{i}", random.randint(0, 300)) for d in range(4) for i in range(9)]
    got = match.nearest_in_band(spark.createDataFrame(labels, "k INT, label_id STRING, label_at BIGINT"), spark.createDataFrame(amounts, "k INT, value_id STRING, value_at BIGINT"), "k", 40, 120)
    expected = {}
    for d, i, at in labels:
        near = sorted((abs(v - at), v, j) for e, j, v in amounts if e == d and -40 <= v - at <= 120)
        if near:
            expected[d, i] = near[0][2]
    assert {(r["k"], r["label_id"]): r["value_id"] for r in got.collect()} == expected


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_spans_equal_a_scan(spark):
    import re

    body = "Total cost $ 1,234.50 and (2,000) in 2021; 12 345 units, x99y 77 55,123 100200300400 €1,000 — total\n$20,000 or less 99.95"
    for pattern in (text.MONEY, text.YEAR_IN_TEXT, r"\S+", "total"):
        got = one(spark, text.spans(F.lit(body), pattern))
        assert [(r["start"], r["end"], r["value"]) for r in got] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, body)]
    assert one(spark, text.spans(F.lit(None).cast("string"), "x")) == [] == one(spark, text.spans(F.lit(""), "x"))
    assert [r["value"] for r in one(spark, text.money_spans(F.lit(body)))] == [1234.5, 12345.0, 55123.0, 1000.0, 20000.0]  # 2,000 looks like a year


def test_text_repairs_and_small_functions(spark):
    assert one(spark, text.mended_lower(F.lit("The  Renditlon |\\/ valuo\n"))) == "the rendition l value"
    assert one(spark, text.mended_upper(F.lit("prop€rty  fumiture\n sectton\t6"))) == "PROPERTY FURNITURE\n SECTION 6"
    assert one(spark, text.wrapped(F.lit("aa bb  cc\ndddddddd e"), 5)) == ["aa bb", "cc", "dddddddd", "e"]
    assert one(spark, text.wrapped(F.lit("aa bb cc"), 5, 1)) == ["aa bb"] and one(spark, text.wrapped(F.lit(None).cast("string"))) == []
    assert one(spark, text.missing(["a", "b", "c"], F.array(F.lit("b")))) == ["a", "c"]
    assert one(spark, text.block(F.lit("x START y STOP z"), "START", "STOP")) == "START y " and one(spark, text.block(F.lit("x"), "START", "STOP")) == ""
    assert one(spark, text.block(F.lit("STOP START y"), "START", "STOP")) == "START y"
    stems = {"a/b c.v2.pdf": "b_c.v2", "..": "rendition", "": "rendition", "~~.pdf": "rendition", "plain": "plain", "/x/y.tar.gz": "y.tar"}
    assert all(one(spark, text.safe_stem(F.lit(k))) == v for k, v in stems.items())
    assert one(spark, text.percent(F.lit(0.1234))) == "12.34%" and one(spark, text.shown(F.array(F.lit("a"), F.lit("b")), "array<string>")) == "a | b" and one(spark, text.shown(F.lit(None).cast("string"))) == "-"
    assert [one(spark, text.number(F.lit(t))) for t in ("$12.345", "1,234,567.5", "7.25", "x")] == [12345.0, 1234567.5, 7.25, None]


@pytest.mark.parametrize(("first", "again", "mends"), [("273419", "27,419", True), ("84620", "84,620", True), ("51,300", "91,300", False), ("60,250", "60,250", False), ("7712", "88,121", False), ("none", "1,200", False), (None, None, False)])
def test_second_reading_of_an_amount(spark, first, again, mends):
    assert one(spark, text.rereads(F.lit(first).cast("string"), F.lit(again).cast("string"))) is mends


def test_money_tokens_leave_out_runs_with_years(spark):
    tokens = lambda t: [r["value"] for r in one(spark, text.money_tokens(F.lit(t)))]
    assert tokens("2019 3120 2022") == [] and tokens("8,155; 2019") == [8155.0] and tokens("12 pens") == []


def test_carried_and_set_functions_on_empty_tables(spark):
    empty = spark.createDataFrame([], "id INT, t STRING")
    assert sequence.sections(empty, "id", "t").count() == 0 and scoring.classify(empty, F.col("t")).count() == 0


def test_hot_keys_are_carried_across_parts(spark):
    import random

    random.seed(21)
    rows = [(1 if random.random() < 0.8 else random.randint(2, 5), n, random.choice(["a", "b", "unknown", "unknown", "unknown", "unknown"]), float(n + random.choice([0, 0, 0, 40]) * n % 977)) for n in range(3000)]
    df = spark.createDataFrame(rows, "k INT, n INT, kind STRING, at DOUBLE").repartition(7)
    fill = F.col("kind") == "unknown"
    for hot in (200, 10**9):
        carried = sequence.carry_forward(df, "k", ["n"], "kind", fill, "a", "out", hot)
        cut = sequence.gap_segments(df, "k", ["n"], F.col("at"), 30.0, "segment", hot)
        assert set(carried.columns) == {*df.columns, "out"} and set(cut.columns) == {*df.columns, "segment"}
        got, segments = values(carried, "k", "n", "out"), values(cut, "k", "n", "segment")
        if hot == 200:
            first = (got, segments)
    assert first == (got, segments) and len(got) == 3000


def test_lookups_with_defaults_and_guardrails(spark):
    df = spark.createDataFrame([("a", 1), ("x", 2), (None, 3)], "c STRING, v INT")
    assert values(match.mapped(df, "c", {"a": 5, "other": 9}, "life", "other", "odd"), "v", "life", "odd") == [(1, 5, False), (2, 9, True), (3, 9, True)]
    items = spark.createDataFrame([("k", "5"), ("k", "5.0"), ("k", "6"), ("k", None), ("z", "5"), (None, "5")], "k STRING, v STRING")
    found = spark.createDataFrame([("k", "5"), ("k", "nine"), ("k", None)], "k STRING, c STRING")
    assert values(match.allowed(items, found, "k", "v", "c"), "k", "v", "rejected") == sorted([("k", "5", False), ("k", "5.0", False), ("k", None, True), ("k", None, False), ("z", None, True), (None, None, True)], key=str)
    people = spark.createDataFrame([("u1", "A@x"), ("u2", " b@X "), ("u3", "none")], "p STRING, e STRING")
    members = spark.createDataFrame([(1, "u1", "z@x"), (2, None, "B@x"), (3, None, "a@x")], "m INT, p STRING, e STRING")
    assert values(match.resolve_members(people, members, "m", "p", "e"), "p", "m", "backfill") == [("u1", 1, False), ("u2", 2, True), ("u3", None, False)]


def test_unions_stamps_links_and_backfills(spark):
    a, b = spark.createDataFrame([(1, "x")], "k INT, v STRING"), spark.createDataFrame([(2, 0.5)], "k INT, w DOUBLE")
    assert values(reconcile.union_all([a, b], "s"), "k", "v", "w", "s") == [(1, "x", None, 0), (2, None, 0.5, 1)]
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "k INT, v STRING, at INT")
    news = spark.createDataFrame([(2, "b", None), (3, "d", None), (4, "e", None)], "k INT, v STRING, at INT")
    assert values(change.upsert_stamped(base, news, "k", "at", F.lit(9)), "k", "v", "at") == [(1, "a", 1), (2, "b", 1), (3, "d", 9), (4, "e", 9)]
    members = spark.createDataFrame([("a@x", "d1")], "mail STRING, district STRING")
    added, refused = change.link(members, spark.createDataFrame([("A@x", "d1"), ("A@x ", "d2"), ("new@x", "d3"), ("New@x", "d2")], "mail STRING, district STRING"), "mail", "district")
    assert values(added, "mail", "district") == [("a@x", "d1"), ("new@x", "d2")] and values(refused, "mail", "district") == sorted([("A@x ", "d2"), ("new@x", "d3")], key=str)
    known = spark.createDataFrame([("s", "i1")], "slug STRING, id STRING")
    filled = change.backfilled({"t": spark.createDataFrame([("s", None), ("u", None)], "slug STRING, id STRING"), "other": a}, known, "slug", "id")
    assert values(filled["t"], "slug", "id") == [("s", "i1"), ("u", None)] and filled["other"] is a
    assert change.readable(spark, ["/no/such/table"]) == {"/no/such/table": False}


def test_flags_of_a_form_page(spark):
    page = "SEE ATTACHED list\\nSecton 3 X By checking this box I state\\nSECTION 4\\nSection 5: ☑ Under $20,000  $20,000 or more ✓ more than $125,000 SECTION 6 date, sign"
    flags = one(spark, text.form_flags(F.lit(page.replace("Secton", "Sectton"))))
    assert {n for n, v in flags.asDict().items() if v} == {"see_attached", "section_3_present", "section_5_present", "section_5_over_20k_detected", "section_5_125k_language_detected", "section_3_prior_year_checked", "section_5_under_20k_checked", "section_5_more_than_125k_checked", "signature_block_detected"}
    assert not any(one(spark, text.form_flags(F.lit(None).cast("string"))).asDict().values())
    assert one(spark, text.by_like(F.lit(" Form.PDF "), [("%.pdf", 1)], 0)) == 1
