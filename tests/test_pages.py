"""Word geometry, labels, section rows and page operators, on pages made up for them."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import labels, layout, pages, rows
from cadastra.plans import table_queries

NAMES = list(layout.SUBSECTIONS)


def words(*boxes):
    return [layout.Word(t, float(x), float(top)) for t, x, top in boxes]


def test_first_band_within_reach_takes_a_word():
    random.seed(8)
    for _ in range(50):
        page = [layout.Word("w", random.random() * 100, random.choice(range(0, 120, 3)) + random.random()) for _ in range(60)]
        loop = []  # the plain way: every band so far is asked, in the order they came
        for word in sorted(page, key=lambda w: w.top):
            band = next((b for b in loop if abs(word.top - sum(w.top for w in b) / len(b)) <= 8.0), None)
            if band is None:
                loop.append([word])
            else:
                band.append(word)
        assert [sorted(b.words) for b in layout.bands(page, 8.0)] == [sorted(b) for b in loop]


def test_year_rows():
    page = words(
        ("2019", 400, 100), ("7,310", 330, 103), ("2018", 400, 150), ("$9,125.50", 320, 148), ("2017", 400, 200), ("6,400", 390, 201), ("1,850", 350, 199),  # the second amount of 2017 finds its year taken
        ("2016", 400, 250), ("4,200", 100, 250),  # too far left
        ("2015", 400, 300), ("640", 380, 300), ("2014", 380, 300),  # less than the least amount, and a year
        ("Totals", 300, 600), ("2013", 400, 640), ("8,888", 380, 640),  # below the total
    )
    assert [(y, a) for y, a, _, _ in layout.year_rows(page)] == [(2019, 7310.0), (2018, 9125.5), (2017, 1850.0)]
    assert layout.year_rows([]) == [] == layout.year_rows(words(("2019", 1, 1)))
    twice = words(("2019", 100, 50), ("5,000", 120, 50), ("2019", 400, 50), ("5,000", 420, 50))
    assert [(y, a, x) for y, a, x, _ in layout.year_rows(twice)] == [(2019, 5000.0, 420.0)]


def test_headings_and_their_groups():
    page = words(("Furniture", 50, 100), ("&", 120, 100), ("Office", 600, 102), ("Equipment", 660, 101), ("Machinery", 300, 99), ("and", 380, 100), ("Equipment", 420, 100), ("Computer", 60, 700), ("equipment", 130, 703), ("OTHER", 610, 702))
    found = layout.heading_places(page)
    assert set(found) == {"office_equipment", "machinery_equipment", "computer_equipment", "other"} and found["machinery_equipment"][0] == 300.0
    assert layout.nearest_heading(60, 560, found) == "machinery_equipment"  # above the lower group, though its heading is nearer
    assert layout.nearest_heading(60, 600, found) == "computer_equipment" and layout.nearest_heading(1, 1, {}) is None


def test_rows_of_six_regions():
    boxes, expected = [], set()
    for k, name in enumerate(NAMES):
        x, top = 80 + 400 * (k % 3), 150 + 500 * (k // 3)
        boxes += [(str(2011 + k), x, top), (f"{11 + k},{300 + k}", x + 30, top + 2), (f"{k + 3},250", x + 70, top + 1)]
        expected.add((name, 2011 + k, float(f"{11 + k}{300 + k}"), float(f"{k + 3}250")))
    page = words(*boxes, ("x", 30, 40), ("y", 1190, 40), ("TOTAL", 80, 900), ("99,999", 120, 901))
    got = layout.subsection_rows(page)
    assert {r[:4] for r in got} == expected and all(r[5] == layout.SURE for r in got)
    assert [r[1:4] for r in layout.subsection_rows(words(("3,100", 10, 10), ("2,200", 60, 10), ("5,000", 10, 90)))] == [(None, None, 2200.0)]
    assert layout.subsection_rows([]) == [] == layout.subsection_totals([])


def test_lower_rows_stay_with_the_upper_heading():
    page = words(("Furniture", 60, 200), ("Fixtures", 130, 200), ("Other", 900, 200), ("POS", 60, 1000), ("2012", 70, 800), ("23,456", 120, 801))
    assert [(r[0], r[1], r[2]) for r in layout.subsection_rows(page)] == [("furniture_fixtures", 2012, 23456.0)]


def test_totals_come_from_their_own_column_and_row():
    page = words(("Furniture", 60, 100), ("Fixtures", 130, 100), ("Machinery", 500, 100), ("Equipment", 560, 100), ("Total", 70, 400), ("61,250", 160, 404), ("TOTAL", 510, 400), ("7,400", 600, 395), ("88,000", 160, 300), ("x", 1200, 400))
    assert dict(layout.subsection_totals(page)) == {"furniture_fixtures": 61250.0, "machinery_equipment": 7400.0}


def test_halves_of_a_page():
    at = lambda *tops: words(*[("w", 1, t) for t in tops])
    assert layout.halves([]) == 0.0 and layout.halves(at(10, 20)) == 15.0
    assert layout.halves(at(0, 30, 60, 300, 320)) == 180.0 and layout.halves(at(0, 30, 60)) == 30.0
    assert layout.halves([*at(0, 50, 200, 260), layout.Word("Total", 1, 100)]) == 150.0


def test_page_operators_over_tables(spark):
    boxes = [{"text": "2019", "x0": 400.0, "top": 100.0}, {"text": "7,310", "x0": 330.0, "top": 103.0}, {"text": None, "x0": None, "top": None}]
    df = spark.createDataFrame([(1, boxes, "x"), (2, [], "x"), (3, None, "x")], f"page_id BIGINT, words {layout.WORDS}, year STRING")
    assert [(r["page_id"], r["year"], r["amount"]) for r in layout.page_pairs(df, "page_id", "words").collect()] == [(1, 2019, 7310.0)]
    assert layout.page_subsection_rows(df, "page_id", "words").count() == 1 and layout.page_subsection_totals(df.limit(0), "page_id", "words").count() == 0
    assert df.select(layout.reading_order("words").alias("t")).first()["t"] == "2019 7,310" == df.select(layout.in_given_order("words").alias("t")).first()["t"]
    laid = spark.createDataFrame([(1, "2023   81,166\n 2022  2022"), (2, ""), (3, None)], "id INT, t STRING")
    got = {r["id"]: sorted((w["top"], w["x0"], w["text"]) for w in r["words"]) for r in layout.words_of_lines(laid, "id", "t", 12.0, 1.0).collect()}
    assert got == {1: [(0.0, 0.0, "2023"), (0.0, 7.0, "81,166"), (12.0, 1.0, "2022"), (12.0, 7.0, "2022")]}


def best_amount(page, wanted, base):
    """The rule of labels.best_amount, pair by pair."""
    low = re.sub(r"\s+", " ", page.replace("\x00", " ")).strip().lower()
    for bad, good in text.LOWER_REPAIRS.items():
        low = low.replace(bad, good)
    found = []
    for i, label in enumerate(wanted):
        at = low.find(label)
        for m in re.finditer(text.MONEY, page) if at >= 0 else ():
            value = layout.read_amount(re.sub(r"[($)]", "", m.group()))  # the same reading of one amount, tested by itself
            distance = m.start() - at
            if value is None or not 100 <= value <= 1e9 or (value == int(value) and 1900 <= value <= 2049) or not -40 <= distance <= 180:
                continue
            around = low[max(0, at - 35) : m.end() + 35]
            if value in text.FORM_LIMITS and any(w in around for w in labels.DROP_WORDS):
                continue
            score = base + max(0.0, (180 - abs(distance)) / 180) * 0.1 + 0.04 * ("total" in around) - 0.2 * any(w in around for w in labels.NOISE) - 0.6 * any(w in around for w in labels.LIMIT_WORDS)
            found.append((score, value, -i, -m.start(), label))
    return max(found) if found else None


def test_amounts_beside_labels_equal_all_pairs(spark):
    random.seed(12)
    bits = ["historical cost", "total", "phone 555", "or less", "$20,000", "1,250.00", "(3,400)", "2021", "99", "market value", "page 4", "the lathe", "125,000", "zip", "Renditlon"]
    texts = [" ".join(random.choice(bits) for _ in range(random.randint(1, 40))) for _ in range(120)] + ["", "total"]
    wanted = ["historical cost", "market value", "total"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = {r["i"]: r["b"] for r in labels.measured(df, F.col("t")).select("i", labels.best_amount(F.col("_mended"), F.col("_money"), wanted, 0.7).alias("b")).collect()}
    for i, page in enumerate(texts):
        best = best_amount(page, wanted, 0.7)
        assert (got[i] is None) == (best is None), page
        if best:
            assert got[i]["score"] == pytest.approx(best[0]) and (got[i]["value"], got[i]["first"], got[i]["place"], got[i]["label"]) == best[1:]


def test_candidates_of_fields(spark):
    page = "GENERAL   Historical cost: $ 48,250.00 for all. Year acquired 2017. Good faith estimate 31,900 as its owner sees it in all of the county, not more than $20,000"
    df = spark.createDataFrame([(1, page, "f"), (2, None, "f"), (3, "nothing", "f")], "id INT, t STRING, field STRING")
    got = {r["field"]: r for r in labels.candidates(df, ["id"], "t", {"cost": (["historical cost"], 0.7), "value": (["good faith"], 0.72)}, {"acquired": (["year acquired"], 0.68)}).collect()}
    assert {f: (r["id"], r["value"], r["rule"]) for f, r in got.items()} == {"cost": (1, 48250.0, "near_label:historical cost"), "value": (1, 31900.0, "near_label:good faith"), "acquired": (1, 2017.0, "near_label:year acquired")}
    assert got["cost"]["raw"] == "$ 48,250.00" and "48,250.00 for all" in got["cost"]["evidence"] and got["acquired"]["confidence"] == pytest.approx(0.749, abs=0.001)


def test_rows_of_sections(spark):
    page = (
        "Intro 5,000\nSCHEDULE A\nGood faith  Historical cost\nlathe, 4,100; 6,250; 2014\nstock 3,300\npair 1,100 ; 2,200\nTOTAL 9,999\nSchedule B\nold 1\nSCHEDULE B\npaper 18,400\n"
        "SCHEDULE E\nloose 7,700\nOffice equipment\n8,800; 2018\nComputer equipment: 3,300; 4,400\nSCHEDULE F\nother 12,000"
    )
    df = spark.createDataFrame([(1, page, 3), (2, None, 3), (3, "", 3)], "id INT, t STRING, pos INT")
    got = rows.schedule_rows(df, ["id"], "t").orderBy("schedule", "pos").collect()
    assert [(r["schedule"], r["subsection"], r["year_acquired"], r["historical_cost"], r["good_faith_value"], r["exact_value"]) for r in got] == [
        ("A", None, 2014, 6250.0, 4100.0, None),
        ("A", None, None, None, 3300.0, None),
        ("A", None, None, 2200.0, 1100.0, None),
        ("B", None, None, None, None, 18400.0),
        ("E", "office_equipment", 2018, 8800.0, None, None),
        ("E", "computer_equipment", None, None, 4400.0, None),
    ]
    assert all(r["confidence"] == rows.CONFIDENCE[r["schedule"]] for r in got) and rows.schedule_rows(df.limit(0), ["id"], "t").count() == 0


def test_totals_of_page_text(spark):
    read = lambda f, t: spark.range(1).select(f(F.lit(t).cast("string")).alias("x")).first()["x"]
    s = read(rows.section_total, "Schidule E machinery and equipment 61,000\nTotal cost: $ 1 84,500.25 and 20,000\n70,000")
    assert (s["present"], s["machinery"], s["total"]) == (True, True, 184500.25)
    assert read(rows.section_total, "SCHEDULE E 61,000 and 125,000")["total"] == 61000.0 and read(rows.section_total, "61,000")["total"] is None and read(rows.section_total, None)["present"] is False
    a = read(rows.attachment_summary, "Summary by state class 12,400 and 8,250\n150,000")
    assert (a["present"], a["amounts"], a["total"]) == (True, [12400.0, 8250.0], 12400.0)
    assert read(rows.attachment_summary, "5,500 GRAND TOTAL 44,100.50")["total"] == 44100.5 and read(rows.attachment_summary, "5,500")["total"] is None


PAGE = "doc INT, page_number INT, text STRING, words ARRAY<STRUCT<text: STRING, x0: DOUBLE, top: DOUBLE>>, error STRING, source STRING"


def test_merging_two_readings(spark):
    w = lambda t, x, y: {"text": t, "x0": x, "top": y}
    left = spark.createDataFrame([(1, 1, "short", [w("a", 1.2, 5.0), w(" ", 0.0, 0.0)], None, "l"), (1, 2, "same", None, None, "l"), (1, 3, " ", None, "timeout", "l"), (1, 4, "lone", None, "kept?", "l")], PAGE)
    right = spark.createDataFrame([(1, 1, "a longer text", [w("b", 2.0, 5.0), w("a", 1.4, 4.9)], None, "r"), (1, 2, "tied", [w("t", 0.0, 0.0)], None, "r"), (1, 3, "", None, "quota", "r"), (1, 5, "right", None, None, "r")], PAGE)
    got = {r["page_number"]: r for r in pages.merge_readings(left, right, ["doc", "page_number"], ("l", "r")).collect()}
    assert (got[1]["text"], got[1]["preferred"], got[1]["sources"], [x["text"] for x in got[1]["words"]]) == ("a longer text", "r", ["l", "r"], ["b", "a"])
    assert (got[2]["text"], got[2]["preferred"], [x["text"] for x in got[2]["words"]]) == ("same", "l", ["t"])
    assert (got[3]["error"], got[3]["sources"]) == ("timeout", []) and got[4]["error"] is None and got[5]["preferred"] == "r" and len(got) == 5


def test_document_level_operators(spark):
    good = "Rendition of the property owner. Schedule A good faith, historical cost and year acquired follow below for the whole of the office. " * 3
    data = [(1, 1, good, None, None, "a"), (1, 2, good, None, "e2", "a"), (2, 1, "x", None, "e1", "a"), (2, 2, None, None, "e1", "b"), (3, 1, "a1b2 c3d4 " * 20, None, "", "b")]
    df = spark.createDataFrame(data, PAGE).withColumn("gone", F.col("text").isNull())
    need = {r["doc"]: r["reason"] for r in pages.needs_reading(df, ["doc"], "page_number", "text").collect()}
    assert need == {1: None, 2: "little text", 3: "odd tokens"}
    flags = {r["doc"]: (r["low_text"], r["unavailable"], r["errors"]) for r in pages.flags(df, ["doc"], "text", "error", "gone").collect()}
    assert flags == {1: (False, False, ["e2"]), 2: (True, True, ["e1"]), 3: (False, False, [])}
    seen = {(r["doc"], r["source"]): r["pages"] for r in pages.by_provider(df, ["doc"], "source", "page_number", "text", "error").collect()}
    assert seen == {(1, "a"): 2, (2, "a"): 1, (3, "b"): 1}
    q = df.where("doc = 1 AND page_number = 1").select(pages.quality(F.col("text"), F.lit(1)).alias("q")).first()["q"]
    assert q["missing_schedules"] == ["B", "C", "D", "E"] and q["missing_columns"] == ["inventory", "actual cost", "supplies"] and not q["usable"] and 0.4 < q["score"] < 0.6
    assert pages.needs_reading(df.limit(0), ["doc"], "page_number", "text").count() == 0


def test_metadata_from_the_first_pages(spark):
    w = [{"text": "P-", "x0": 0.0, "top": 0.0}, {"text": "0042137", "x0": 0.0, "top": 0.0}]
    data = [(1, 2, "Date signed: 4/2/2022", None, None, "a"), (1, 1, "2022 Business Personal Property\nOwner name: DOLMER & SONS\n", w, None, "a"), (1, 3, "tax year 1999", None, None, "a"), (2, 1, "Account no. 77-1234", None, None, "a"), (3, 1, None, None, None, "a")]
    got = {r["doc"]: tuple(r)[1:] for r in pages.metadata(spark.createDataFrame(data, PAGE), ["doc"], "page_number", "text", "words").collect()}
    assert got[1] == ("2022", "DOLMER & SONS", "P0042137", "4/2/2022")
    assert got[2][2] == "771234" and got[3] == (None, None, None, None)


@pytest.mark.parametrize("read", [layout.page_headings, layout.page_subsection_rows, layout.page_subsection_totals, layout.page_pairs])
def test_one_batch_of_long_pages_is_read_in_pieces(spark, read):
    words = [{"text": t, "x0": 50.0 * i, "top": 12.0 * n} for n in range(50) for i, t in enumerate(["OTHER", "2024", "5,000", "each"] if n < 40 else ["TOTAL", "7,000", "and", "more"])]
    kind = pa.list_(pa.struct([("text", pa.string()), ("x0", pa.float64()), ("top", pa.float64())]))
    one = pa.RecordBatch.from_arrays([pa.array([1], type=pa.int64()), pa.array([words], type=kind)], names=["page_id", "words"])
    table = pa.Table.from_batches([one] * 1000).combine_chunks()
    batch = pa.RecordBatch.from_arrays([c.chunk(0) for c in table.columns], names=["page_id", "words"])
    taken = []

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            taken.append(run)

    read(Frame(), "page_id", "words")
    tracemalloc.start()
    rows = sum(out.num_rows for out in taken[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000 * sum(out.num_rows for out in taken[0](iter([one]))) > 0 and peak < 30e6, peak


@pytest.mark.parametrize("name, read", [("subsection_rows", layout.page_subsection_rows), ("subsection_totals", layout.page_subsection_totals), ("year_amount_pairs", layout.page_pairs)])
def test_text_is_laid_out_where_it_is_read(spark, monkeypatch, name, read):
    form = "Computer  Equipment\r\n\n2021   5,000\t1,200\x0b2019 4,000\u00a03,100\nOTHER\n2020 7,000\ntOtAl  61,000 Total 9,500\nl\u0131ght 2,5OO 8,100"
    texts = [form, form + "\n" * 30 + form.upper(), None, "", " \n ", "total of none", "2021 alone", "3,000 4,000", "no such thing", "\u0662 \u0663\u0664 2\u0660\u0661\u0665", "TOTAL 5,000\n" * 200, "2021 5,000 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    monkeypatch.setattr(table_queries, "_t", lambda spark, d, table: docs)
    got = table_queries.queries()[name](spark, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1, "boxes go through the engine"
    boxed = read(layout.words_of_lines(docs, "doc_id", "text"), "doc_id", "words")
    assert got.schema == boxed.schema and sorted(map(str, got.collect())) == sorted(map(str, boxed.collect())) and {0, 1} <= {r["page_id"] for r in got.collect()}
