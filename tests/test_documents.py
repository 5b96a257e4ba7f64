"""From pages to fields, on pages made up for it."""

import pytest

from cadastra.operators import documents

PAGE = "doc INT, page INT, page_id BIGINT, text STRING, words ARRAY<STRUCT<text: STRING, x0: DOUBLE, top: DOUBLE>>, score STRING"
FORM = "Business personal property rendition. Property owner Dolmer. Good faith estimate of market value: $ 61,400.00 as the place stood when the year began and no later. Rendered value 58,200"
SCHEDULE = "Schedule of furniture and fixtures, machinery and equipment: description, quantity, cost"
LIST = "See attached list. Original cost 44,750 for all. Year acquired 2016. Useful life 8 years. Attachment"
MORE = "kilns and vats of the west hall, continued from the page before with nothing else said about them"
PAGES = [(1, 1, 11, FORM, None, "x"), (1, 2, 12, SCHEDULE + " Grand total 99,100", None, "x"), (1, 3, 13, MORE, None, "x"), (1, 4, 14, MORE, None, "x"), (1, 5, 15, "short", None, "x"), (1, 6, 16, MORE, None, "x"), (2, 1, 21, MORE, None, "x"), (2, 2, 22, LIST, None, "x"), (3, 1, 31, None, None, "x")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE)


def test_kinds_go_on_from_a_schedule(pages):
    got = {(r["doc"], r["page"]): (r["page_type"], r["score"]) for r in documents.classified(pages, ["doc"], "page", "text").collect()}
    assert [got[1, n][0] for n in range(1, 7)] == ["main_form", "schedule", "schedule", "schedule", "unknown", "unknown"]
    assert got[1, 3][1] == documents.GOES_ON_SCORE and got[2, 1][0] == "unknown" and got[2, 2][0] == "attachment" and got[3, 1][0] == "unknown"


def test_fields_of_documents(pages):
    got = {(r["doc"], r["field"]): (r["value"], r["page_type"]) for r in documents.resolved(pages, ["doc"], "page", "text").collect()}
    assert got[1, "good_faith_value"] == (61400.0, "main_form") and got[1, "rendered_value"] == (58200.0, "main_form") and got[1, "attachment_total"] == (99100.0, "schedule")
    assert got[2, "historical_cost"] == (44750.0, "attachment") and got[2, "acquisition_year"] == (2016.0, "attachment") and got[2, "life_years"] == (8.0, "attachment")
    assert not any(doc == 3 for doc, _ in got) and documents.resolved(pages.limit(0), ["doc"], "page", "text").count() == 0


def test_a_schedule_without_labels_gives_its_largest_amount(spark):
    rows = [(1, 1, 1, "schedule: machinery, quantity, 3,300 and 8,150", None, "x"), (2, 1, 2, "schedule e: machinery, quantity, 3,300 and 8,150", None, "x")]
    got = documents.resolved(spark.createDataFrame(rows, PAGE), ["doc"], "page", "text").collect()
    assert [(r["doc"], r["value"], r["rule"]) for r in got] == [(1, 8150.0, "largest_plausible_schedule_amount")]


def test_scores_best_and_order(spark):
    rows = [(1, 1, "main_form", 0, "historical_cost", 5.0, 0.8), (1, 2, "attachment", 0, "historical_cost", 6.0, 0.7), (1, 3, "attachment", 1, "historical_cost", 7.0, 0.7), (1, 3, "attachment", 2, "historical_cost", 7.0, 0.6), (1, 3, "signature", 0, "other", None, 0.1)]
    df = documents.scored(spark.createDataFrame(rows, "doc INT, page INT, page_type STRING, seq BIGINT, field STRING, value DOUBLE, confidence DOUBLE"))
    assert sorted(r["score"] for r in df.collect()) == [0.1, 0.65, 0.7, 0.8, 0.8]
    assert {r["field"]: r["value"] for r in documents.best_fields(df, ["doc"], "page").collect()} == {"historical_cost": 6.0, "other": None}
    assert documents.deduped(df, ["doc"], "page").count() == 4
    assert [r["value"] for r in documents.buckets(df, ["doc"], "page", 2).where("field = 'historical_cost'").orderBy("rank").collect()] == [6.0, 7.0]
    stated = spark.createDataFrame([(1, "other", 9.0), (1, "new", 3.0), (1, "historical_cost", None)], "doc INT, field STRING, value DOUBLE")
    fields = documents.best_fields(df, ["doc"], "page").select("doc", "field", "value")
    assert {r["field"]: (r["value"], r["overridden"]) for r in documents.overridden(fields, stated, ["doc"]).collect()} == {"historical_cost": (6.0, False), "other": (9.0, True), "new": (3.0, True)}


def test_candidates_by_context(spark):
    rows = [(1, 1, 1, "Rendition. Good faith total 61,400 or so, the owner says. " + "x " * 120 + "Original cost 8,250.00 of lathes. " + "y " * 120 + "fax 5550123 " + "z " * 120 + "Year acquired 2014", None, "x"), (1, 2, 2, "market value 4,000 not more than", None, "x"), (2, 1, 3, None, None, "x")]
    got = {r["value"]: r for r in documents.context_candidates(spark.createDataFrame(rows, PAGE), ["doc"], "page", "text").collect()}
    assert set(got) == {61400.0, 8250.0, 2014.0}
    assert (got[61400.0]["field"], got[61400.0]["page_type"], got[61400.0]["score"]) == ("good_faith_value", "cover_page", 10 + 4 + 5 + 2 + 1.5 + 4)
    assert (got[8250.0]["field"], got[8250.0]["score"], got[8250.0]["confidence"]) == ("historical_cost", 8 + 4 + 1.5 + 4, 0.875)
    assert (got[2014.0]["field"], got[2014.0]["confidence"]) == ("acquisition_year", 0.75)


def test_line_items_from_lines_and_places(spark):
    w = lambda t, x, y: {"text": t, "x0": float(x), "top": float(y)}
    boxes = [w("OFFICE", 50, 10), w("EQUIPMENT", 110, 10), w("2018", 60, 100), w("7,300", 120, 101), w("x", 900, 300)]
    rows = [(1, 1, 1, "SCHEDULE B\npaper 18,400\npaper 18,400\nSCHEDULE E\nother 9,900", boxes, "x"), (1, 2, 2, "SCHEDULE E\nOther things 6,600\nSCHEDULE F\nlate 1,234", None, "x"), (2, 1, 3, None, None, "x")]
    got = documents.line_items(spark.createDataFrame(rows, PAGE), ["doc"], "page", "page_id", "text", "words").collect()
    assert sorted((r["page"], r["schedule"], r["subsection"], r["year_acquired"], r["historical_cost"], r["good_faith_value"], r["exact_value"]) for r in got) == [
        (1, "B", None, None, None, None, 18400.0), (1, "E", "office_equipment", 2018, 7300.0, None, None), (2, "E", "other", None, None, 6600.0, None),
    ]
