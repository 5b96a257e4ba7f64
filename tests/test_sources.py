"""Readers, payloads, providers, writers and the stream, over files in a temporary folder."""

import json

from pyspark.sql import functions as F

from cadastra.sources import payloads, providers, readers, writers
from cadastra.streaming import queue


def test_pages_json_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"page_number": 3, "text": " a\n b "}, {"page_text": "c"}]))
    (tmp_path / "b.json").write_text(json.dumps({"document_pages": [{"content": "d", "blocks": [{"text": "d", "x0": 1.0}]}]}))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    rows = readers.pages_json(spark, str(tmp_path)).orderBy("file", "page_number").collect()
    assert [(r["page_number"], r["text"]) for r in rows if not r["error"]] == [(2, "c"), (3, "a b"), (1, "d")]
    assert sum(r["error"] is not None for r in rows) == 1


def test_text_folder_in_name_order(spark, tmp_path):
    for name, body in (("page1.txt", "one"), ("page10.txt", "ten  x"), ("page2.txt", "two")):
        (tmp_path / name).write_text(body)
    assert [(r["page_number"], r["text"]) for r in readers.text_folder(spark, str(tmp_path)).orderBy("page_number").collect()] == [(1, "one"), (2, "ten x"), (3, "two")]
    assert readers.newest_file(spark, str(tmp_path), "*.txt").count() == 1


def test_csv_and_keywords(spark, tmp_path):
    (tmp_path / "f.csv").write_text("life_years,acquisition_year,percent_good\n9,2025,0.9\n\n9,2024,0.8\n")
    (tmp_path / "k.csv").write_text("keyword,life_years\ncomputer,5\n\nDesk,9\n")
    assert readers.csv_table(spark, str(tmp_path / "f.csv"), "life_years INT, acquisition_year INT, percent_good DOUBLE").count() == 2
    assert readers.keyword_table(spark, str(tmp_path / "k.csv")) == [("computer", 5), ("desk", 9)]


def test_queue_is_appended_and_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "a-cad", "Ready"), ("f2", None, "Error")], "file_name STRING, district_slug STRING, status STRING")
    for _ in range(2):
        writers.append_queue(rows, str(tmp_path / "q"))
    read = spark.read.parquet(str(tmp_path / "q"))
    assert read.count() == 4 and read.where("district_slug = 'shared'").count() == 2
    records = rows.withColumn("flags", F.array(F.lit("x"), F.lit("y")))
    writers.summary_csv(records, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first()["flags"] == "x | y"
    writers.review_json(records, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert "status: Ready" in writers.report(rows, "T", ["file_name", "status"]).first()["report"]


def frame(spark, *payloads_):
    return spark.createDataFrame([(i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads_, 1)] + [(99, "{"), (100, None)], "k INT, payload STRING")


def anchored(*segments):
    return {"textAnchor": {"textSegments": [{k: v for k, v in (("startIndex", str(a) if a else None), ("endIndex", str(b))) if v} for a, b in segments]}}


INVENTORY = {
    "text": "Lathes owned\nSaw bench 88\nColour blue",
    "pages": [
        {
            "pageNumber": 4, "dimension": {"width": 400, "height": 250}, "imageQualityScores": {"qualityScore": 0.5},
            "lines": [{"layout": anchored((0, 13))}, {"layout": anchored((13, 25))}],
            "tokens": [{"confidence": 0.75, "layout": {**anchored((0, 6)), "confidence": 0.1, "boundingPoly": {"normalizedVertices": [{"x": 0.5, "y": 0.1}, {"x": 0.75, "y": 0.3}]}}}, {"layout": {**anchored((13, 16)), "confidence": 0.25, "boundingPoly": {"vertices": [{"x": 7, "y": 30}, {"x": 19}]}}}],
            "tables": [{"layout": {"confidence": 0.9}, "bodyRows": [{"cells": [{"layout": anchored((13, 22))}, {"layout": anchored((23, 25))}]}]}],
            "formFields": [{"fieldName": anchored((26, 32)), "fieldValue": anchored((33, 37)), "valueType": "colour"}],
        }
    ],
}


def test_document_replies_plain_and_wrapped(spark):
    df = frame(spark, INVENTORY, {"document": INVENTORY}, {"document": {"text": " only text "}})
    got = {r["k"]: r for r in payloads.document_pages(df, "k").collect()}
    for k in (1, 2):
        page = got[k]
        assert (page["page_number"], page["text"]) == (4, "Lathes owned\nSaw bench 88")
        assert [(w["text"], w["x0"], w["x1"], w["top"], w["y1"], w["confidence"]) for w in page["words"]] == [("Lathes", 200.0, 300.0, 25.0, 75.0, 0.75), ("Saw", 7.0, 19.0, 0.0, 30.0, 0.25)]
    assert (got[3]["page_number"], got[3]["text"]) == (1, "only text")
    assert [(r["k"], r["page_number"], r["table_number"], r["row_number"], r["cells"], r["confidence"]) for r in payloads.document_tables(df, "k").orderBy("k").collect()] == [(k, 4, 1, 1, ["Saw bench", "88"], 0.9) for k in (1, 2)]
    assert [(r["k"], r["name"], r["value"], r["kind"]) for r in payloads.document_fields(df, "k").orderBy("k").collect()] == [(k, "Colour", "blue", "colour") for k in (1, 2)]
    assert payloads.document_layout(df, "k").where("k = 1").first().asDict() == {"k": 1, "page_number": 4, "width": 400.0, "height": 250.0, "quality": 0.5}
    assert {r["k"]: r["confidence"] for r in payloads.document_confidence(df, "k").collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 99: 0.0, 100: 0.0}


def test_other_replies(spark):
    analysis = {"analyzeResult": {"content": "n", "pages": [{"pageNumber": 2, "lines": [{"content": "Kiln 3"}, {"content": "Vat"}], "words": [{"content": "Kiln", "polygon": [4, 9, 31, 9, 31, 17, 4, 17]}]}]}}
    page = payloads.analysis_pages(frame(spark, analysis), "k").collect()
    assert len(page) == 1 and (page[0]["words"][0]["x1"], page[0]["words"][0]["y1"]) == (31.0, 17.0) and page[0]["text"] == "Kiln 3\nVat"
    letter = lambda t, x, y: {"boundingBox": {"vertices": [{"x": x, "y": y}]}, "symbols": [{"text": c} for c in t]}
    annotation = {"fullTextAnnotation": {"text": "q", "pages": [{"blocks": [{"paragraphs": [{"words": [letter("low", 5, 90), letter("right", 70, 8)]}, {"words": [letter("left", 3, 8)]}]}]}]}}
    assert [w["text"] for w in payloads.annotation_words(frame(spark, annotation), "k").where("k = 1").first()["words"]] == ["left", "right", "low"]
    reply = spark.createDataFrame([(1, "PAGE 5:\nfirst\nPAGE 6:\nsecond"), (2, "unmarked")], "k INT, t STRING")
    assert sorted((r["k"], r["page_number"], r["text"]) for r in payloads.marked_pages(reply, "k", "t").collect()) == [(1, 5, "first"), (1, 6, "second"), (2, 1, "unmarked")]
    kinds = spark.createDataFrame([("PERMISSION denied",), ("page limit",), (None,)], "e STRING").select(payloads.error_kind(F.col("e"), ["permission"], ["limit"]).alias("k"), payloads.error_summary(F.col("e"), 8).alias("s"))
    assert [(r["k"], r["s"]) for r in kinds.collect()] == [("terminal", "PERMISS…"), ("retry", "page li…"), ("other", "")]


def test_queue_of_both_header_generations(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "old.csv").write_text("processed_at,file_name,status\n2021-02-01,a.pdf,Ready\n2021-02-03,b.pdf,Error\n")
    (tmp_path / "q" / "new.csv").write_text('processed_at,file_name,district_id,owner_name,status,recommended_value,extra\n2021-02-02,c.pdf,d1,"Kiln, Vat & ""Co""",Locked,12.5,x\n2021-02-04,d.pdf,d2,,Ready,none,x\n')
    (tmp_path / "q" / "empty.csv").write_text("")
    got = [(r["file_name"], r["district_id"], r["owner_name"], r["status"], r["recommended_value"]) for r in readers.queue_csv(spark, str(tmp_path / "q")).collect()]
    assert got == [("d.pdf", "d2", None, "Ready", None), ("b.pdf", None, None, "Error", None), ("c.pdf", "d1", 'Kiln, Vat & "Co"', "Locked", 12.5), ("a.pdf", None, None, "Ready", None)]


def test_reviews_replace_their_own_stem_only(spark, tmp_path):
    path = str(tmp_path / "r")
    write = lambda *rows: writers.review_json(spark.createDataFrame(list(rows), "file_name STRING, district_slug STRING, value DOUBLE"), path)
    write(("f1.pdf", "a-cad", 1.0), ("f2.pdf", "a-cad", 2.0), ("f1.pdf", "b-cad", 3.0), ("f9.pdf", None, 9.0))
    write(("f2.pdf", "a-cad", 20.0), ("f3.pdf", "a-cad", 30.0))
    got = sorted((r["district_slug"], r["stem"], r["value"]) for r in spark.read.json(path).collect())
    assert got == [("a-cad", "f1", 1.0), ("a-cad", "f2", 20.0), ("a-cad", "f3", 30.0), ("b-cad", "f1", 3.0), ("shared", "f9", 9.0)]


def test_queue_types_stay_when_columns_are_missing(spark, tmp_path):
    writers.append_queue(spark.createDataFrame([("f1", "Ready")], "file_name STRING, status STRING"), str(tmp_path / "q"))
    writers.append_queue(spark.createDataFrame([("f2", 7.5)], "file_name STRING, recommended_value DOUBLE"), str(tmp_path / "q"))
    assert sorted((r["file_name"], r["recommended_value"]) for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [("f1", None), ("f2", 7.5)]


def test_overrides_exported_pages_and_backfill(spark, tmp_path):
    assert readers.overrides(spark, str(tmp_path / "none.json")).collect()[0]["notes"] == ""
    (tmp_path / "o.json").write_text('{"historical_cost": 12.5, "acquisition_year": 2019}')
    row = readers.overrides(spark, str(tmp_path / "o.json")).first()
    assert (row["historical_cost"], row["acquisition_year"], row["notes"], row["life_years"]) == (12.5, 2019, "", None)
    source = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("b", 1, "x")], "file STRING, page_number INT, text STRING")
    writers.pages_json(source, str(tmp_path / "pages"))
    assert sorted((r["page_number"], r["text"]) for r in readers.pages_json(spark, str(tmp_path / "pages")).collect() if r["text"]) == [(1, "one"), (1, "x"), (2, "two")] or spark.read.text(str(tmp_path / "pages")).count() == 2
    old = spark.createDataFrame([("f1", 1), ("f2", 2), ("f2", 2)], "file_name STRING, v INT")
    assert [tuple(r) for r in writers.backfill(old, spark.createDataFrame([("f1", 9)], "file_name STRING, v INT")).collect()] == [("f2", 2)]
    (tmp_path / "x_final.json").write_text('{"a": 1}')
    (tmp_path / "y_final.json").write_text("{")
    assert sorted((r["file_name"], r["record"] is None) for r in readers.final_reviews(spark, str(tmp_path)).collect()) == [("x_final.json", False), ("y_final.json", True)]


def test_providers_try_again_and_give_up(spark):
    def passing(path, content, seen={}):  # noqa: B006 - counts the calls of one worker
        seen[path] = seen.get(path, 0) + 1
        if seen[path] == 1:
            raise TimeoutError("timed out")
        return [(1, path)]

    def refused(path, content):
        raise PermissionError("permission denied")

    files = spark.createDataFrame([(p, bytearray(b"x")) for p in "abc"], "path STRING, content BINARY").coalesce(1)
    got = providers.read_pages(files, {"passing": passing, "refused": refused}).collect()
    assert sorted(r["text"] for r in got if r["provider"] == "passing") == ["a", "b", "c"]
    assert [r["path"] for r in got if r["provider"] == "refused"] == ["a"]  # skipped after the first
    broken = providers.read_pages(files.limit(1), {"pdf": providers.pdf_text}).collect()
    assert len(broken) == 1 and broken[0]["error"] and broken[0]["text"] is None


def test_providers_turn_errors_into_rows(spark):
    def broken(path, content):
        raise ValueError("no")

    files = spark.createDataFrame([("a", bytearray(b"one\ftwo"))], "path STRING, content BINARY")
    rows = providers.read_pages(files, {"text": providers.plain_text, "bad": broken, "off": broken}, frozenset({"off"})).collect()
    assert sorted((r["provider"], r["page_number"], r["text"], r["error"]) for r in rows if r["provider"] == "text") == [("text", 1, "one", None), ("text", 2, "two", None)]
    assert [r["error"] for r in rows if r["provider"] != "text"] == ["ValueError: no"]


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "k INT, at INT, v STRING"
    for i in range(6):
        spark.createDataFrame([(i % 2, i, f"v{i}"), (9, -i, "old")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = queue.ingest_latest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "k", "at", str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(0, "v4"), (1, "v5"), (9, "old")]


def test_providers_of_words(spark):
    def boxes(path, content):
        return [(1, [{"text": t, "x0": float(i), "x1": i + 0.5, "top": 2.0} for i, t in enumerate(content.decode().split())]), (2, [])]

    files = spark.createDataFrame([("a", bytearray(b"kiln vat"))], "path STRING, content BINARY")
    got = providers.read_words(files, {"boxes": boxes, "pdf": providers.pdf_words}).orderBy("provider", "page_number").collect()
    assert [(r["provider"], r["page_number"], [w["text"] for w in r["words"] or []]) for r in got] == [("boxes", 1, ["kiln", "vat"]), ("boxes", 2, []), ("pdf", None, [])] and got[2]["error"]


def test_stream_goes_on_from_its_last_version(spark, tmp_path):
    schema = "k INT, at INT, v STRING"
    ingest = lambda: queue.ingest_latest(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "k", "at", str(tmp_path / "out"), str(tmp_path / "state"), buckets=4, files=1)
    state = {}
    for round_ in range(3):
        for i in range(3):
            rows = [(k, round_ * 3 + i, f"v{round_}{i}{k}") for k in range(round_, round_ + 6, 2)]
            state.update({k: v for k, _, v in rows})
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert {r["k"]: r["v"] for r in ingest().collect()} == state
