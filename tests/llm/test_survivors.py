"""Surviving records: consensus against brute force, fields however written, and the query against its SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cadastra.llm import queries, sql, survivors
from tests.oracle import DATA, rows_of, sql_rows

QUEUE = "queue_id BIGINT, processed_at STRING, file_name STRING, tax_year STRING, account_number STRING, status STRING, at STRING"
TRUST = [("Locked", 60), ("Ready", 30), ("Error", 0)]


def found(spark, rows):
    df = spark.createDataFrame(rows, QUEUE)
    return sorted(tuple(r) for r in survivors.survivors(df, spark.createDataFrame(TRUST, "status STRING, trust INT")).collect())


def test_votes_and_alignment():
    profile = survivors.profile_of([(list("P01234567"), 3.0), (list("P0123457"), 1.0), (list("P012X4567"), 1.0)])
    assert "".join(survivors.vote(profile)) == "P01234567"
    assert survivors.vote([]) == [] and survivors.profile_of([([], 1.0)]) == []
    assert survivors.distance(list("kitten"), list("sitting")) == 3


def test_merging_partial_profiles_votes_like_all_at_once():
    random.seed(1)
    for _ in range(20):
        word = random.sample("abcdefghij", 8)
        values = []
        for _ in range(9):
            copy = list(word)
            del copy[random.randrange(len(copy))]
            values.append((copy, 1.0))
        values.append((word, 5.0))
        whole = survivors.vote(survivors.profile_of(values))
        parts = survivors.align(survivors.profile_of(values[5:]), survivors.profile_of(values[:5]))
        assert whole == word == survivors.vote(parts)


def test_consensus_emits_an_existing_value(spark):
    rows = [("g", v) for v in ["Acme Paint Supply LLC"] * 2 + ["Acme Paint Suply LLC", "Acme LLC Paint Supply", None, " "]] + [("h", "x"), ("h", "y"), ("n", None), (None, "z")]
    df = spark.createDataFrame(rows, "g STRING, v STRING")
    assert {r["g"]: r["v"] for r in survivors.consensus(df, "g", "v", survivors.words).collect()} == {"g": "Acme Paint Supply LLC", "h": "x"}
    assert survivors.consensus(df.limit(0), "g", "v", survivors.words).count() == 0


def test_choice_of_rows(spark):
    f = "rendition_P01234567_2021.pdf"
    rows = [
        (5, "2021-01-02T00:00:00", f, "2021", "P01234567", "Ready", "x"),
        (3, "01/03/2021 01:00:00 AM", "copy of " + f, "TY2021", "P0123**67", "ready.", "x"),
        (9, "pending", f.upper(), None, None, "LOCKED", "x"),
        (7, "2021-01-02T19:30:00-06:00", f, "'21", "0123 4567", None, "x"),
        (8, "20210103T013000", f, "2021.0", "#P01234567", None, "x"),
        (20, "2021-05-05", "document.pdf", "2021", "P99999999", "Ready", "x"),
        (21, None, "document.pdf", "2021", "P88888888", None, "x"),
        (22, None, "document.pdf", "2021", None, None, "x"),
        (30, None, None, None, None, None, None),
    ]
    assert found(spark, rows) == [(3, 9, 7)]  # 7 and 8 are of one time: the smaller id
    assert found(spark, []) == []


def test_exact_copies_and_a_hot_group(spark):
    rows = [(i, "2021-01-01T00:00:00", "upload_abc.pdf", "2021", "P01234567" if i % 3 else f"P0{i % 1000:03d}", "Ready", "x") for i in range(1, 4001)]
    assert found(spark, rows) == [(1, 1, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_sql(spark):
    names, expected = sql_rows(sql.P1)
    df = queries.p1_found(spark, DATA)
    assert sorted(df.columns) == names and rows_of(df) == expected
    assert queries.p1_representative(spark, DATA).where(F.col("group_id").isNull()).count() == 0


def voted(spark, rows):
    df = spark.createDataFrame(rows, "g STRING, v STRING, w DOUBLE")
    return {r["g"]: (r["v"], r["voted"]) for r in survivors.consensus(df, "g", "v", survivors.account_characters, F.col("w")).collect()}


def test_alignment_rebuilds_an_account_that_no_row_shows(spark, monkeypatch):
    """Three damaged rows of one stem find the whole account of another stem; without the alignment they don't."""
    rows = [
        (1, None, "scan_ab12.pdf", "2021", "P0123**67", "Ready", "x"),
        (2, None, "scan_ab12.pdf", "2021", "P01?34567", "Ready", "x"),
        (3, None, "scan_ab12.pdf", "2021", "P012345", "Ready", "x"),
        (4, None, "other_name_77.pdf", "2021", "P01234567", "Ready", "x"),
    ]
    assert found(spark, rows) == [(1, 1, 4)]
    assert voted(spark, [("g", r[4], 1.0) for r in rows[:3]])["g"][1] == "01234567"
    heaviest = lambda values: [{t: 1.0} for t in max(values, key=lambda v: v[1])[0]]  # noqa: E731 - the ablation: no alignment, the heaviest value stands
    assert "".join(survivors.vote(heaviest([(survivors.account_characters(r[4]), 1.0) for r in rows[:3]]))) != "01234567"


def test_contested_stems_have_no_account(spark):
    f = "scan_0042.pdf"
    rows = [(1, None, f, "2021", "P01234567", "Ready", "x"), (2, None, f, "2021", "P76543210", "Ready", "x"), (3, None, f, "2021", None, "Locked", "x"), (4, None, f, "2021", "P0123", "Locked", "x")]
    assert found(spark, rows) == []
    assert found(spark, [*rows[:1], *rows[2:]]) == [(1, 3, 1)]
    many = [(i, None, f, "2021", f"P{i:08d}", "Ready", "x") for i in range(10, 300)] + rows
    assert found(spark, many) == []  # too many whole accounts to lie around one


def test_a_group_of_many_values_votes_in_parts(spark):
    random.seed(4)
    word = [f"t{i}" for i in range(12)]
    copies = {" ".join(w for i, w in enumerate(word) if i not in gone) for gone in (set(random.sample(range(12), 2)) for _ in range(400))}
    df = spark.createDataFrame([("g", v) for v in copies] + [("h", "t1 t2"), ("h", "t1 t2"), ("h", "t1")], "g STRING, v STRING")
    all_at_once = {r["g"]: r["voted"] for r in survivors.consensus(df, "g", "v", survivors.words, most=10_000).collect()}
    in_parts = {r["g"]: (r["v"] in copies, r["voted"]) for r in survivors.consensus(df, "g", "v", survivors.words, most=4).collect()}
    assert in_parts["g"] == (True, "".join(word)) and all_at_once["g"] == "".join(word) and set(in_parts) == {"g", "h"}


def test_representatives_have_the_voted_values(spark):
    f = "rendition_P01234567_2021.pdf"
    rows = [(1, "2021-01-02T00:00:00", f, "2021", "P01234567", "Ready", "x"), (2, "2021-01-02T00:00:00", f, "2021", "P01234567", "Ready", "x"), (3, "2021-01-05T00:00:00", f, "2021", "P0123", "Locked", "x"), (4, None, f, "2021", None, None, "x"), (9, None, None, None, None, None, "x")]
    out = survivors.representatives(spark.createDataFrame(rows, QUEUE), spark.createDataFrame(TRUST, "status STRING, trust INT")).collect()
    assert [tuple(r) for r in out] == [(1, 3, "P01234567", "2021-01-05T00:00:00", "Locked", "P01234567", "2021-01-02T00:00:00", "Ready")]


def test_a_majority_needs_no_alignment():
    random.seed(7)
    for _ in range(200):
        values = [([random.choice("abc") for _ in range(random.randint(1, 7))], float(random.randint(1, 3))) for _ in range(random.randint(1, 4))]
        values.append(([random.choice("abc") for _ in range(random.randint(1, 7))], sum(w for _, w in values) + 1))
        assert survivors.voted_tokens(values) == survivors.vote(survivors.profile_of(values)) == values[-1][0]


def test_distance_equals_the_whole_table():
    random.seed(3)
    for _ in range(400):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert survivors.distance(a, b) == row[-1]
