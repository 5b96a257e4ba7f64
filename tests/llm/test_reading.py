"""Reading bands: held-out accuracy on the graded samples, languages, and odd texts."""

import os

import numpy as np
import pytest

from cadastra.llm import queries, reading
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def grader(spark):
    return reading.fit(spark.read.parquet(f"{DATA}/level_samples.parquet"))


def test_held_out_accuracy(grader):
    assert grader.accuracy >= 0.9 and grader.error <= 0.25
    assert grader.cuts == sorted(grader.cuts) and len(grader.cuts) == len(grader.levels) - 1


def test_trees_learn_a_step():
    x = np.array([[float(i), float(i % 3)] for i in range(200)])
    y = (x[:, 0] > 120).astype(float) * 3 + 1
    assert np.abs(reading.Trees(x, y).predict(x) - y).mean() < 0.1


def test_odd_texts(grader):
    easy = "We got the bells. The shop has ten mops and you can count them all. This is for the team and it is good. " * 5
    odd = [None, "", "   ", "12 34 -- ..", "La gerente firmó la declaración de los bienes y la envió por el correo que se le pidió. " * 9, easy, easy, easy * 3000]
    bands = [g[0] if g else None for g in grader.grade(odd)]
    assert bands[:5] == [None] * 5 and bands[5] == bands[6] and bands[5] <= 2 and bands[7] is not None


def test_query_and_empty_input(spark, grader):
    found = queries.p8_found(spark, DATA)
    assert set(found.columns) == {"doc_id", "band"} and found.count() > 10
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING, band STRING")
    assert reading.graded(empty, grader).count() == 0
    assert reading.fit(spark.createDataFrame([], "sample_id BIGINT, sample_text STRING, band INT")) is None
    assert reading.graded(spark.createDataFrame([(1, "text")], "doc_id BIGINT, text STRING"), None).count() == 0


def test_near_copies_share_a_fold_and_held_out_words_are_not_known():
    words = ["w" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)]
    texts = [" ".join(words), " ".join(words[:57] + ["x", "y", "z"]), " ".join(words[::-1]), " ".join(words)]
    groups = reading.near_copies(texts)
    assert groups[0] == groups[1] == groups[3] != groups[2]
    fold = reading.folds_of(groups, 2)
    assert fold[0] == fold[1] == fold[3]
    random = np.random.default_rng(3)  # bands that have nothing to do with the texts: what is held out must not be guessed
    noise = [" ".join(random.choice([a + b + c for a in "bcdfg" for b in "aeiou" for c in "klmnprst"], 40)) for _ in range(120)]
    bands = [int(b) for b in random.integers(1, 6, 120)]
    assert reading.Grader(noise, bands).error > 0.9
