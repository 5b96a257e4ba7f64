"""Containers: nothing lost or split needlessly, best fit against a plain search, the tokenizer's counts."""

import os
import random
from collections import defaultdict

import pytest

from cadastra.llm import packing


def test_best_fit_equals_a_plain_search():
    random.seed(4)
    bins, plain, made = packing.Bins(100, 5), {}, 0
    for _ in range(3000):
        size = random.choice([0, 1, 7, 33, 50, 99, 100, random.randint(1, 100)])
        number, offset = bins.place(size)
        fitting = [f for f in plain.values() if f >= size]
        if fitting:
            assert plain[number] == min(fitting) and offset == 100 - plain[number]
        else:
            if len(plain) == 5:
                fullest = min(plain.values())
                closed = [n for n, f in plain.items() if f == fullest and n not in {x for v in bins.at.values() for x in v}]
                del plain[closed[0]]
            assert number == made and offset == 0
            plain[number], made = 100, made + 1
        plain[number] -= size


def check(spark, rows, lanes):
    items = spark.createDataFrame(rows, "doc_id BIGINT, tokens BIGINT, size_name STRING")
    sizes = spark.createDataFrame([("s", 10), ("m", 64), ("none", None), ("zero", 0)], "size_name STRING, capacity_tokens INT")
    packed = packing.pack(items, sizes, open_bins=4, lanes=lanes).collect()
    for name, capacity in (("s", 10), ("m", 64)):
        own = [r for r in packed if r["size_name"] == name]
        fill, parts = defaultdict(int), defaultdict(list)
        for r in own:
            assert r["offset_tokens"] + r["tokens"] <= capacity
            fill[r["container_id"]] += r["tokens"]
            parts[r["doc_id"]].append(r)
        assert max(fill.values(), default=0) <= capacity
        for doc, tokens, _ in rows:
            pieces = sorted(parts[doc], key=lambda r: r["part"])
            assert sum(p["tokens"] for p in pieces) == (tokens or 0)
            assert len(pieces) == max(1, -(-(tokens or 0) // capacity))
            assert [p["start_token"] for p in pieces] == [i * capacity for i in range(len(pieces))]
    return packed


def test_whole_and_repeatable(spark):
    random.seed(5)
    rows = [(i, random.choice([0, None, 3, 10, 11, 64, 65, 1000, random.randint(1, 60)]), "x") for i in range(500)]
    for lanes in (None, 4):
        assert sorted(map(tuple, check(spark, rows, lanes))) == sorted(map(tuple, check(spark, rows, lanes)))
    assert check(spark, [], 10) == []


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_counts_of_whole_texts(spark):
    texts = ["hello world", "", None, "año 50% " * 2000, "hello world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    encode = packing.encoder(packing.TOKENIZER).encode_ordinary
    assert {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()} == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
