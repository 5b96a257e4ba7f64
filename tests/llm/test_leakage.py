"""Leaked test items: distances against brute force, changed passages, and what is no leak."""

import random

import pytest

from cadastra.llm import leakage

ITEM = "In 2021 Drorjal Lejor Depot dismantled 50 waterlogged dental chairs in an empty chapel once the merger fell through. Despite a warning letter nobody at Drorjal Lejor Depot could say who misfiled the hoists. Which amount is due beside the barber stools of Drorjal Lejor Depot?"
COMMON = "Sign the form in ink and keep a copy with your own papers."
ITEMS = [(1, ITEM), (2, f"{COMMON} The auction sheet said: 22 ice bins, imported, $34,355 the lot; Lodrir Delfen Traders won them before the fair opened."), (3, COMMON + " Seven grey lathes went to the north annex."), (4, COMMON + " Nine loud pumps were kept near the old mill."), (5, None), (6, "")]
FILLER = "The county office records the storage bins along with the receipt. "


def least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_distance_equals_brute_force():
    random.seed(6)
    for _ in range(300):
        a = "".join(random.choice("abc") for _ in range(random.randint(1, 12)))
        b = "".join(random.choice("abc") for _ in range(random.randint(0, 30)))
        assert leakage.myers(a, b, 99) == least(a, b)


@pytest.fixture(scope="module")
def matcher(spark):
    rows = leakage.clauses(spark.createDataFrame(ITEMS, "item_id BIGINT, item_text STRING")).orderBy("item_id", "clause").collect()
    return leakage.Matcher([tuple(r) for r in rows])


def leaked(matcher, text):
    words = {}
    for item, _, n in matcher.matches(text):
        words[item] = words.get(item, 0) + n
    return {i for i, n in words.items() if n >= leakage.SHARE * matcher.own[i]}


def test_clauses_found_whatever_the_rest_of_the_text(matcher):
    for text in (ITEM, ITEM.upper(), ITEM.replace(" ", "\n"), FILLER * 200 + ITEM + FILLER * 200, "- " + ITEM.replace("dental", "dcntal").replace("merger", "rnerger"), ITEM.split(". ")[0] + "."):
        assert leaked(matcher, text) == {1}
    half = " ".join(ITEM.split()[:18]) + "\n2022 83,639 used\n" + " ".join(ITEM.split()[18:])
    assert leaked(matcher, half) == {1}


def test_no_leaks(matcher):
    like = "In 2019 Pape Grenla Guild insured 12 antique bread mixers in a rented barn after a burst pipe. Despite a warning letter not one clerk could say who numbered the lathes."
    for text in (None, "", FILLER * 50, COMMON * 5, like, "One sample reads: Lejor Depot dismantled 50 waterlogged dental chairs.", "Drorjal Lejor Depot called."):
        assert leaked(matcher, text) == set()


def test_operator(spark):
    docs = spark.createDataFrame([(1, FILLER + ITEM, 9), (2, FILLER + ITEM, 9), (3, FILLER, 9), (4, None, 9), (5, ITEMS[1][1], 9), (6, "", 9)], "doc_id BIGINT, text STRING, item_id INT")
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, item_text STRING")
    got = leakage.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (5, 2)]
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


ALONE = "Whoever signs below states that every figure on this page was read twice and found true."
HALF = f"{ALONE} Two amber kilns left Vostrel harbour under tarpaulin. Nobody at Quenby Yard had weighed the copper vats. The porter kept nine brass keys in a biscuit tin."


def found_in(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = leakage.leaks(docs, spark.createDataFrame(items, "item_id BIGINT, item_text STRING")).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in got)


def test_widely_leaked_item_stays_and_a_sentence_standing_alone_does_not_count(spark):
    leaking, alone = [f"{n}. {FILLER} {ITEM}" for n in range(60)], [f"{n}. {FILLER} {ALONE}" for n in range(60)]
    assert found_in(spark, leaking, [(1, ITEM)]) == [(n, 1) for n in range(60)]
    assert found_in(spark, leaking + alone, [(1, ITEM), (7, HALF)]) == [(n, 1) for n in range(60)]
    assert found_in(spark, [f"{n}. {ALONE}" for n in range(60)], [(8, ALONE)]) == [(n, 8) for n in range(60)]


def test_share_is_of_the_words_left_without_common_clauses(spark):
    alone = [f"{n}. {FILLER} {ALONE}" for n in range(60)]
    passage = "Two amber kilns left Vostrel harbour under tarpaulin."
    words = len(passage.split())
    left = len(HALF.split()) - len(ALONE.split())
    assert words < leakage.SHARE * len(HALF.split()) and words >= leakage.SHARE * left
    assert found_in(spark, [*alone, FILLER + passage], [(7, HALF)]) == [(60, 7)]


def test_unrelated_documents_and_blocks_of_items_change_nothing(spark):
    texts = [f"{n}. {FILLER} {ALONE}" for n in range(60)] + [FILLER + ITEM, FILLER + HALF, FILLER + ITEMS[1][1]]
    items = [*ITEMS[:4], (7, HALF)]
    before = found_in(spark, texts, items)
    assert before == [(60, 1), (61, 7), (62, 2)]
    assert found_in(spark, texts + [f"{FILLER} {n}" for n in range(3000)], items) == before
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    frame = spark.createDataFrame(items, "item_id BIGINT, item_text STRING")
    assert sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, frame, block_items=2).collect()) == before
    taken_out = leakage.common_clauses(docs, frame).collect()
    assert {r["item_id"] for r in taken_out} == {7} and all(r["letters"] in leakage.letters(ALONE) and r["in_texts"] == 61 for r in taken_out)


def test_ruling_out_loses_no_match():
    """Clauses with random edits in random texts: every one within its budget is taken, and no other."""
    rng = random.Random(17)
    letters_ = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    rows = [(i, 0, letters_(rng.randint(16, 60)), 8, 0) for i in range(60)]
    matcher = leakage.Matcher(rows)
    for n, (_, _, clause, _, _) in enumerate(rows):
        for _ in range(12):
            copy = clause
            for _ in range(rng.randint(0, leakage.budget(clause) + 1)):
                at = rng.randrange(len(copy))
                copy = rng.choice([copy[:at] + copy[at + 1 :], copy[:at] + "z" + copy[at:], copy[:at] + "z" + copy[at + 1 :]])
            text = letters_(rng.randint(0, 40)) + copy + letters_(rng.randint(0, 40))
            assert (n in matcher._hit(text)) == (leakage.myers(clause, text, 99) <= leakage.budget(clause)), (clause, text)
