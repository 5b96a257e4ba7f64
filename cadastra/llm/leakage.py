"""Evaluation texts leaking into training text (problem 7), by pigeonhole edit matching.

Texts are compared as lower-case letters and digits without anything between them, so case, wrapping, bullets
and split words do not count. A test item is cut into clauses of about ``CLAUSE_WORDS`` words. A clause that a
document takes over with at most ``k`` edits leaves at least one of ``k + 1`` disjoint pieces untouched, so an
automaton over all pieces finds every candidate exactly, and Myers' bit-parallel distance verifies the clause in
the window around the hit.

Clauses of sentences that several items share are not an item's own, nor are clauses that stand in more than
``COMMON_TEXTS`` different texts, in most of them without the rest of their item; an item that leaks widely keeps its clauses,
which stand beside each other, and ``common_clauses`` reports those that are taken out. The counts behind that are of every
matched clause of every document, whatever else of the item the document holds, and the share of an item is of the
clauses left. No threshold depends on the size of the corpus: further documents that hold no clause change nothing.
The corpus is read once by a narrow map; only matched clauses are shuffled. The test items are a stated query set: each
block of ``BLOCK`` of them is broadcast while the corpus is matched against it, one block after another, so the memory of
driver and tasks is bounded whatever their number.

Defined results: NULL and empty texts match nothing; items without own words match nothing; repeated documents
each come out under their own id; a document may leak several items; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import checkpointed, flat_map

CLAUSE_WORDS = 8
#: One edit is allowed for so many letters of a clause.
LETTERS_AN_EDIT = 14
#: Least share of an item's own words in matched clauses. The stated third is of the words taken over; rewording and
#: misreading cost some clauses around them, so a little less is asked of the clauses that match within their budget.
SHARE = 0.27
#: Length of the grams that rule out a window before its distance is computed.
GRAM = 3
#: Sentences of at least so many items, and clauses in more than COMMON_TEXTS different texts that stand beside the rest
#: of their item in less than BESIDE of these, are common property.
SHARED_ITEMS = 3
COMMON_TEXTS = 50
BESIDE = 0.5
BLOCK = 5000
#: Clauses of one sentence have numbers from its number times this on.
PARTS = 10_000
_DROP = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)


def letters(text: str) -> str:
    """Lower-case ASCII letters and digits of a text, with nothing between them."""
    return text.lower().encode("ascii", "ignore").translate(None, _DROP).decode("ascii")


def sentences(text: str) -> list[list[str]]:
    return [ws for s in re.split(r"(?<=[.?!])\s+", text or "") if (ws := [x for w in s.split() if (x := letters(w))])]


def cut(words: list[str]) -> list[tuple[str, int]]:
    """(letters, number of words) of the clauses of one sentence."""
    parts = max(1, round(len(words) / CLAUSE_WORDS))
    pieces = [words[p * len(words) // parts : (p + 1) * len(words) // parts] for p in range(parts)]
    return [("".join(piece), len(piece)) for piece in pieces]


def clauses(items: DataFrame) -> DataFrame:
    """(item_id, clause, letters, words, sentence) of the clauses of the items' own sentences."""

    def run(columns: list[list]) -> list[list]:
        found = [(item, number, "".join(words), words) for item, text in zip(*columns, strict=True) for number, words in enumerate(sentences(text))]
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], [], []]

    split = flat_map(items.where("item_id IS NOT NULL").select("item_id", "item_text"), run, "item_id BIGINT, sentence INT, whole STRING, said ARRAY<STRING>")
    shared = split.groupBy("whole").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") >= SHARED_ITEMS)
    own = split.join(shared, "whole", "left_anti")

    def parts(columns: list[list]) -> list[list]:
        found = [(item, sentence * PARTS + n, letters, words, sentence) for item, sentence, said in zip(*columns, strict=True) for n, (letters, words) in enumerate(cut(said))]
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], [], [], []]

    return flat_map(own.select("item_id", "sentence", "said"), parts, "item_id BIGINT, clause INT, letters STRING, words INT, sentence INT")


def budget(clause: str) -> int:
    return len(clause) // LETTERS_AN_EDIT


def pieces(clause: str) -> list[tuple[int, str]]:
    """Disjoint pieces of a clause with their offsets, one more than the edits it may have."""
    k = budget(clause)
    cuts = [i * len(clause) // (k + 1) for i in range(k + 2)]
    return [(a, clause[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def myers(pattern: str, text: str, k: int) -> int:
    """The least edit distance between ``pattern`` and any substring of ``text``; more than ``k`` comes back as ``k + 1``."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        if score < best:
            best = score
            if not best:
                break
    return min(best, k + 1)


class Matcher:
    """Finds the clauses of a block of items in one text after another."""

    def __init__(self, rows: list[tuple[int, int, str, int, int]]):
        import ahocorasick

        self.rows = rows
        self.own: Counter = Counter()
        self.sentences: dict[int, set[int]] = defaultdict(set)
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (item, _, clause, words, sentence) in enumerate(rows):
            self.own[item] += words
            self.sentences[item].add(sentence)
            for offset, piece in pieces(clause):
                at[piece].append((n, offset))
        self.grams = [grams(clause) for _, _, clause, _, _ in rows]
        self.machine = ahocorasick.Automaton()
        for piece, where in at.items():
            self.machine.add_word(piece, (len(piece), tuple(where)))
        if at:
            self.machine.make_automaton()

    @staticmethod
    def _taken(clause: str, own: set[str], starts: list[int], flat: str) -> bool:
        """Whether ``flat`` holds the clause within its budget at one of the places its pieces point to.

        An edit destroys at most ``GRAM`` grams, so a window that lacks more than that for each edit is ruled out.
        """
        k, end = budget(clause), -1
        for start in sorted(set(starts)):
            if start + len(clause) + k <= end:
                continue  # the last window holds this one
            end = start + len(clause) + 3 * k
            window = flat[max(0, start - k) : end]
            lacks = 0
            for gram in own:
                if gram not in window:
                    lacks += 1
                    if lacks > GRAM * k:
                        break
            else:
                if myers(clause, window, k) <= k:
                    return True
        return False

    def _hit(self, text: str | None) -> list[int]:
        """The rows of the clauses that ``text`` takes over, however little of their item that is."""
        flat = letters(text or "")
        if not flat or not len(self.machine):
            return []
        hits: dict[int, list[int]] = {}
        for end, (length, where) in self.machine.iter(flat):
            for n, offset in where:
                hits.setdefault(n, []).append(end + 1 - length - offset)
        return [n for n in sorted(hits) if self._taken(self.rows[n][2], self.grams[n], hits[n], flat)]

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, clause number, words) of the clauses that ``text`` takes over."""
        return [(item, number, words) for item, number, _, words, _ in (self.rows[n] for n in self._hit(text))]

    def placed(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """The matches, and whether each stands beside the rest of its item.

        It does if ``text`` holds the wanted share of the item, some of it in another sentence. An item of one own
        sentence has no rest to be without.
        """
        taken: Counter = Counter()
        held: dict[int, set[int]] = defaultdict(set)
        hit = [self.rows[n] for n in self._hit(text)]
        for item, _, _, words, sentence in hit:
            taken[item] += words
            held[item].add(sentence)
        return [(item, number, words, len(self.sentences[item]) == 1 or len(held[item]) > 1 and taken[item] >= SHARE * self.own[item]) for item, number, _, words, _ in hit]


def matched_clauses(documents: DataFrame, block: Broadcast) -> DataFrame:
    """(doc_id, text_hash, item_id, clause, words, beside) of every clause of a broadcast block that a document takes over."""
    made: list[Matcher] = []  # once a task

    def run(columns: list[list]) -> list[list]:
        if not made:
            made.append(Matcher(block.value))
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text_hash, text in zip(*columns, strict=True):
            for match in made[0].placed(text):
                for values, x in zip(out, (doc_id, text_hash, *match), strict=True):
                    values.append(x)
        return out

    chosen = documents.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return flat_map(chosen, run, "doc_id BIGINT, text_hash BIGINT, item_id BIGINT, clause INT, words INT, beside BOOLEAN")


def all_matches(documents: DataFrame, items: DataFrame, block_items: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(clauses of the items, matched clauses of the documents), both written: the corpus is matched here, once for each block of items."""
    context = documents.sparkSession.sparkContext
    cut_items = checkpointed(clauses(items))
    blocks = max(1, math.ceil(cut_items.select("item_id").distinct().count() / block_items))
    found = []
    for b in range(blocks):
        rows = cut_items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "clause").collect()
        block = context.broadcast([tuple(r) for r in rows])
        found.append(checkpointed(matched_clauses(documents, block)))
        block.unpersist()
    return cut_items, reduce(DataFrame.unionByName, found)


def common_of(found: DataFrame) -> DataFrame:
    """(item_id, clause, in_texts, beside_rest) of the matched clauses that are common property."""
    standing = found.select("item_id", "clause", "text_hash", "beside").distinct()
    spread = standing.groupBy("item_id", "clause").agg(F.count("*").alias("in_texts"), F.count_if("beside").alias("beside_rest"))
    return spread.where((F.col("in_texts") > COMMON_TEXTS) & (F.col("beside_rest") < F.col("in_texts") * BESIDE))


def common_clauses(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, clause, letters, in_texts, beside_rest): what ``leaks`` takes out of the items, with the reason."""
    cut_items, found = all_matches(documents, items)
    return common_of(found).join(cut_items.select("item_id", "clause", "letters"), ["item_id", "clause"]).select("item_id", "clause", "letters", "in_texts", "beside_rest")


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block_items: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, words_share) of each document that takes over enough of an item's own words."""
    cut_items, found = all_matches(documents, items, block_items)
    common = common_of(found).select("item_id", "clause")
    own = cut_items.join(common, ["item_id", "clause"], "left_anti").groupBy("item_id").agg(F.sum("words").alias("own_words"))
    taken = found.join(common, ["item_id", "clause"], "left_anti").groupBy("doc_id", "item_id").agg(F.sum("words").alias("words"))
    scored = taken.join(own, "item_id").withColumn("words_share", F.col("words") / F.col("own_words"))
    return scored.where(F.col("words_share") >= share).select("doc_id", "item_id", "words_share")
