"""Reading level of each document (problem 8), by gradient-boosted regression trees.

A document becomes a row of numbers: distributions of word length and syllables, vocabulary (the bands in which
its words occur in the samples), syntax (sentence length, clause markers, punctuation) and cohesion (connectives,
repetition). Squared-error trees are boosted on the graded samples; predictions for samples that a model has not
seen (k-fold) give the cut points that turn a prediction into a band, and the error that is reported. Nothing of a
held-out sample reaches the model that grades it: the vocabulary is made inside each fold, from its training samples,
whose own words are graded by the other training samples; near copies (five-word shingles, similarity 0.8) are in one fold.

The model is fitted on the driver on at most ``MAX_SAMPLES`` graded samples (the only bounded input; all
documents are scored), and sent to the tasks as a few kilobytes. Scoring is one narrow map over all documents in
whole texts, with no shuffle.

Defined results: NULL, empty and wordless texts, and texts that are not English, have no band; repeated texts
have the same band; one very long text is scored as a whole; with no graded samples nothing is scored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import flat_map

MAX_SAMPLES = 20_000
TREES, DEPTH, RATE, BINS, LEAST, FOLDS = 160, 3, 0.08, 24, 4, 5
SEED = 7

# Fixed lists of function words of the two languages in use, and of connectives.
ENGLISH = frozenset("the of and to in is for that are with was by on be it as at or an this not from which has have you your if when were does do a its we my".split())
SPANISH = frozenset("el la los las de que y en un una por con para se del al es su no lo como más o pero sus le ha este".split())
CONNECTIVES = frozenset("although because unless when if whenever whereas notwithstanding insofar inasmuch consequently nevertheless whether neither either moreover therefore however thereby whose which".split())

_WORD_TABLE = {i: " " for i in range(0x20, 0x7F) if not chr(i).isalpha() and chr(i) not in "'-"}
_VOWELS = re.compile(r"[aeiouy]+")


def words_of(text: str) -> list[str]:
    return text.lower().translate(_WORD_TABLE).split()


class Vocabulary(dict):
    """Row numbers of words in ``rows``, a table of word traits that grows with the words met.

    The band of a word is the mean band of the graded samples that use it, drawn to the mean of all by ``WEIGHT``
    samples.
    """

    WEIGHT = 1.0
    MOST = 400_000
    #: letters, syllables, long, five length classes, known, band, five band classes, connective, the, of, and, you, English, Spanish
    WIDTH = 22

    def __init__(self, texts: list[str], bands: list[int]):
        super().__init__()
        mean = float(np.mean(bands)) if bands else 0.0
        sums: Counter = Counter()
        seen: Counter = Counter()
        for text, band in zip(texts, bands, strict=True):
            for word in set(words_of(text)):
                sums[word] += band
                seen[word] += 1
        self.band = {w: (sums[w] + self.WEIGHT * mean) / (n + self.WEIGHT) for w, n in seen.items()}
        self.rows = np.zeros((1024, self.WIDTH), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        syllables = max(1, len(_VOWELS.findall(word)) - (word.endswith("e") and not word.endswith("le")))
        row = self.rows[at]
        row[:] = 0
        row[0], row[1], row[2] = len(word), syllables, syllables >= 4
        row[3 + min((len(word) - 1) // 3, 4)] = 1
        band = self.band.get(word)
        if band is not None:
            row[8], row[9] = 1, band
            row[10 + min(4, max(0, int(band - 0.5)))] = 1
        row[15] = word in CONNECTIVES
        for i, common in enumerate(("the", "of", "and", "you")):
            row[16 + i] = word == common
        row[20], row[21] = word in ENGLISH, word in SPANISH
        self[word] = at
        return at

    def sums(self, words: list[str]) -> np.ndarray:
        """Sums of the traits of ``words``."""
        if len(self) > self.MOST:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
        return self.rows[at].sum(axis=0, dtype=np.float64)


def features(text: str, vocabulary: Vocabulary) -> tuple[list[float], bool] | None:
    """(features, English or not) of a text, None without words; English is told by its function words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return None
    t = vocabulary.sums(words)
    english = bool(t[20] > t[21] and t[20] > 0.04 * n)
    parts = text.replace("? ", ". ").replace("! ", ". ").replace("\n", ". ").split(". ")
    spans = np.array([c for s in parts if (c := s.count(" ") + 1) > 2] or [n], dtype=float)
    k = max(t[8], 1.0)
    row = [*(t[:9] / n), *(t[9:15] / k), float(spans.mean()), float(np.median(spans)), float(spans.std()), float(spans.max())]
    row += [t[15] / len(spans), text.count(",") / len(spans), text.count(";") / len(spans), text.count("?") / len(spans)]
    row += [len(set(words)) / n**0.7, *(t[16:20] / n)]
    return row, english


class Trees:
    """Gradient-boosted regression trees on binned features, for squared error."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
        self.base = float(y.mean())
        binned = self._bin(x)
        fitted = np.full(len(y), self.base)
        self.trees = []
        for _ in range(TREES):
            tree: list[tuple] = []
            step = np.zeros(len(y))
            self._grow(binned, y - fitted, np.arange(len(y)), 0, tree, step)
            self.trees.append(tree)
            fitted += RATE * step

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def _grow(self, b: np.ndarray, r: np.ndarray, rows: np.ndarray, depth: int, tree: list, step: np.ndarray) -> int:
        at = len(tree)
        tree.append(())
        value, best = float(r[rows].mean()), None
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            width = BINS + 1
            flat = (b[rows] + np.arange(b.shape[1]) * width).ravel()
            size = b.shape[1] * width
            n = np.bincount(flat, minlength=size).reshape(-1, width).cumsum(1)[:, :-1]
            s = np.bincount(flat, weights=np.repeat(r[rows], b.shape[1]), minlength=size).reshape(-1, width).cumsum(1)[:, :-1]
            m, total = len(rows), r[rows].sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((n >= LEAST) & (m - n >= LEAST), s**2 / n + (total - s) ** 2 / (m - n) - total**2 / m, -1.0)
            top = int(gain.argmax())
            if gain.flat[top] > 1e-9:
                best = divmod(top, width - 1)
        if best is None:
            tree[at] = (-1, 0, 0, 0, value)
            step[rows] = value
            return at
        f, cut = best
        left = b[rows, f] <= cut
        lo = self._grow(b, r, rows[left], depth + 1, tree, step)
        hi = self._grow(b, r, rows[~left], depth + 1, tree, step)
        tree[at] = (f, cut, lo, hi, value)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            f, cut, lo, hi, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(DEPTH):
                inner = f[at] >= 0
                go = b[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, lo[at], hi[at]), at)
            out += RATE * value[at]
        return out


def near_copies(texts: list[str], least: float = 0.8, width: int = 5) -> list[int]:
    """A number for each text, the same for near copies: texts whose sets of word shingles are as similar as ``least``."""
    shingles = [{tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} for ws in map(words_of, texts)]
    holders: dict[tuple, list[int]] = {}
    for n, own in enumerate(shingles):
        for s in own:
            holders.setdefault(s, []).append(n)
    group = list(range(len(texts)))

    def root(n: int) -> int:
        while group[n] != n:
            group[n] = n = group[group[n]]
        return n

    for n, own in enumerate(shingles):
        shared = Counter(m for s in own for m in holders[s] if m < n)
        for m, k in shared.items():
            if k >= least * (len(own) + len(shingles[m]) - k):
                group[root(n)] = root(m)
    return [root(n) for n in range(len(texts))]


def folds_of(groups: list[int], folds: int = FOLDS) -> np.ndarray:
    """The fold of each sample, whole groups at random in turn."""
    names = sorted(set(groups))
    at = {names[g]: k % folds for k, g in enumerate(np.random.default_rng(SEED).permutation(len(names)))}
    return np.array([at[g] for g in groups])


class Grader:
    """Vocabulary, trees and cut points fitted on graded samples."""

    def __init__(self, texts: list[str], bands: list[int]):
        y = np.array(bands, dtype=float)
        groups = near_copies(texts)
        fold = folds_of(groups)
        self.unseen = np.full(len(y), y.mean())
        for k in range(FOLDS):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if not len(train) or not len(test):
                continue
            said, graded = [texts[i] for i in train], [bands[i] for i in train]
            x, usable = self._rows(said, graded, [groups[i] for i in train])
            if not usable.any():
                continue
            trees, seen = Trees(x[usable], y[train][usable]), Vocabulary(said, graded)
            for i in test:
                found = features(texts[i], seen)
                if found:
                    self.unseen[i] = trees.predict(np.array([found[0]]))[0]
        x, usable = self._rows(texts, bands, groups)
        self.vocabulary = Vocabulary(texts, bands)
        self.trees = Trees(x[usable], y[usable])
        levels = sorted(set(bands))
        self.levels = levels
        self.cuts = [self._cut(y, self.unseen, a, b) for a, b in zip(levels, levels[1:], strict=False)]
        graded = np.array(levels)[np.searchsorted(self.cuts, self.unseen)] if len(levels) > 1 else y
        self.accuracy = float((graded == y).mean())
        self.error = float(np.abs(self.unseen - y).mean())

    @staticmethod
    def _rows(texts: list[str], bands: list[int], groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Features of training samples, the words of each graded by the samples of other folds; and which have any."""
        fold = folds_of(groups)
        rows: list[list[float]] = [[]] * len(texts)
        for k in range(FOLDS):
            seen = Vocabulary([t for t, f in zip(texts, fold, strict=True) if f != k], [b for b, f in zip(bands, fold, strict=True) if f != k])
            for i in np.flatnonzero(fold == k):
                found = features(texts[i], seen)
                rows[i] = found[0] if found else []
        width = max(map(len, rows))
        return np.array([r if len(r) == width else [0.0] * width for r in rows]), np.array([len(r) == width > 0 for r in rows])

    @staticmethod
    def _cut(y: np.ndarray, p: np.ndarray, a: int, b: int) -> float:
        """The cut nearest the middle of two neighbouring bands, of those with at most one more unseen sample on the
        wrong side than the best."""
        near = p[(y == a) | (y == b)]
        grid = np.unique(np.concatenate([[(a + b) / 2], (np.sort(near)[1:] + np.sort(near)[:-1]) / 2]))
        wrong = [((p[y == a] > c).sum() + (p[y == b] <= c).sum(), abs(c - (a + b) / 2), c) for c in grid]
        least = min(wrong)[0]
        return float(min(w[1:] for w in wrong if w[0] <= least + 1)[1])

    def grade(self, texts: list[str | None]) -> list[tuple[int, float] | None]:
        """(band, prediction) of each English text, else None."""
        rows, where = [], []
        for i, text in enumerate(texts):
            found = features(text, self.vocabulary) if text else None
            if found and found[1]:
                rows.append(found[0])
                where.append(i)
        out: list[tuple[int, float] | None] = [None] * len(texts)
        if rows:
            p = self.trees.predict(np.array(rows))
            for i, value, level in zip(where, p, np.searchsorted(self.cuts, p), strict=True):
                out[i] = (int(self.levels[level]), float(value))
        return out


def fit(samples: DataFrame) -> Grader | None:
    """The grader fitted on the graded samples, the first MAX_SAMPLES by sample_id."""
    rows = samples.where(F.length("sample_text") > 0).where(F.col("band").isNotNull()).orderBy("sample_id").limit(MAX_SAMPLES).select("sample_text", "band").collect()
    return Grader([r["sample_text"] for r in rows], [r["band"] for r in rows]) if rows else None


def graded(documents: DataFrame, grader: Grader | None) -> DataFrame:
    """(doc_id, band, prediction) of the English ``documents``; the fitted grader is broadcast."""
    sent = documents.sparkSession.sparkContext.broadcast(grader)

    def run(columns: list[list]) -> list[list]:
        ids, texts = columns
        found = [(i, *g) for i, g in zip(ids, sent.value.grade(texts), strict=True) if g] if sent.value else []
        return [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]

    return flat_map(documents.select("doc_id", "text"), run, "doc_id BIGINT, band INT, prediction DOUBLE")
