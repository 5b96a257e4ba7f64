"""Filling fixed-capacity containers with items (problem 6), by bounded-space online best-fit.

Texts are counted in tokens of a public tokenizer by a narrow map. The counted items, a few bytes each, are dealt
to ``lanes`` by a hash of their id, and each lane packs its items as they come in the order of
their ids: a fixed number of bins is open, a bitset has a bit for every free space that an open bin has, the best
fit of an item is the lowest bit not below its size, and when a new bin is needed and all are open, the fullest
closes. A text longer than the capacity alone is cut into full containers and a rest, which is packed like
other items. Lanes never meet, so packing scales with the number of lanes, and each wastes at most its open bins. The
number of lanes is part of what is asked for: with a stated one, an item's lane never changes. Without one it is the power
of two that gives lanes of at most ``LANE_ITEMS`` on average.

The order within a lane is fixed, so a lane packed again after a lost executor gives the same containers.

Defined results: NULL and empty texts count as items of 0 tokens and take part once in a container; repeated texts are packed
each; capacities that are NULL or below 1 are left out; no documents give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cadastra.session import flat_map

#: Ranks of a public byte-level BPE vocabulary, and the pattern it was made with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_BINS = 256
LANE_ITEMS = 50_000
LANE_BITS = 32
SCHEMA = "size_name STRING, container_id BIGINT, doc_id BIGINT, part INT, start_token BIGINT, tokens BIGINT, offset_tokens BIGINT"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of the whole text of every document; the vocabulary file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    made: list = []  # once a task

    def run(columns: list[list]) -> list[list]:
        if not made:
            sent = SparkFiles.get(name)
            made.append(encoder(sent if os.path.exists(sent) else path))
        count = made[0].encode_ordinary
        return [columns[0], [len(count(text)) if text else 0 for text in columns[1]]]

    return flat_map(documents.select("doc_id", "text"), run, "doc_id BIGINT, tokens BIGINT")


class Bins:
    """Open bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.free = 0  # bit f: some open bin has f tokens free
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item of ``size`` tokens, at most the capacity."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - size
        self.at.setdefault(left, []).append(number)
        self.free |= 1 << left
        return number, self.capacity - space

    def full(self) -> int:
        """The number of a container that one piece fills, which never opens."""
        self.made += 1
        return self.made - 1

    def _take(self, space: int) -> int:
        bins = self.at[space]
        number = bins.pop()
        if not bins:
            del self.at[space]
            self.free ^= 1 << space
        return number


def lanes_for(items: int, lane_items: int = LANE_ITEMS) -> int:
    """The power of two that gives lanes of at most ``lane_items`` items on average."""
    return 1 << max(0, math.ceil(math.log2(max(1, items) / lane_items)))


def pack(items: DataFrame, sizes: DataFrame, open_bins: int = OPEN_BINS, lanes: int | None = None) -> DataFrame:
    """Every piece of every item in a container of each size; ``items`` has doc_id and tokens.

    ``sizes`` is the stated list of container sizes, one row each.
    """
    capacities = sorted((r["size_name"], r["capacity_tokens"]) for r in sizes.select("size_name", "capacity_tokens").collect() if (r["capacity_tokens"] or 0) >= 1)
    lanes = lanes or lanes_for(items.count())
    out = StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        at, bins = None, []
        for batch in batches:
            rows: list[tuple] = []
            for lane, doc_id, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if lane != at:
                    at, bins = lane, [(name, Bins(capacity, open_bins)) for name, capacity in capacities]
                base = lane << LANE_BITS
                for name, b in bins:
                    part, start, rest = 0, 0, tokens
                    while rest > b.capacity:
                        rows.append((name, base + b.full(), doc_id, part, start, b.capacity, 0))
                        part, start, rest = part + 1, start + b.capacity, rest - b.capacity
                    number, offset = b.place(rest)
                    rows.append((name, base + number, doc_id, part, start, rest, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    lane = F.pmod(F.xxhash64("doc_id"), F.lit(lanes)).alias("lane")
    dealt = items.select(lane, "doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens")).repartition("lane").sortWithinPartitions("lane", "doc_id", "tokens")
    return dealt.mapInArrow(run, out)
