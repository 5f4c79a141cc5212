"""Best-fit packing of documents into sequences of fixed token length, by exact-complement hashing.

The plan is made from the counts of each length alone, at most one row for each token of the capacity, so it takes the
same driver memory at any scale: the longest length first, sums of one, two and three available lengths are looked up
that fill its gap exactly, and as many sequences as the counts allow are made at once; what is left goes best-fit, in
descending order, again for whole counts. Pieces then find their slot by their rank among pieces of equal length, which
is a rank within a block plus the block's base: no length, however common, meets in one task.

Null text is the empty text, of the end id alone. Rows that repeat a doc_id, or have none, are documents of their own.
An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, staged
from .tokens import default_path, encoder

CAPACITY = 4096
#: Pieces in a block, about: what ranks are counted within.
BLOCK_PIECES = 50_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; only documents of over `capacity` ids are cut."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                ids = np.append(coder.encode(text), np.uint32(end_id))
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    rows.append((doc_id, k, a, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return documents(docs, "doc_id", "text").mapInPandas(cut, PIECES)


class _Complements:
    """Which sums of one, two and three available lengths there are. Counts only fall, so sums are indexed once, checked
    at use, and forgotten when none is left. A length that is in use already is lent: its count is one less meanwhile."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.lent = counts, []
        have, n = np.flatnonzero(counts), len(counts)
        self.pairs, self.triples = np.zeros(n, bool), np.zeros(n, bool)
        for a in have:
            sums = a + have
            self.pairs[sums[sums < n]] = True
        for a in have:
            self.triples[a:] |= self.pairs[: n - a]

    def _lend(self, length: int, how_many: int) -> None:
        self.counts[length] -= how_many
        self.lent = [*self.lent, length] if how_many > 0 else self.lent[:-1]

    def _lent_pair(self, gap: int) -> bool:
        """Whether a pair is only missing because of what is lent."""
        back = lambda x: int(self.counts[x]) + self.lent.count(x)
        return any(0 < gap - x and back(gap - x) > (gap == 2 * x) for x in self.lent)

    def pair(self, gap: int) -> tuple[int, ...] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = a[(self.counts[a] > 0) & (self.counts[gap - a] > 0) & ((2 * a != gap) | (self.counts[a] > 1))]
        if not len(ok):
            self.pairs[gap] = self._lent_pair(gap)
            return None
        return int(ok[0]), gap - int(ok[0])

    def fill(self, length: int) -> tuple[int, ...] | None:
        """The fewest lengths that fill the gap beside one of `length`."""
        gap = len(self.counts) - 1 - length
        if gap == 0:
            return ()
        self._lend(length, 1)
        found: tuple[int, ...] | None = (gap,) if self.counts[gap] > 0 else self.pair(gap)
        if found is None and self.triples[gap]:
            firsts = np.flatnonzero(self.counts[: gap - 1])[::-1]
            for a in firsts[self.pairs[gap - firsts]].tolist():
                self._lend(a, 1)
                rest = self.pair(gap - a)
                self._lend(a, -1)
                if rest:
                    found = (a, *rest)
                    break
            else:
                self.triples[gap] = self.counts[length] < 3  # enough are left: it isn't the lent one that is missing
        self._lend(length, -1)
        return found


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Contents, as (length, how many), and how many sequences have them."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    index, rest = _Complements(left), []
    for length in range(capacity, 0, -1):
        while left[length]:
            found = index.fill(length)
            if found is None:
                rest.append((length, int(left[length])))
                left[length] = 0
                break
            need = Counter((length, *found))
            times = min(int(left[x]) // k for x, k in need.items())
            plan.append((tuple(sorted(need.items(), reverse=True)), times))
            for x, k in need.items():
                left[x] -= k * times
    # best fit: open sequences are kept by their gap
    gaps: list[int] = []
    open_by: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(contents: tuple[tuple[int, int], ...], n: int) -> None:
        gap = capacity - sum(x * k for x, k in contents)
        if gap not in open_by:
            bisect.insort(gaps, gap)
            open_by[gap] = []
        open_by[gap].append((contents, n))

    for length, n in rest:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if full := n // each:
                    put(((length, each),), full)
                if n % each:
                    put(((length, n % each),), 1)
                break
            gap = gaps[at]
            contents, have = open_by[gap].pop()
            if not open_by[gap]:
                gaps.pop(at)
                del open_by[gap]
            used = min(n, have)
            if have > used:
                put(contents, have - used)
            last = contents[-1]
            put((*contents[:-1], (length, last[1] + 1)) if last[0] == length else (*contents, (length, 1)), used)
            n -= used
    return plan + [x for group in open_by.values() for x in group]


def _segments(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """For each length, by rank: first rank, first sequence, how many in a sequence, offset there."""
    rank: Counter = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for contents, times in plan:
        offset = 0
        for length, k in contents:
            out.setdefault(length, []).append((rank[length], sequence, k, offset))
            rank[length] += k * times
            offset += length * k
        sequence += times
    return {length: np.array(rows, np.int64).T for length, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; `pieces` is read several times, so it should be staged."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = _segments(plan_sequences(counts, capacity))
    blocks = sum(counts.values()) // BLOCK_PIECES + 1
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    within = blocked.withColumn("nth", F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "ids_crc32")))
    sums = blocked.groupBy("block", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = within.join(base, ["block", "length"]).withColumn("rank", F.col("base") + F.col("nth") - 1)
    columns = pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, at in batch.groupby("length").indices.items():
                first, sequences, each, offsets = slots[length]
                rank = batch["rank"].to_numpy()[at]
                k = np.searchsorted(first, rank, "right") - 1
                nth = rank - first[k]
                sequence[at] = sequences[k] + nth // each[k]
                offset[at] = offsets[k] + nth % each[k] * length
            yield batch[columns].assign(sequence_id=sequence, offset=offset).astype({"doc_id": "Int64"})

    return ranked.select(*columns, "rank").mapInPandas(place, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(cut_documents(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("word_bpe_49k.json"))
