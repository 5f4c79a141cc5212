"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Seeds are the SEED-word sequences of the test items. One pass over the corpus finds every place where one occurs and
stages, for each document and item, the passage around its hits, with the seeds that it holds. Their document
frequencies over the whole corpus say which are rare: in RARE_SHARE of all documents at most, or in RARE_DOCUMENTS. A
passage that holds one rare seed, or several of any kind, or one common seed and as many of the item's words as a match
needs, so that an item that leaked into a third of all documents is still found, is aligned to its item, word by word,
unless their longest common subsequence is too short for any alignment to count; a document is contaminated by an item if the best alignment matches LEAST_WORDS words, or the share LEAST_SHARE of a
shorter item, at an identity of LEAST_IDENTITY or more.

Test items come to the executors in blocks of BLOCK_WORDS words at most, whatever their number; each block is a pass.
Words are runs of letters and digits, lower-cased. Items and documents that are null, empty or of fewer than SEED words
match nothing. Documents are told apart by doc_id, null among them; repeated rows count once in the result. Passages of
very long texts are cut, with overlap, at four lengths of the item, so each is aligned whole in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release, small_batches, staged

SEED = 3
RARE_SHARE = 0.001
RARE_DOCUMENTS = 20
LEAST_WORDS = 8
LEAST_SHARE = 0.6
LEAST_IDENTITY = 0.7
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000

_WORDS = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


class Items:
    """A block of test items, and where their seeds lie."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in rows) if len(w) >= SEED]
        self.ids = [i for i, _ in kept]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
        self.coded = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in kept]
        self.base = len(self.vocabulary) + 1
        codes = [self._seeds(c) for c in self.coded]
        self.seeds = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        self.postings: list[list[tuple[int, int]]] = [[] for _ in self.seeds]
        for item, c in enumerate(codes):
            for place, seed in enumerate(np.searchsorted(self.seeds, c)):
                self.postings[seed].append((item, place))

    def _seeds(self, coded: np.ndarray) -> np.ndarray:
        out = coded[: len(coded) - SEED + 1].copy()
        for k in range(1, SEED):
            out = out * self.base + coded[k : len(coded) - SEED + 1 + k]
        return out

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a coded document, and the seeds there. Words outside the vocabulary are 0."""
        n = len(coded) - SEED + 1
        if n < 1 or not len(self.seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = coded > 0
        at = known[:n].copy()
        for k in range(1, SEED):
            at &= known[k : n + k]
        at = np.flatnonzero(at)
        code = coded[at]
        for k in range(1, SEED):
            code = code * self.base + coded[at + k]
        seed = np.minimum(np.searchsorted(self.seeds, code), len(self.seeds) - 1)
        ok = self.seeds[seed] == code
        return at[ok], seed[ok]

    def passages(self, text: str | None) -> list[tuple[int, list[int], np.ndarray]]:
        """(item, seeds held, coded passage) of every cluster of hits."""
        coded = np.fromiter(map(self.vocabulary.get, words(text), repeat(0)), np.int64)
        by_item: dict[int, list[tuple[int, int]]] = {}
        for at, seed in zip(*(x.tolist() for x in self.hits(coded))):
            for item, place in self.postings[seed]:
                by_item.setdefault(item, []).append((at - place, seed))
        out = []
        for item, found in by_item.items():
            size = len(self.coded[item])
            margin = 8 + size // 4
            begin = end = None
            seeds: set[int] = set()
            for start, seed in sorted(found):
                a, b = max(0, start - margin), start + size + margin
                if begin is not None and (a > end or b - begin > 4 * size + 4 * margin):
                    out.append((item, sorted(seeds), coded[begin:end]))
                    begin, seeds = None, set()
                begin = a if begin is None else begin
                end = b
                seeds.add(seed)
            out.append((item, sorted(seeds), coded[begin:end]))
        return out

    def rare(self, frequency: dict[int, int], documents: int) -> np.ndarray:
        """Whether each seed is rare among so many documents."""
        limit = max(RARE_DOCUMENTS, RARE_SHARE * documents)
        return np.array([frequency.get(k, 0) <= limit for k in range(len(self.seeds))], bool)


def least_words(size: int) -> int:
    return min(LEAST_WORDS, max(SEED, int(np.ceil(LEAST_SHARE * size))))


def longest_common(item: list[int], passage: list[int]) -> int:
    """Words of the longest common subsequence, by whole rows of bits: no alignment matches more words."""
    places: dict[int, int] = {}
    bit, own = 1, set(item)
    passage = [w for w in passage if w in own]
    for w in passage:
        places[w] = places.get(w, 0) | bit
        bit <<= 1
    whole = row = bit - 1
    for w in item:
        at = places.get(w)
        if at is not None:
            met = row & at
            row = ((row + met) | (row - met)) & whole
    return len(passage) - row.bit_count()


def worth_aligning(seeds: list[int] | np.ndarray, rare: np.ndarray, item: np.ndarray, passage: np.ndarray) -> bool:
    """False only where too few words are in both, in the same order, for any alignment to contaminate. Of passages of one
    common seed most are told by their words alone."""
    if len(seeds) == 1 and not rare[seeds[0]] and min(np.isin(item, passage).sum(), np.isin(passage, item).sum()) < least_words(len(item)):
        return False
    return longest_common(item.tolist(), passage.tolist()) >= least_words(len(item))


def align(item: np.ndarray, passage: np.ndarray, least: float = 0) -> tuple[int, int, int]:
    """Smith-Waterman: score, words matched and columns of the best local alignment; below a least score only that."""
    n, m = len(item), len(passage)
    steps = np.arange(m + 1, dtype=np.int32)
    # a score less GAP times its place: then gaps along the row, of any length, are its running maximum
    raised = np.empty((n + 1, m + 1), np.int32)
    raised[0], raised[:, 0] = -GAP * steps, 0
    floor = raised[0, 1:]
    gain = np.where(item[:, None] == passage, MATCH - GAP, MISMATCH - GAP).astype(np.int32)
    best, down = np.empty(m, np.int32), np.empty(m, np.int32)
    for i in range(1, n + 1):
        np.add(raised[i - 1, :-1], gain[i - 1], out=best)
        np.add(raised[i - 1, 1:], GAP, out=down)
        np.maximum(best, down, out=best)
        np.maximum(best, floor, out=best)
        np.maximum.accumulate(best, out=raised[i, 1:])
    score = raised + GAP * steps
    if score.max() < least:
        return int(score.max()), 0, 0
    i, j = np.unravel_index(score.argmax(), score.shape)
    top, matched, columns = int(score[i, j]), 0, 0
    while i and j and score[i, j] > 0:
        columns += 1
        same = item[i - 1] == passage[j - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return top, matched, columns


def contaminates(size: int, matched: int, columns: int) -> bool:
    return matched >= least_words(size) and matched >= LEAST_IDENTITY * columns


def least_score(size: int) -> float:
    """What an alignment that contaminates scores at least: columns that don't match cost 1 each."""
    return least_words(size) * (MATCH + 1 - 1 / LEAST_IDENTITY) - 1e-6


def blocks(items: DataFrame, id_column: str = "item_id") -> Iterator[Items]:
    """Test items, in blocks of bounded size."""
    rows = items.select(F.col(f"`{id_column}`").alias("id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    n = total // BLOCK_WORDS + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Items(sorted(((r.id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1] or "")))


def _passages(docs: DataFrame, items: Items) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_WORDS words at most

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, item, seeds, p.astype("<i4").tobytes()) for d, t in zip(batch.doc_id, batch.text) for item, seeds, p in told.value.passages(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item", "seeds", "passage"]).astype({"doc_id": "Int64", "item": "int32"})

    return documents(docs, "doc_id", "text").mapInPandas(find, "doc_id bigint, item int, seeds array<int>, passage binary")


def _rare(passages: DataFrame, items: Items, n_documents: int) -> np.ndarray:
    """From document frequencies over all documents; a row for each seed of the block at most."""
    once = passages.select("doc_id", F.explode("seeds").alias("seed")).distinct()
    return items.rare({r.seed: r["count"] for r in once.groupBy("seed").count().collect()}, n_documents)


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (of the item's own), matched words, aligned columns: one row for each contaminated pair."""
    out = None
    for items in blocks(benchmark):
        found = staged(_passages(docs, items), "passages")
        told = docs.sparkSession.sparkContext.broadcast((items, _rare(found, items, docs.count())))

        def score(batches: Iterator[pd.DataFrame], told: Broadcast = told) -> Iterator[pd.DataFrame]:
            items, rare = told.value
            for batch in batches:
                rows = []
                for d, item, seeds, passage in zip(batch.doc_id, batch["item"], batch.seeds, batch.passage):
                    own, passage = items.coded[item], np.frombuffer(passage, "<i4")
                    if worth_aligning(seeds, rare, own, passage):
                        top, matched, columns = align(own, passage, least_score(len(own)))
                        if contaminates(len(own), matched, columns):
                            rows.append((d, items.ids[item], top / (MATCH * len(own)), matched, columns))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "matched", "columns"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        pairs = found.mapInPandas(score, "doc_id bigint, item_id bigint, score double, matched int, columns int")
        out = pairs if out is None else out.unionByName(pairs)
    best = F.max(F.struct("score", "matched", "columns")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.matched", "best.columns")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the contaminated rows. Texts stay where they are: no join, no shuffle."""
    small_batches(docs.sparkSession)
    for items in blocks(benchmark):
        found = staged(_passages(docs, items).select("doc_id", "seeds"), "seeds")
        told = docs.sparkSession.sparkContext.broadcast((items, _rare(found, items, docs.count())))
        release(found)

        def keep(batches: Iterator[pa.RecordBatch], told: Broadcast = told) -> Iterator[pa.RecordBatch]:
            items, rare = told.value
            for batch in batches:
                clean = []
                for text in batch.column("text").to_pylist():
                    bad = False
                    for item, seeds, passage in items.passages(text):
                        own = items.coded[item]
                        if worth_aligning(seeds, rare, own, passage):
                            bad = contaminates(len(own), *align(own, passage, least_score(len(own)))[1:])
                            if bad:
                                break
                    clean.append(not bad)
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_contaminated(docs, benchmark)
