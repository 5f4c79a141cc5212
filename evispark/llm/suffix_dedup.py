"""Repeated-substring removal by distributed prefix doubling.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
document. Ranking every byte of a large corpus would move it many times over, so a filter that loses nothing comes
first, and prefix doubling decides on what it leaves open:

* Anchors. Of every LENGTH-byte string, the FIRST-byte substring of smallest fingerprint (the leftmost of equals) is its
  anchor. Equal strings have equal anchors at equal places. The strings with one anchor form a segment. An anchor that
  is unique ends here with all strings of its segment. A segment that occurs before goes whole. What is left is the
  first of each of several segments with the same anchor; two of them that share a string share REACH bytes or more
  beyond the anchor to one side at least, so only segments with such a neighbour stay open.
* Prefix doubling. Every position of the open segments is a row. Its first rank is the name of its first FIRST bytes.
  Spark sorts the pairs (rank at i, rank at i + FIRST); positions of a pair that is unique drop out and the others get
  the pair's rank, of 2 * FIRST bytes. Then it sorts the pairs (rank at i, rank at i + LENGTH - 2 * FIRST), of LENGTH
  bytes, and all positions of a pair but the first start strings that also start earlier. Equal strings have equal
  anchors, so rows are dealt out by anchor once and every round sorts them where they are.

An anchor that a sample of documents holds HOT times or more would crowd a task. Its segments are dealt by their own
names in the filter, all that differ stay open, and its positions are dealt by pairs in each round of doubling.

Names are 64-bit fingerprints: polynomials over the hashes of all 8-byte words of a string in the filter, xxhash64 in
the rounds. Equal segments within a task are cut down to the first before anything is shuffled, so a passage that a
third of all documents hold is one row for each task.

Null text is the empty text; texts under LENGTH bytes keep all. A null doc_id comes before all others. Rows that repeat
a doc_id are documents of their own, in an order fixed by a hash of their texts; of wholly equal rows the first keeps
what the others lose. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, staged

LENGTH = 100
FIRST = 32
REACH = (LENGTH - FIRST) // 2
#: What the second round of doubling moves on by.
STEP = LENGTH - 2 * FIRST
#: Rows of anchors that a task holds before it cuts down equal ones and sends the rest.
HELD = 600_000
#: One document in so many tells which anchors are frequent, or more of a small table, so that there are LEAST_SAMPLED
#: about; the sample moves cost alone, never a result.
SAMPLED = 256
LEAST_SAMPLED = 4000
#: Segments of an anchor in the sample from which it is hot, and how many hot anchors are told to all tasks, at most.
HOT = 64
HOT_ANCHORS = 500_000
_NONE = -(1 << 63)  # stands for a null doc_id

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECRET = _rng.integers(1, 1 << 63, dtype=np.uint64)
_BASE = int(_rng.integers(1, 1 << 62)) * 4 + 3
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base, and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base % (1 << 64), np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


class Names:
    """Names of any substring of one text: polynomials over its bytes, or over its words of `letter` = 8 bytes."""

    def __init__(self, data: bytes | np.ndarray, letter: int = 1):
        data = np.frombuffer(data, np.uint8)
        if letter == 1:
            values = _BYTE[data]
        else:
            values = np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,)) ^ _SECRET
            values *= np.uint64(0x9E3779B97F4A7C15)
            values = self._mix(values)
        self.less = letter - 1
        up, self.down = _powers(len(values) + 1)
        values *= up[: len(values)]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.add.accumulate(values, out=self.sums[1:])

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    def all(self, length: int) -> np.ndarray:
        length -= self.less
        x = self.sums[length:] - self.sums[:-length]
        x *= self.down[: len(x)]
        return self._mix(x)

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        x = self.sums[places + (length - self.less)] - self.sums[places]
        x *= self.down[places]
        return self._mix(x)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Of every `width` neighbours."""
    have, size = x, 1
    while size * 2 <= width:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    return have if size == width else np.minimum(have[: len(x) - width + 1], have[width - size :])


def segments(data: bytes) -> tuple[np.ndarray, ...]:
    """Anchor names, segment names, first string and number of strings of each segment, short names of its neighbours."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 5
    names = Names(data, 8)
    first = names.all(FIRST)
    width = LENGTH - FIRST + 1
    least = _smallest(first, width)
    # a new segment starts where the smallest name changes, and where its place was the last string's own start
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (first[: len(least) - 1] == least[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(least)))
    anchors = least[starts]
    segment = names.at(starts, LENGTH) * np.uint64(3) ^ names.at(starts + counts - 1, LENGTH)
    segment = Names._mix(segment + counts.astype(np.uint64))
    at = np.zeros(len(starts), np.int64)  # of the anchor
    for step in range(width - 1, -1, -1):
        np.copyto(at, step, where=first[starts + step] == anchors)
    at += starts
    left = np.where(at >= REACH, names.at(np.maximum(at - REACH, 0), REACH) >> np.uint64(49) | np.uint64(1 << 15), np.uint64(0))
    fits = at + FIRST + REACH <= len(data)
    right = np.where(fits, names.at(np.where(fits, at + FIRST, 0), REACH) >> np.uint64(49) | np.uint64(1 << 15), np.uint64(0))
    near = (left.astype(np.int64) << 16 | right.astype(np.int64)).astype(np.uint32).view(np.int32)
    return anchors.view(np.int64), segment.view(np.int64), starts, counts, near


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def hot_anchors(text: DataFrame, total: int) -> np.ndarray:
    """In ascending order, the anchors with HOT segments or more in a sample of the documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"f": np.concatenate([np.empty(0, np.int64), *(segments(t.encode("utf-8", "surrogatepass"))[0] for t in batch.text)])})

    share = max(1, min(SAMPLED, total // LEAST_SAMPLED))
    part = text.where(F.pmod(F.xxhash64("k", "t"), F.lit(share)) == 0)
    counts = part.mapInPandas(count, "f bigint").groupBy("f").agg(F.count("*").alias("c")).where(F.col("c") >= HOT)
    return np.sort(counts.orderBy(F.desc("c"), "f").limit(HOT_ANCHORS).toPandas().f.to_numpy(np.int64))


#: at: the first string; n: how many follow each other; gone: known to occur before. Hot anchors stand in g, and a name of
#: anchor and segment in f.
ANCHORS = "f bigint, g bigint, s bigint, k bigint, t bigint, at int, n int, near int, gone boolean"


def _anchors(told):
    """told: a broadcast of the hot anchors."""

    def flush(held: list[dict]) -> pd.DataFrame:
        """Of equal segments the first stays; the strings of the others, put together where they join, are gone."""
        out = pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in ("f", "s", "k", "t", "at", "n", "near")})
        out = out.drop_duplicates(["k", "t", "at"], ignore_index=True)  # a row that is there twice doesn't precede itself
        hot, f, s = told.value, out.f.to_numpy(), out.s.to_numpy()
        is_hot = hot[np.minimum(np.searchsorted(hot, f), len(hot) - 1)] == f if len(hot) else np.zeros(len(f), bool)
        out["g"] = np.where(is_hot, f, 0)
        out["f"] = f = np.where(is_hot, Names._mix(f.view(np.uint64) * np.uint64(3) ^ s.view(np.uint64)).view(np.int64), f)
        order = np.lexsort((out["at"], out.t, out.k, s, f))
        f, s = f[order], s[order]
        again = np.zeros(len(out), bool)
        again[order[1:]] = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
        gone = out[again].sort_values(["k", "t", "at"])
        if len(gone):
            k, t, at, n = (gone[c].to_numpy() for c in ("k", "t", "at", "n"))
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (at[1:] != at[:-1] + n[:-1])])
            total = np.add.reduceat(n, np.flatnonzero(new))
            gone = gone[new].assign(n=total.astype(np.int32), g=0, s=0)
            gone["f"] = np.random.default_rng(len(gone)).integers(-(1 << 63), (1 << 63) - 1, len(gone))  # anywhere
        return pd.concat([out[~again].assign(gone=False), gone.assign(gone=True)], ignore_index=True)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            for k, t, text in zip(batch.k, batch.t, batch.text):
                f, s, at, n, near = segments(text.encode("utf-8", "surrogatepass"))
                if len(f):
                    held.append({"f": f, "s": s, "k": np.full(len(f), k, np.int64), "t": np.full(len(f), t, np.int64), "at": at.astype(np.int32), "n": n.astype(np.int32), "near": near})
                    rows += len(f)
            if rows > HELD:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return emit


def repeated(docs: DataFrame) -> DataFrame:
    """(f, k, t, at, n, near, gone, open, hot): strings at, at + 1, ... n of them, that also start earlier, or may."""
    spark = docs.sparkSession
    text = _keyed(docs).where(F.octet_length("text") >= LENGTH)
    anchors = text.mapInPandas(_anchors(spark.sparkContext.broadcast(hot_anchors(text, docs.count()))), ANCHORS)
    dealt = anchors.repartition(partitions(spark), "f")
    first = F.min(F.struct("k", "t", "at")).over(Window.partitionBy("f", "s"))
    by_anchor = Window.partitionBy("f")
    ranked = dealt.withColumn("first", first).withColumn("low", F.min("s").over(by_anchor)).withColumn("high", F.max("s").over(by_anchor))
    hot = F.col("g") != 0
    gone = F.col("gone") | (F.col("first") != F.struct("k", "t", "at"))
    several = hot | (F.col("low") != F.col("high"))
    kept = ranked.select(F.when(hot, F.col("g")).otherwise(F.col("f")).alias("f"), "k", "t", "at", "n", "near", gone.alias("gone"), (~gone & several).alias("open"), hot.alias("hot"))
    return staged(kept.where("gone OR open"), "segments")


def _sharing(found: DataFrame) -> DataFrame:
    """The open segments that have the bytes on one side of the anchor in common with another, and all of hot anchors."""
    left, right = F.shiftrightunsigned("near", 16), F.col("near").bitwiseAND(0xFFFF)
    rows = found.where("open AND NOT hot").select("f", "k", "t", "at", "n", left.alias("left"), right.alias("right"), "hot")
    sides = [(F.count("*").over(Window.partitionBy("f", side)) > 1) & (F.col(side) != 0) for side in ("left", "right")]
    dealt = rows.repartition(partitions(found.sparkSession), "f").withColumn("by_left", sides[0]).withColumn("by_right", sides[1])
    columns = ["f", "k", "t", "at", "n", "hot"]
    return dealt.where("by_left OR by_right").select(*columns).unionByName(found.where("open AND hot").select(*columns))


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, t, text, spans in zip(batch.k, batch.t, batch.text, batch.spans):
            data = text.encode("utf-8", "surrogatepass")
            rows += [(x["f"], k, t, x["at"], x["n"], x["hot"], data[x["at"] : x["at"] + x["n"] + LENGTH - 1]) for x in spans]
        yield pd.DataFrame(rows, columns=["f", "k", "t", "at", "n", "hot", "bytes"])


def _doubled(contents: DataFrame) -> DataFrame:
    """(k, t, at, n): strings of segments (f, k, t, at, n, bytes) that start earlier too, by rounds of prefix doubling."""
    rows = contents.select("f", "k", "t", "at", "n", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") + F.lit(STEP - 1))).alias("place"))
    name = lambda skip: F.xxhash64(F.substring("bytes", F.col("place") + F.lit(1 + skip), F.lit(FIRST)))
    rows = rows.select("f", "k", "t", (F.col("at") + F.col("place")).alias("at"), (F.col("place") < F.col("n")).alias("string"), name(0).alias("a"), name(FIRST).alias("b"))
    twice = rows.withColumn("same", F.count("*").over(Window.partitionBy("f", "a", "b"))).where("same > 1")
    ranked = twice.select("f", "k", "t", "at", "string", F.xxhash64("a", "b").alias("rank"))
    within = Window.partitionBy("f", "k", "t").orderBy("at")
    pairs = ranked.withColumn("later", F.max("rank").over(within.rangeBetween(STEP, STEP))).where("string AND later IS NOT NULL")
    here = F.struct("k", "t", "at")
    first = F.min(here).over(Window.partitionBy("f", "rank", "later"))
    again = pairs.withColumn("first", first).where(F.col("first") != here).select("f", "k", "t", "at")
    runs = again.withColumn("run", F.col("at") - F.dense_rank().over(within)).groupBy("f", "k", "t", "run").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    return runs.select("k", "t", "at", (F.col("last") - F.col("at") + 1).alias("n"))


def _shared_strings(text: DataFrame, sharing: DataFrame) -> DataFrame:
    by_document = sharing.groupBy("k", "t").agg(F.collect_list(F.struct("f", "at", "n", "hot")).alias("spans"))
    contents = text.join(by_document, ["k", "t"]).select("k", "t", "text", "spans").mapInPandas(_contents, "f bigint, k bigint, t bigint, at int, n int, hot boolean, bytes binary")
    if not sharing.where("hot").limit(1).count():
        return _doubled(contents.repartition(partitions(text.sparkSession), "f"))
    contents = staged(contents, "contents")
    dealt = contents.where("NOT hot").repartition(partitions(text.sparkSession), "f")
    return _doubled(dealt).unionByName(_doubled(contents.where("hot")))


def _spans(text: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    by_document = spans.groupBy("k", "t").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return text.join(by_document, ["k", "t"], how)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, text, nth, spans in zip(batch.k, batch.text, batch.nth, batch.spans):
            data = text.encode("utf-8", "surrogatepass")
            if nth > 1 and len(data) >= LENGTH:  # the same row as one before
                rows.append((k, len(data), len(data), 1, hashlib.sha256(b"").hexdigest()))
                continue
            if spans is None or not len(spans):
                rows.append((k, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            change = np.zeros(len(data) + 1, np.int64)
            at, n = np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans])
            np.add.at(change, at, 1)
            np.add.at(change, at + n - 1 + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((k, len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
        yield pd.DataFrame(rows, columns=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"k": "int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = repeated(docs)
    text = _keyed(docs).repartition(partitions(docs.sparkSession), "k", "t")
    open_strings = _shared_strings(text, staged(_sharing(found), "sharing"))
    spans = found.where("gone").select("k", "t", "at", "n").unionByName(open_strings)
    same = F.row_number().over(Window.partitionBy("k", "t", "text").orderBy("k"))
    whole = _spans(text, spans, "left").withColumn("nth", same)
    cut = whole.select("k", "text", "nth", "spans").mapInPandas(_cut, "k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return cut.select(F.when(F.col("k") != _NONE, F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
