"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of the first letters of the longer ones, each hashed to one of BUCKETS
terms. A term takes part if it goes with a class in the sample, by a chi-squared test, or if it is one of a pair that is
toxic together far more often than either term is: an insult and the mention of a group may be harmless one by one. The
score is the logistic function of a bias, a weight for each term and the inner products of the term vectors of all
pairs, so that a pair of terms can mean more than both alone. The model is fitted with numpy in one task, on the hashed
terms of SAMPLE labelled rows at most, chosen by a hash of doc_id, and only the terms that take part come to the driver;
every document is scored, over its whole text, from the model alone.

Null and empty texts, and texts without a word, have no terms and get the score of the bias. Rows without doc_id count
as crc32 of the empty text and are never learned from. Without labelled rows the score is 0.5 less a little, and with
labels of one class a constant. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, documents, small_batches

BUCKETS = 1 << 18
FACTORS = 8
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_000
EPOCHS = 12
#: Terms in fewer sampled texts, or with smaller chi-squared statistics of their own and of all their pairs, have no weight.
LEAST_TEXTS = 3
LEAST_CHI2 = 20.0
LEAST_PAIR_CHI2 = 60.0
#: Toxic texts that hold both terms of such a pair, at least.
LEAST_PAIR_TEXTS = 8
#: Pairs are counted in so many texts of each class and among so many terms, those in most toxic texts, at most.
PAIR_TEXTS = 2048
PAIR_TERMS = 8192
#: Terms whose pairs are counted at a time, which bounds the task's memory.
PAIR_BLOCK = 256
#: Letters of a longer word that are a term too.
STEM = 5

_WORD = re.compile(r"[^\W\d_]+").findall
_TERMS: dict[str, list[int]] = {}


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of one whole text."""
    if not text:
        return np.empty(0, np.int32)
    if len(_TERMS) > 50_000:
        _TERMS.clear()
    out, get = [], _TERMS.get
    for word in set(_WORD(text.lower())):
        term = get(word)
        if term is None:
            names = [word] if len(word) <= STEM else [word, "^" + word[:STEM]]
            term = _TERMS[word] = [zlib.crc32(n.encode()) % BUCKETS for n in names]
        out += term
    return np.unique(np.array(out, np.int32))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # by term
    vector: np.ndarray  # by term and factor
    used: np.ndarray  # by term

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(rows), self.bias, np.float64)
        sizes = np.array([len(r) for r in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        idx = np.concatenate(rows) if len(rows) else np.empty(0, np.int32)
        used = self.used[idx]
        owner, idx = owner[used], idx[used]
        if len(idx):
            full, starts = np.unique(owner, return_index=True)
            v = self.vector[idx]
            pairs = (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(axis=1) / 2
            z[full] += np.add.reduceat(self.weight[idx], starts) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _incidence(rows: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(known)), np.uint8)
    for k, row in enumerate(rows):
        at = np.minimum(np.searchsorted(known, row), len(known) - 1)
        out[k, at[known[at] == row]] = 1
    return out


def _texts_with(rows: list[np.ndarray]) -> np.ndarray:
    """By term, how many rows hold it."""
    out = np.zeros(BUCKETS, np.float64)
    for k in range(0, len(rows), 1024):
        out += np.bincount(np.concatenate(rows[k : k + 1024]), minlength=BUCKETS)
    return out


def paired_terms(rows: list[np.ndarray], labels: np.ndarray, with_1: np.ndarray, texts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Terms of pairs that are toxic together far more often than the more toxic of the two is. Where no text but toxic
    ones holds a pair, one more is taken to."""
    rng = np.random.default_rng(seed)
    frequent = np.flatnonzero(with_1 >= LEAST_PAIR_TEXTS)
    known = np.sort(frequent[np.argsort(-with_1[frequent], kind="stable")[:PAIR_TERMS]])
    if not len(known):
        return known
    held, scale = [], []
    for label in (0, 1):
        of_class = np.flatnonzero(labels == label)
        chosen = rng.permutation(of_class)[:PAIR_TEXTS]
        held.append(_incidence([rows[k] for k in chosen], known))
        scale.append(len(of_class) / max(1, len(chosen)))
    rate, found = (with_1 / np.maximum(texts, 1))[known].astype(np.float32), np.zeros(len(known), bool)
    parts = [slice(k, k + PAIR_BLOCK) for k in range(0, len(known), PAIR_BLOCK)]
    for k, a in enumerate(parts):
        left = [x[:, a].astype(np.float32) for x in held]
        for b in parts[k:]:
            clean, toxic = (x.T @ y[:, b].astype(np.float32) for x, y in zip(left, held))
            n = scale[0] * (clean + 1) + scale[1] * toxic
            own = np.clip(np.maximum(rate[a, None], rate[b]), 1e-6, 1 - 1e-6)
            excess = scale[1] * toxic - n * own
            pair = (toxic >= LEAST_PAIR_TEXTS) & (excess > 0) & (excess**2 >= LEAST_PAIR_CHI2 * n * own * (1 - own))
            found[a] |= pair.any(axis=1)
            found[b] |= pair.any(axis=0)
    return known[found]


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-4, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; classes weigh alike at most four to one."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    n, positive = len(rows), float(labels.sum())
    prior = (positive + 0.5) / (n + 2)
    machine = Machine(float(np.log(prior / (1 - prior))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32), np.zeros(BUCKETS, bool))
    if not n or positive in (0, n):
        return machine
    with_1, with_0 = (_texts_with([rows[k] for k in np.flatnonzero(labels == y)]) for y in (1, 0))
    texts = with_1 + with_0
    by_chance = texts * positive / n
    chi2 = (with_1 - by_chance) ** 2 * n / np.maximum(texts * positive / n * (n - positive) * (1 - texts / (n + 1)), 1e-9)
    seen = (texts >= LEAST_TEXTS) & (chi2 >= LEAST_CHI2)
    seen[paired_terms(rows, labels, with_1, texts)] = True
    machine.used = seen
    known = np.flatnonzero(seen)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))
    kept = [place[r][seen[r]] for r in rows]
    w, v = np.zeros(len(known), np.float32), rng.normal(0, 0.05, (len(known), FACTORS)).astype(np.float32)
    gw, gv, gb, bias = np.full(len(known), 1e-4, np.float32), np.full(v.shape, 1e-4, np.float32), 1e-4, machine.bias
    heavier = min(4.0, (n - positive) / positive)
    for _ in range(epochs):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 128)):
            sizes = np.array([len(kept[k]) for k in batch])
            z, y, full = np.full(len(batch), bias), labels[batch], np.flatnonzero(sizes)
            starts = np.cumsum(sizes[full]) - sizes[full]
            idx = np.concatenate([kept[k] for k in batch])
            if len(idx):
                vx = v[idx]
                total = np.add.reduceat(vx, starts)
                z[full] += np.add.reduceat(w[idx], starts) + (total**2 - np.add.reduceat(vx * vx, starts)).sum(axis=1) / 2
            miss = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, heavier, 1)).astype(np.float32) / len(batch)
            gb += float(miss.sum()) ** 2
            bias -= rate * float(miss.sum()) / np.sqrt(gb)
            if not len(idx):
                continue
            each = np.repeat(miss[full], sizes[full])
            terms_here, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, each, len(terms_here)).astype(np.float32) + decay * w[terms_here]
            dv_each = each[:, None] * (np.repeat(total, sizes[full], axis=0) - vx)
            dv = np.stack([np.bincount(back, dv_each[:, f], len(terms_here)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * v[terms_here]
            gw[terms_here] += dw * dw
            gv[terms_here] += dv * dv
            w[terms_here] -= rate * dw / np.sqrt(gw[terms_here])
            v[terms_here] -= rate * 0.25 * dv / np.sqrt(gv[terms_here])
    machine.bias = float(bias)
    machine.weight[known], machine.vector[known] = w, v
    return machine


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, sample: int = SAMPLE) -> Machine:
    """From the labelled documents outside the held-out fold, `sample` of them at most."""
    usable = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_bucket("doc_id", folds) != held_out))
    one_each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "toxic": batch.toxic, "terms": [terms(t).tobytes() for t in batch.text]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((d, t, y) for batch in batches for d, t, y in zip(batch.doc_id.tolist(), batch.terms, batch.toxic.tolist()))
        machine = fit([np.frombuffer(t, np.int32) for _, t, _ in rows], np.array([y for *_, y in rows]))
        known = np.flatnonzero(machine.used)
        parts = known.astype(np.int32), machine.weight[known], machine.vector[known]
        yield pd.DataFrame([(machine.bias, *[part.tobytes() for part in parts])], columns=["bias", "known", "weight", "vector"])

    # at most `sample` rows of two numbers
    joined = documents(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = joined.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInPandas(hashed, "doc_id bigint, toxic int, terms binary")
    found = rows.repartition(1).mapInPandas(fitted, "bias double, known binary, weight binary, vector binary").collect()
    if not found:  # no labelled rows
        return fit([], np.empty(0))
    machine = Machine(found[0].bias, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32), np.zeros(BUCKETS, bool))
    known, weight, vector = (np.frombuffer(found[0][c], kind) for c, kind in (("known", np.int32), ("weight", np.float32), ("vector", np.float32)))
    machine.used[known], machine.weight[known], machine.vector[known] = True, weight, vector.reshape(-1, FACTORS)
    return machine


def score_documents(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """`keep` and doc_id, the toxicity score and the prediction of every row."""
    wanted = ["doc_id", *[c for c in dict.fromkeys(keep) if c != "doc_id"]]
    read = documents(docs, *dict.fromkeys([*wanted, "text"]))
    model = docs.sparkSession.sparkContext.broadcast(machine)
    types = {f.name: f.dataType.simpleString() for f in read.schema.fields}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = model.value
        for batch in batches:
            scores = fitted.score([terms(t) for t in batch.text])
            out = batch[wanted].assign(toxic_score=scores, toxic_predicted=(scores >= 0.5).astype(np.int32))
            yield out.astype({c: "Int64" for c in wanted if types[c] in ("bigint", "int")})

    schema = ", ".join(f"`{c}` {types[c]}" for c in wanted)
    return read.mapInPandas(score, f"{schema}, toxic_score double, toxic_predicted int")


def drop_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs, all columns, without the rows that the machine calls toxic."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.score([terms(t) for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_documents(docs, learn(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
