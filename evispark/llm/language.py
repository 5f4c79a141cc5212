"""Language by a byte convolutional network.

A window is WINDOW bytes of a text's UTF-8 form. Filters of several widths over byte embeddings, the largest response
of each over the window and a softmax give a distribution; a text's is the mean of the log-probabilities of all its
windows, which cover it whole (the last window ends with the text). The network is trained in numpy on the driver, on
WINDOWS_EACH windows each of at most SAMPLE_EACH documents of a language; every language that occurs is learned. For
scoring, embeddings and filters fold into tables by byte and by byte pair, so that a response is a sum of table rows.

`und` with score 0 is given for null texts, texts without a letter, and where nothing could be learned. Rows without
doc_id count as crc32 of the empty text. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_bucket, documents

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMENSIONS = 8
#: Documents of a language, and of all together, and windows of each that the network is trained on, at most; of each
#: language there is one at least.
SAMPLE_EACH = 1000
SAMPLE = 200_000
WINDOWS_EACH = 2
EPOCHS = 8
#: Windows scored at a time.
BATCH = 512

_LATIN = re.compile("[A-Za-z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LATIN(text)) or any(c.isalpha() for c in text))


def windows(data: bytes) -> np.ndarray:
    """Every window of a text; a short text is one window, filled up with zeros."""
    if len(data) <= WINDOW:
        return np.frombuffer(data.ljust(WINDOW, b"\0"), np.uint8)[None]
    buffer = np.frombuffer(data, np.uint8)
    whole = len(buffer) // WINDOW
    out = buffer[: whole * WINDOW].reshape(whole, WINDOW)
    return out if whole * WINDOW == len(buffer) else np.concatenate([out, buffer[None, -WINDOW:]])


@dataclass
class Network:
    names: list[str]
    embed: np.ndarray  # byte, dimension
    filters: dict[int, np.ndarray]  # width: place in the filter, dimension, filter
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters, name
    out_bias: np.ndarray

    def fold(self) -> "Network":
        """Make the tables for scoring."""
        self.tables = []
        for width, f in self.filters.items():
            single = np.einsum("bd,wdf->wbf", self.embed, f).astype(np.float32)
            parts = [(k, (single[k][:, None] + single[k + 1][None]).reshape(65536, -1)) for k in range(0, width - 1, 2)]
            self.tables.append((width, parts, single[-1] if width % 2 else None))
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = []
        pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        for width, parts, last in self.tables:
            n = x.shape[1] - width + 1
            total = None
            for k, table in parts:
                part = table[pairs[:, k : k + n]]
                total = part if total is None else np.add(total, part, out=total)
            if last is not None:
                total += last[x[:, width - 1 :]]
            pooled.append(total.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names:
            return names, scores
        held: list[np.ndarray] = []
        owner: list[int] = []
        sums, counts, waiting = np.zeros((len(texts), len(self.names))), np.zeros(len(texts)), 0

        def run() -> None:
            x = np.concatenate(held)
            who = np.repeat(owner, [len(h) for h in held])
            for a in range(0, len(x), BATCH):
                np.add.at(sums, who[a : a + BATCH], self.log_probabilities(x[a : a + BATCH]))
            np.add.at(counts, who, 1)
            held.clear(), owner.clear()

        for k, text in enumerate(texts):
            if has_letter(text):
                held.append(windows(text.encode("utf-8", "replace")))
                owner.append(k)
                waiting += len(held[-1])
                if waiting >= 8 * BATCH:
                    run()
                    waiting = 0
        if held:
            run()
        for k in np.flatnonzero(counts):
            p = np.exp(sums[k] / counts[k] - (sums[k] / counts[k]).max())
            names[k], scores[k] = self.names[int(p.argmax())], float(p.max() / p.sum())
        return names, scores


def train(x: np.ndarray, y: np.ndarray, names: list[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the cross-entropy. The maximum passes its gradient to one place, so few patches take part in a step."""
    rng = np.random.default_rng(seed)
    all_filters = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.5, (256, DIMENSIONS)), "bias": np.zeros(all_filters), "out": rng.normal(0, 0.1, (all_filters, max(1, len(names)))), "out_bias": np.zeros(max(1, len(names)))}
    p |= {w: rng.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs if len(x) else 0):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb, b = x[batch], y[batch], len(batch)
            e = p["embed"][xb]
            pooled, where = [], {}
            for w in WIDTHS:
                n = WINDOW - w + 1
                r = sum(e[:, k : k + n] @ p[w][k] for k in range(w))
                where[w] = r.argmax(axis=1)
                pooled.append(np.take_along_axis(r, where[w][:, None], 1)[:, 0])
            z = np.concatenate(pooled, axis=1) + p["bias"]
            h = np.maximum(z, 0)
            logits = h @ p["out"] + p["out_bias"]
            q = np.exp(logits - logits.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(b), yb] -= 1
            q /= b
            g = {"out": h.T @ q, "out_bias": q.sum(axis=0), "embed": np.zeros_like(p["embed"])}
            dz = (q @ p["out"].T) * (z > 0)
            g["bias"] = dz.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                g[w] = np.empty_like(p[w])
                for k in range(w):
                    at = where[w] + k
                    patch = e[np.arange(b)[:, None], at]  # window, filter, dimension
                    g[w][k] = np.einsum("nfd,nf->df", patch, d)
                    np.add.at(g["embed"], xb[np.arange(b)[:, None], at], d[..., None] * p[w][k].T[None])
            step += 1
            for k, grad in g.items():
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return Network(names, p["embed"], {w: p[w] for w in WIDTHS}, p["bias"], p["out"], p["out_bias"])


def learn(docs: DataFrame, held_out: int = 2, folds: int = 4) -> Network:
    """From text and non-null lang of the documents outside the held-out fold; both are bounded samples by hash."""
    spark = docs.sparkSession
    usable = documents(docs, "doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (crc_bucket("doc_id", folds) != held_out))
    counts = usable.groupBy("lang").count().collect()  # a row for each language, which is a class of the network
    names = sorted(r.lang for r in counts)
    each = max(1, min(SAMPLE_EACH, SAMPLE // max(1, len(names))))
    # by a threshold on a hash most rows of a frequent language never reach the ranks
    share = spark.createDataFrame([(r.lang, min(1.0, (2 * each + 50) / r["count"])) for r in counts], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("nth"), "doc_id"), "doc_id")
    chosen = usable.join(F.broadcast(share), "lang").where(drawn).withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= each)
    chosen = chosen.groupBy("doc_id").agg(F.min("lang").alias("name"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, name, text in zip(batch.doc_id, batch.name, batch.text):
                if has_letter(text):
                    w = windows(text.encode("utf-8", "replace"))
                    for k in np.unique(np.linspace(0, len(w) - 1, WINDOWS_EACH).astype(int)):
                        rows.append((doc_id, name, w[k].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "bytes"])

    # at most SAMPLE rows of two values, or one for each language
    joined = documents(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "name", "text")
    rows = joined.mapInPandas(cut, "doc_id bigint, name string, bytes binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.name, r.bytes))
    x = np.frombuffer(b"".join(r.bytes for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([names.index(r.name) for r in rows], np.int64), names if len(rows) else [])


def predict_documents(docs: DataFrame, network: Network) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = model.value.fold()
        for batch in batches:
            names, scores = net.predict(list(batch.text))
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "lang_pred": names, "score": scores})

    return documents(docs, "doc_id", "text").mapInPandas(predict, "doc_id bigint, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_documents(docs, learn(docs))
    return out.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
