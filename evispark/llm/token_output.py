"""Token-id output in Simple-8b words, and the reader of its files.

A file is a Parquet shard of one row for each document, in ascending doc_id order, shards in ascending order of their
number. A row's `words` are little-endian 64-bit words: blocks of at most BLOCK ids, each starting at a word that
`block_words` names, followed by the block's literals. The top four bits of a word are its selector; the other sixty
hold as many ids as the selector says, first id in the lowest bits. Ids of over sixty bits are escapes: selector 0 with
payload 1, and the id itself, raw, among the literals. Each word has the selector that holds the most of the ids that
come next; the last word of a block may be filled up with zeros. All words of a batch are decoded at once.

Null text is the empty text, which has the end id alone. A null doc_id comes before all others. Rows that repeat a
doc_id are documents of their own, in the order of their texts. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, partitions
from .tokens import default_path, encoder

BLOCK = 4096
#: Fixed values of the format: how many ids a word of each selector holds, and in how many bits each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64(1)
DATA_BITS = np.uint64(60)


#: Selectors from the fewest ids in a word to the most, with the bits of each id.
_BY_COUNT = [(s, int(COUNTS[s]), int(BITS[s])) for s in range(len(COUNTS) - 1, -1, -1)]
#: Zeros after each block, so that the ids of a word never run into the next block.
SPARE = int(COUNTS.max())


_SMALL = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)
_COUNTS = COUNTS.astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """The bits that each id needs."""
    most = ids.max(initial=0)
    if most < len(_SMALL):
        return _SMALL[ids]
    if most >> np.uint64(53) == 0:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    high = ids >> np.uint64(32)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def _fullest(widths: np.ndarray) -> np.ndarray:
    """For every place the selector of the word that holds the most ids from there on. Widest ids of growing runs come
    from those of shorter ones, so all places are looked at together for each selector."""
    out = np.full(len(widths), len(COUNTS) - 1, np.uint8)
    widest, size = widths, 1
    for s, count, bits in _BY_COUNT:
        while size < count:
            step = min(size, count - size)
            widest, size = np.maximum(widest[:-step], widest[step:]), size + step
        fits = widest <= bits
        if not fits.any():
            if bits >= widths.max(initial=0):
                break
            continue
        np.copyto(out[: len(fits)], np.uint8(s), where=fits)
    return out


def encode_many(documents_ids: list[np.ndarray], block: int = BLOCK) -> list[tuple[bytes, list[int]]]:
    """For each document its words and the word at which each of its blocks starts."""
    sizes = [len(x) for x in documents_ids]
    lengths = np.array([min(block, n - a) for n in sizes for a in range(0, n, block)], np.int64)  # of blocks
    if not len(lengths):
        return [(b"", [])] * len(sizes)
    ids = np.zeros(int(lengths.sum()) + SPARE * len(lengths), np.uint64)
    first = np.cumsum(lengths + SPARE) - lengths - SPARE
    parts = (x[a : a + block] for x in documents_ids for a in range(0, len(x), block))
    for a, n, part in zip(first.tolist(), lengths.tolist(), parts):
        ids[a : a + n] = part
    widths = _widths(ids)
    escapes = widths > BITS.max()
    selector = _fullest(widths)
    step = _COUNTS[selector]
    step[escapes] = 1  # such an id lies alone in its word
    steps, at, counts = step.tobytes(), [], []
    add = at.append
    for a, n in zip(first.tolist(), lengths.tolist()):
        before, end = len(at), a + n
        while a < end:
            add(a)
            a += steps[a]
        counts.append(len(at) - before)
    begin = np.array(at, np.int64)
    chosen = selector[begin]
    words = np.zeros(len(begin), np.uint64)
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        total = np.full(len(which), int(s) << 60, np.uint64)
        for k in range(int(COUNTS[s]) if BITS[s] else 0):
            total |= ids[begin[which] + k] << np.uint64(k * int(BITS[s]))
        words[which] = total
    escaped = escapes[begin]
    words[escaped] = ESCAPE
    literals = ids[begin[escaped]]
    ends = np.cumsum(counts)
    spent = np.concatenate([[0], np.cumsum(escaped)])[np.append(0, ends)]  # literals up to each block's end
    out, b = [], 0
    for n in sizes:
        pieces, starts, have = [], [], 0
        for k in range(b, b - (-n // block)):
            own = words[ends[k] - counts[k] : ends[k]]
            starts.append(have)
            pieces += [own, literals[spent[k] : spent[k + 1]]]
            have += len(own) + len(pieces[-1])
        b -= -n // block
        out.append((np.concatenate([np.empty(0, np.uint64), *pieces]).astype("<u8").tobytes(), starts))
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """The words of one document and the word at which each of its blocks starts."""
    return encode_many([np.asarray(ids, np.uint64)], block)[0]


def _unpack(words: np.ndarray, selector: np.ndarray, skip: np.ndarray, place: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    """Ids of words to out, from place on and below limit, word by word; words to skip stay out."""
    whole = place + COUNTS[selector] <= limit
    for s in np.unique(selector):
        mine = (selector == s) & ~skip
        if not BITS[s]:
            continue
        shifts, mask, steps = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64), np.uint64((1 << int(BITS[s])) - 1), np.arange(COUNTS[s])
        at = np.flatnonzero(mine & whole)
        out[place[at][:, None] + steps] = (words[at][:, None] >> shifts) & mask
        for k in np.flatnonzero(mine & ~whole).tolist():  # at most one for each block
            n = int(limit[k] - place[k])
            out[place[k] : limit[k]] = (words[k] >> shifts[:n]) & mask


def _decode_block(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> DATA_BITS).astype(np.int64)
    escape = words == ESCAPE
    ends = np.cumsum(np.where(escape, 1, COUNTS[selector]))
    used = int(np.searchsorted(ends, n)) + 1  # what follows are literals
    words, literals, selector, escape, ends = words[:used], words[used:], selector[:used], escape[:used], ends[:used]
    out = np.zeros(n, np.uint64)
    _unpack(words, selector, escape, ends - np.where(escape, 1, COUNTS[selector]), np.full(used, n), out)
    out[ends[escape] - 1] = literals[: int(escape.sum())]
    return out


def decode(words: bytes, block_words: list[int], n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of one document."""
    words = np.frombuffer(words, "<u8").astype(np.uint64)
    bounds = [*block_words, words.size]
    parts = [_decode_block(words[a:b], min(block, n_ids - k * block)) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def decode_many(coded: list[bytes], block_words: list, n_ids: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """The ids of each document; documents without escapes are decoded together."""
    sizes = np.array([len(w) // 8 for w in coded], np.int64)
    words = np.frombuffer(b"".join(coded), "<u8").astype(np.uint64)
    if (words == ESCAPE).any():
        return [decode(w, list(b), int(n), block) for w, b, n in zip(coded, block_words, n_ids)]
    n_ids = np.asarray(n_ids, np.int64)
    begins = np.concatenate([np.asarray(x, np.int64) + a for x, a in zip(block_words, np.cumsum(sizes) - sizes)]) if len(sizes) else np.empty(0, np.int64)
    n_blocks = -(-n_ids // block)
    nth = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    lengths = np.minimum(block, np.repeat(n_ids, n_blocks) - nth * block)
    ends = np.cumsum(lengths)
    size = np.diff(np.append(begins, len(words)))  # of blocks, in words
    selector = (words >> DATA_BITS).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    place = before - np.repeat(before[begins] - (ends - lengths), size) if len(words) else before
    out = np.zeros(int(n_ids.sum()), np.uint64)
    _unpack(words, selector, np.zeros(len(words), bool), place, np.repeat(ends, size), out)
    return np.split(out, np.cumsum(n_ids)[:-1])


FILE_SCHEMA = "shard int, doc_id bigint, shard_start bigint, n_ids bigint, block_words array<int>, words binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> None:
    """Write the ids of doc_id and text to shard files below path. Shards are ranges of doc_id, of about equal rows."""
    spark = docs.sparkSession

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, start, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            ids = [np.append(coder.encode(t), np.uint32(end_id)) for t in batch.text]
            rows = []
            for doc_id, x, (words, block_words) in zip(batch.doc_id, ids, encode_many(ids)):
                rows.append((shard, doc_id, start, len(x), block_words, words))
                start += len(x)
            yield pd.DataFrame(rows, columns=["shard", "doc_id", "shard_start", "n_ids", "block_words", "words"]).astype({"doc_id": "Int64"})

    dealt = documents(docs, "doc_id", "text").repartitionByRange(shards or partitions(spark), "doc_id")
    coded = dealt.sortWithinPartitions("doc_id", "text").mapInPandas(code, FILE_SCHEMA)
    coded.write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, first id): where each shard starts among all ids. One row for each shard."""
    totals = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = totals.select(F.col("shard").alias("earlier"), F.col("n").alias("m"))
    return totals.join(F.broadcast(earlier), F.col("earlier") < F.col("shard"), "left").groupBy("shard").agg(F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("first"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, from the decoded ids."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = decode_many(list(batch.words), list(batch.block_words), batch.n_ids.to_numpy())
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield batch[["shard", "doc_id", "shard_start"]].assign(n_tokens=batch.n_ids, ids_crc32=crc).astype({"doc_id": "Int64"})

    rows = spark.read.schema(FILE_SCHEMA).parquet(path).mapInPandas(check, "shard int, doc_id bigint, shard_start bigint, n_tokens bigint, ids_crc32 bigint")
    first = F.broadcast(read_index(spark, path))  # a row for each shard
    return rows.join(first, "shard").select("doc_id", (F.col("first") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_path("byte_bpe_50k.json"))
    return read_ids(spark, path)
