"""Exact Jaccard self-join of word-shingle sets, by a size-aware heavy-light join, and its components.

Equal sets are one class. Of two sizes, links need an overlap c that the threshold fixes. Light sets, of at most x
shingles, meet by enumeration: each yields its subsets of every c that a light partner may need, and two sets with a
c-subset in common are linked if their sizes need no more than c. Heavy sets meet in inverted lists: a set enters the
lists of its prefix, its rarest shingles in one global order, as far as any partner must share one. x is chosen by cost,
from the histogram of sizes: subsets enumerated against list entries that these sets would otherwise cause.

The order of shingles puts those last that a sample of SAMPLE documents holds often, so passages that many documents
share stay out of the prefixes, and before them those of words that are frequent in it, so sets that share such words by
chance rarely meet; the sample moves cost alone, never a result. Lists of shingles that are HOT in it are
counted by partial sums. Lists of LONG_LIST sets or fewer give pairs, thinned by size and position, then by sketches, and
verified on the texts. A sketch tells of each bit whether an odd number of a set's shingles falls on it; two sets differ in
at least as many shingles as their sketches in bits, so no link is lost, and texts of pairs met by chance aren't sent.
Longer lists, if not of hot shingles, are thinned by sizes and positions too: what a list that is shared by chance leaves
is pairs like those of short lists. Those that leave many, as clusters do, and hot ones are grouped by their smallest
member, the pivot. First every member is held against the pivot alone.
Members that link to it are in one component and need no links among each other; and as Jaccard distance is a metric,
those beyond twice the linked distance from the pivot can't link to them either. What is left to compare - the others
among each other, and those within twice the distance with the linked ones - is cut into blocks of BLOCK sets of sizes
within a quarter, and blocks of the same or neighbouring sizes are verified within a task, which returns a spanning
forest of their links.

A shingle is WORDS words; words are runs of other bytes than space, \\t, \\n, \\v, \\f and \\r, with A-Z lower-cased. Fewer
words are one shingle. Null and empty texts have no shingles and no links. Shingles and sets go by 64-bit names. A null
doc_id comes before all others. Rows that repeat a doc_id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, release, staged
from .components import components
from .suffix_dedup import Names

WORDS = 5
#: Of an intersection, and of a union that it must reach: 100 * intersection >= SHARE * union.
SHARE = 80
SAMPLE = 20_000
SAMPLE_COUNT = 3
#: Frequent shingles that are told to all tasks, at most.
FREQUENT = 200_000
#: Documents of the sample that hold a hot shingle, at least.
HOT = 100
LONG_LIST = 64
BLOCK = 512
#: Light sets have at most so many shingles, whatever the costs.
MOST_LIGHT = 12
#: What a list entry costs, in subsets.
ENTRY_COST = 4
#: Members that one task verifies against a set, about.
MEMBERS = 400
#: Documents whose words are counted.
WORD_SAMPLE = 4_000
#: Words are counted in so many places; those of one place count as one.
WORD_PLACES = 1 << 20
#: Keys that may be broadcast instead of a shuffle of texts: rows of six numbers at most, so about 32 MB.
BROADCAST_ROWS = 300_000
#: Bits that tell where more keys than those hash to, 8 MB.
KEY_PLACES = 1 << 26
_NONE = -(1 << 63)
#: What a text is needed for: a set or a pivot, its members, or a block against itself or another.
HOST, MEMBER, PIVOTED, FIRST, OTHER = range(5)
#: Of a member to its pivot: linked, within twice the linked distance, or beyond.
LINKED, NEAR, FAR = range(3)

_rng = np.random.default_rng(23)
_TURN = _rng.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _words(text: str | None) -> np.ndarray:
    """The names of the words of one whole text."""
    if not text:
        return np.empty(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    names = Names(data)
    return Names._mix((names.sums[ends] - names.sums[starts]) * names.down[starts] + (ends - starts).astype(np.uint64))


def _shingle_names(words: np.ndarray) -> np.ndarray:
    """The name of the shingle at each word that begins one."""
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, min(len(words), WORDS), np.uint64)
    for k in range(min(len(words), WORDS)):
        out += words[k : k + n] * _TURN[k]
    return Names._mix(out)


def shingles(text: str | None) -> np.ndarray:
    """The sorted names of the distinct shingles of one whole text."""
    words = _words(text)
    return np.unique(_shingle_names(words)) if len(words) else words


def _places(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(WORD_PLACES)).astype(np.int64)


def weighed_shingles(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingles, and the sum of the weights of each one's words."""
    words = _words(text)
    if not len(words):
        return words, np.empty(0, np.int16)
    names, first = np.unique(_shingle_names(words), return_index=True)
    each = weights[_places(words)]
    total = np.zeros(max(1, len(words) - WORDS + 1), np.int16)
    for k in range(min(len(words), WORDS)):
        total += each[k : k + len(total)]
    return names, total[first]


def sketch(s: np.ndarray) -> np.ndarray:
    """Of each bit, whether an odd number of shingles falls on it: a power of two of bits, 64 at least and as many as
    shingles."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _bits_apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ; the longer one is folded to the length of the other."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    # sets that may link are of sizes within a quarter, so lengths are the same or one is twice the other
    x, y = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda t, k: t + k)


def set_name(s: np.ndarray) -> int:
    return int(Names._mix(np.array([np.add.reduce(s) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def overlap(n: int, m: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-SHARE * (n + m) // (100 + SHARE))


def prefix(n: int) -> int:
    return n - -(-SHARE * n // 100) + 1


def partners(n: int) -> range:
    return range(-(-SHARE * n // 100), 100 * n // SHARE + 1)


def subset_sizes(n: int, light: int) -> list[int]:
    return sorted({c for m in partners(n) if m <= light and (c := overlap(n, m)) <= n})


def choose_light(sizes: dict[int, int], longer: int) -> int:
    """The cheapest bound of light sets. sizes: how many sets of each small size; longer: entries of all others."""
    def cost(x: int) -> float:
        subsets = sum(k * sum(math.comb(n, c) for c in subset_sizes(n, x)) for n, k in sizes.items() if 0 < n <= x)
        return subsets + ENTRY_COST * (longer + sum(k * prefix(n) for n, k in sizes.items() if n >= SHARE * (x + 1) / 100))
    return min(range(0, MOST_LIGHT + 1), key=cost)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def sets_of(docs: DataFrame) -> DataFrame:
    """(k, t, v, n, held, sketch) of every row: v names the set, n is its size; held has the shingles of a set that may be
    light. Staged."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t) for t in batch.text]
            held = [s.view(np.int64) if 0 < len(s) <= MOST_LIGHT else None for s in sets]
            yield pd.DataFrame({"k": batch.k, "t": batch.t, "v": [set_name(s) for s in sets], "n": [len(s) for s in sets], "held": pd.Series(held, index=batch.index, dtype=object), "sketch": pd.Series([sketch(s) if len(s) else None for s in sets], index=batch.index, dtype=object)})

    return staged(_keyed(docs).mapInPandas(name, "k bigint, t bigint, v bigint, n int, held array<bigint>, sketch array<bigint>"), "sets")


def _columns(rows: DataFrame) -> list[np.ndarray]:
    """Columns of numbers, as Arrow: the driver never holds an object for each row."""
    return [c.to_numpy() for c in rows.toArrow().columns]


def _sampled(docs: DataFrame, total: int, rows: int) -> DataFrame:
    return _keyed(docs).where(F.pmod(F.xxhash64("k", "t"), F.lit(max(1, total // rows))) == 0)


def word_weights(docs: DataFrame, total: int) -> np.ndarray:
    """By place, how often the sample has words of it: eight times the binary logarithm. What the sample doesn't hold, or
    once, is of no weight."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(WORD_PLACES, np.int64)
        for batch in batches:
            found += np.bincount(_places(np.concatenate([np.empty(0, np.uint64), *map(_words, batch.text)])), minlength=WORD_PLACES)
        at = np.flatnonzero(found)
        for a in range(0, len(at), 100_000):
            yield pd.DataFrame({"place": at[a : a + 100_000], "c": found[at[a : a + 100_000]]})

    counts = _sampled(docs, total, WORD_SAMPLE).mapInPandas(count, "place bigint, c bigint").groupBy("place").agg(F.sum("c").alias("c"))
    place, c = _columns(counts.where("c > 1"))
    weights = np.zeros(WORD_PLACES, np.int16)
    weights[place] = np.rint(8 * np.log2(c.astype(np.float64))).astype(np.int16)
    return weights


def frequent_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts, in ascending order of names, of what the sample holds often."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t) for t in batch.text]
            yield pd.DataFrame({"s": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)})

    counts = _sampled(docs, total, SAMPLE).mapInPandas(count, "s bigint").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= SAMPLE_COUNT)
    names, c = _columns(counts.orderBy(F.desc("c"), "s").limit(FREQUENT))
    order = np.argsort(names.view(np.uint64))
    return names.view(np.uint64)[order], c[order]


def _light_links(sets: DataFrame, light: int) -> DataFrame:
    """Links between light sets. Of the sets with one subset, all that can be linked are linked to the smallest."""

    def enumerate_subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for v, n, held in zip(batch.v, batch.n, batch.held):
                s = np.asarray(held, np.int64).view(np.uint64)
                for c in subset_sizes(n, light):
                    rows += [(c, set_name(np.array(x, np.uint64)), v, n) for x in combinations(s, c)]
            yield pd.DataFrame(rows, columns=["c", "subset", "v", "n"]).drop_duplicates()

    short = sets.where(F.col("n").between(1, light)).select("v", "n", "held")
    rows = short.mapInPandas(enumerate_subsets, "c int, subset bigint, v bigint, n int").distinct()
    least = rows.groupBy("c", "subset").agg(F.min(F.struct("n", "v")).alias("least"))
    need = F.ceil((F.col("n") + F.col("least.n")) * SHARE / (100 + SHARE))
    return rows.join(least, ["c", "subset"]).where((F.col("v") != F.col("least.v")) & (need <= F.col("c"))).select(F.col("least.v").alias("u"), "v")


def _entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], weights: np.ndarray, light: int) -> DataFrame:
    """(s, v, n, pos, hot): the prefix of each distinct set of a task; sets without a heavy partner stay out. Hot shingles
    stand in hot, which is 0 for all others, and a name of shingle and set in s."""
    told = docs.sparkSession.sparkContext.broadcast((*frequent, weights))
    least = -(-SHARE * (light + 1) // 100)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counts, weights = told.value
        seen: set[int] = set()
        for batch in batches:
            held = []
            for text in batch.text:
                s, weight = weighed_shingles(text, weights)
                if len(s) < max(1, least) or (v := set_name(s)) in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(v)
                size = prefix(len(s))
                often = np.zeros(len(s), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    often = np.where(names[at] == s, counts[at], 0)
                first = np.argsort(often * (1 << 16) + weight if often.any() else weight, kind="stable")[:size]
                chosen, is_hot = s[first], often[first] >= HOT
                dealt = np.where(is_hot, Names._mix(chosen * np.uint64(3) ^ np.uint64(v % (1 << 64))), chosen)
                held.append(pd.DataFrame({"s": dealt.view(np.int64), "v": np.full(size, v, np.int64), "n": np.full(size, len(s), np.int32), "pos": np.arange(size, dtype=np.int32), "hot": np.where(is_hot, chosen, 0).view(np.int64)}))
            if held:
                yield pd.concat(held, ignore_index=True)

    return _keyed(docs).where(F.length("text") > 0).mapInPandas(emit, "s bigint, v bigint, n int, pos int, hot bigint")


def _lists(entries: DataFrame) -> DataFrame:
    """(s, v, n, pos, low, size): lists of several sets, with their smallest member and how many they are. Entries are
    shuffled once: all that is asked of a list is told where it lies."""
    columns, hot = ["s", "v", "n", "pos"], F.col("hot") != 0
    by_shingle = Window.partitionBy("s")
    several = entries.withColumn("low", F.min("v").over(by_shingle)).withColumn("high", F.max("v").over(by_shingle)).where((F.col("low") != F.col("high")) | hot)
    several = staged(several.drop("high").distinct().withColumn("size", F.count("*").over(by_shingle)), "lists")
    cold = several.where(~hot).drop("hot")
    frequent = several.where(hot).select(F.col("hot").alias("s"), *columns[1:]).distinct()
    counts = frequent.groupBy("s").agg(F.min("v").alias("low"), F.count("*").alias("size"))  # of FREQUENT shingles at most
    dealt = staged(frequent.join(F.broadcast(counts), "s").where("size > 1"), "hot-lists")
    lists = cold.unionByName(dealt)
    lists._parts = (several, dealt)
    lists._cold, lists._hot = cold, dealt
    return lists


def _pairs(lists: DataFrame, light: int) -> DataFrame:
    """Distinct pairs of short lists that sizes and positions leave possible. A list is one row, so it is shuffled once."""
    members = F.array_sort(F.collect_list(F.struct("v", "n", "pos")))
    short = lists.where(F.col("size") <= LONG_LIST).groupBy("s").agg(members.alias("m"))
    pairs = short.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    need = F.ceil((small + large) * SHARE / (100 + SHARE))
    possible = (large > light) & (large * SHARE <= small * 100) & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= need)
    return pairs.where(possible).select(F.col("a.v").alias("u"), F.col("b.v").alias("v")).distinct()


def _may_link(n: np.ndarray, pos: np.ndarray, low: int, high: int, end: int, light: int) -> np.ndarray:
    """Of members in ascending order of size, whether those from low to high may link to each of those from low to end, by
    sizes and positions, as in _pairs."""
    small, large = n[low:high, None], n[None, low:end]
    need = -(-SHARE * (small + large) // (100 + SHARE))
    left = n - pos
    later = np.arange(low, high)[:, None] < np.arange(low, end)[None, :]
    return later & (large > light) & (large * SHARE <= small * 100) & (np.minimum(left[low:high, None], left[None, low:end]) >= need)


def _crowded(lists: DataFrame, light: int) -> DataFrame:
    """(u, v, n, many), staged: what sizes and positions leave of the long lists that aren't of hot shingles. A list that
    sets share by chance leaves few pairs, which are named; one that leaves more than a short list may have for each of its
    members, like that of a cluster, is named by members, each with the smallest, the pivot; n is the size of v."""

    def left(v: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ends = np.searchsorted(n, n * 100 // SHARE, "right")
        most, found, met, count, low = LONG_LIST // 2 * len(v), [], np.zeros(len(v), bool), 0, 0
        while low < len(v):
            high = low + max(1, min(256, len(v) - low, (1 << 20) // int(ends[low] - low)))
            end = int(ends[high - 1])
            may = _may_link(n, pos, low, high, end, light)
            met[low:high] |= may.any(axis=1)
            met[low:end] |= may.any(axis=0)
            count += int(may.sum())
            if count <= most:
                found.append(np.stack(np.nonzero(may)) + low)
            low = high
        if count <= LONG_LIST // 2 * int(met.sum()):
            a, b = np.concatenate(found, axis=1)
            first = v[a] < v[b]
            return np.where(first, v[a], v[b]), np.where(first, v[b], v[a]), np.where(first, n[b], n[a]), np.zeros(len(a), bool)
        v, n = v[met], n[met]
        others = v != v.min()
        return np.full(others.sum(), v.min()), v[others], n[others], np.ones(others.sum(), bool)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        out: list[tuple[np.ndarray, ...]] = []

        def frame() -> pd.DataFrame:
            rows = [np.concatenate(x) for x in zip(*out)]
            out.clear()
            return pd.DataFrame(dict(zip(("u", "v", "n", "many"), rows)))

        for batch in batches:
            s, v, n, pos = (batch[c].to_numpy(np.int64) for c in ("s", "v", "n", "pos"))
            edges = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for low, high in zip(edges, edges[1:]):
                if held and held[-1][0][-1] != s[low]:
                    out.append(left(*(np.concatenate(x) for x in list(zip(*held))[1:])))
                    held = []
                    if sum(len(x[0]) for x in out) > 100_000 or len(out) > 1_000:
                        yield frame()
                held.append((s[low:high], v[low:high], n[low:high], pos[low:high]))
        if held:
            out.append(left(*(np.concatenate(x) for x in list(zip(*held))[1:])))
        if out:
            yield frame()

    long = lists.where(F.col("size") > LONG_LIST).select("s", "v", "n", "pos")
    dealt = long.repartition(partitions(lists.sparkSession), "s").sortWithinPartitions("s", "n")
    return staged(dealt.mapInPandas(split, "u bigint, v bigint, n int, many boolean").distinct(), "crowded")


def _near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sketches leave a link possible."""
    known = sets.groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    a, b = (known.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    apart = _bits_apart(F.col("sketch_u"), F.col("sketch_v"))
    possible = apart * (100 + SHARE) <= (100 - SHARE) * (F.col("n_u") + F.col("n_v"))
    return pairs.join(a, "u").join(b, "v").where(possible).select("u", "v")


def _parted(members: DataFrame, role: int) -> DataFrame:
    """(g, part, role, v): the members of each g in parts of about MEMBERS, and g itself in each of them."""
    counts = members.groupBy("g").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("bigint")
    if role == PIVOTED:
        part = -1 - part
    dealt = members.join(counts, "g").select("g", part.alias("part"), F.lit(role).alias("role"), "v")
    return dealt.unionByName(dealt.select("g", "part", F.lit(HOST).alias("role"), F.col("g").alias("v")).distinct())


def _long(lists: DataFrame) -> DataFrame:
    """(g, v, n): the members of long lists, by pivot."""
    return lists.where((F.col("size") > LONG_LIST) & (F.col("v") != F.col("low"))).select(F.col("low").alias("g"), "v", "n").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """members: g, v, n, state. (g, part, role, v): blocks that are compared, by twos. Sizes of a class are within a
    quarter, so linked sets are of one class or of neighbouring ones."""
    quarter = F.floor(F.log(F.col("n") * (1 + 1e-12)) / math.log(100 / SHARE)).cast("bigint")
    members = members.select("g", "v", "state", quarter.alias("class"))
    counts = members.groupBy("g", "state", "class").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("blocks"))
    keys = ["g", "state", "class", "block"]
    placed = members.join(counts, ["g", "state", "class"]).select("g", "v", "state", "class", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"))
    a, b = (counts.select("g", *[F.col(c).alias(f"{c}_{side}") for c in ("state", "class", "blocks")]) for side in "ab")
    order = lambda side: F.col(f"state_{side}") * 1000 + F.col(f"class_{side}")
    states = (F.col("state_a") == NEAR) | ((F.col("state_a") == FAR) & (F.col("state_b") == FAR)) | ((F.col("state_a") == LINKED) & (F.col("state_b") == NEAR))
    twos = a.join(b, "g").where((order("a") <= order("b")) & states & (F.abs(F.col("class_a") - F.col("class_b")) <= 1))
    twos = twos.withColumn("block_a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks_a") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks_b") - 1)))
    same = order("a") == order("b")
    twos = twos.where(~same | (F.col("block_a") <= F.col("block_b")))
    part = ((F.col("state_a") * 3 + F.col("state_b")) * 128 + F.col("class_a")) * 128 + F.col("class_b")
    part = (part * (1 << 21) + F.col("block_a")) * (1 << 21) + F.col("block_b")
    twos = twos.withColumn("part", part)
    first = twos.select("g", *[F.col(f"{c}_a").alias(c) for c in keys[1:]], "part", F.lit(FIRST).alias("role"))
    other = twos.where(~same | (F.col("block_a") != F.col("block_b"))).select("g", *[F.col(f"{c}_b").alias(c) for c in keys[1:]], "part", F.lit(OTHER).alias("role"))
    return placed.join(first.unionByName(other), keys).select("g", "part", "role", "v")


def _forest(sets: list[np.ndarray], names: list[int], split: int) -> list[tuple[int, int]]:
    """Links that span the components of all linked pairs; with a split, only pairs across it are looked at."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    shared, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    common = np.bincount(place, minlength=len(shared)) > 1
    column = np.cumsum(common) - 1
    use = common[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(common.sum()), 4096):
        here = slice(*np.searchsorted(place, [a, a + 4096]))
        part = np.zeros((n, 4096), np.float32)
        part[owner[here], place[here] - a] = 1
        both += part @ part.T
    linked = both * (100 + SHARE) >= SHARE * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if split < n:
        linked[:split, :split] = False
        linked[split:, split:] = False
    out, left = [], np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            at = front.pop()
            near = np.flatnonzero(linked[at] & left)
            left[near] = False
            out += [(names[at], names[k]) for k in near]
            front += near.tolist()
    return out


def _state(common: int, n: int, m: int) -> int:
    """In whole numbers: common / union against SHARE, and against twice the distance that it leaves."""
    union = n + m - common
    return LINKED if 100 * common >= SHARE * union else NEAR if 100 * common >= (2 * SHARE - 100) * union else FAR


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows are sorted by group, part and role. Links, and the state of every member of a pivot."""
    group, host, held, seen = None, None, {FIRST: [], OTHER: []}, set()
    out: list[tuple[int, int, int, bool]] = []

    def close() -> None:
        rows = held[FIRST] + held[OTHER]
        if len(rows) > 1:
            links = _forest([s for _, s in rows], [v for v, _ in rows], len(held[FIRST]) if held[OTHER] else len(rows))
            out.extend((u, v, LINKED, False) for u, v in links)
        held[FIRST].clear(), held[OTHER].clear(), seen.clear()

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["u", "v", "state", "pivoted"]).astype({"u": "int64", "v": "int64", "state": "int32", "pivoted": "bool"})

    for batch in batches:
        for g, part, role, v, text in zip(batch.g, batch.part, batch.role, batch.v, batch.text):
            if (g, part) != group:
                close()
                group, host = (g, part), None
            if (role, v) in seen:  # a row that is there twice
                continue
            seen.add((role, v))
            s = shingles(text)
            if role == HOST:
                host = (v, s)
            elif role in held:
                held[role].append((v, s))
            else:
                state = _state(len(np.intersect1d(host[1], s, assume_unique=True)), len(s), len(host[1]))
                if state == LINKED or role == PIVOTED:
                    out.append((host[0], v, state, role == PIVOTED))
        yield frame()
        out.clear()
    close()
    yield frame()


def _may_be_among(keys: DataFrame, *names: str) -> Callable[..., Column]:
    """Whether two columns may be a key: of every key, and of few other rows. Tasks are told the places that keys hash to,
    KEY_PLACES bits, so many other rows pass only beyond some millions of keys, which costs time and loses nothing."""
    place = F.pmod(F.xxhash64(*(names or ("k", "t"))), F.lit(KEY_PLACES))
    words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    bits = np.zeros(KEY_PLACES // 64, np.int64)
    w, b = _columns(words)
    bits[w] = b
    told = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def taken(p: pd.Series) -> pd.Series:
        at = p.to_numpy(np.int64)
        return pd.Series(told.value[at >> 6] >> (at & 63) & 1 == 1)

    return lambda k, t: taken(F.pmod(F.xxhash64(k, t), F.lit(KEY_PLACES)))


def _verified(docs: DataFrame, sets: DataFrame, roles: DataFrame) -> DataFrame:
    """(u, v, state, pivoted) of the comparisons that roles ask for, staged. A text is sent once for each of its roles."""
    roles = staged(roles, "roles")
    where = sets.groupBy("v").agg(F.min(F.struct("k", "t")).alias("row"))
    wanted = roles.join(where, "v").select("row.k", "row.t", "g", "part", "role", "v")
    keyed = _keyed(docs)
    if roles.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:  # only texts that are asked for, and few others, are shuffled
        wanted = staged(wanted, "wanted")
        keyed = keyed.where(_may_be_among(wanted)("k", "t"))
    texts = keyed.join(wanted, ["k", "t"]).select("g", "part", "role", "v", "text")
    dealt = texts.repartition(partitions(docs.sparkSession), "g", "part").sortWithinPartitions("g", "part", "role")
    found = staged(dealt.mapInPandas(_verify, "u bigint, v bigint, state int, pivoted boolean"), "verified")
    release(roles, wanted)
    return found


def _heavy_links(docs: DataFrame, sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray], weights: np.ndarray, light: int) -> DataFrame:
    lists = _lists(_entries(docs, frequent, weights, light))
    crowded = _crowded(lists._cold, light)
    clusters = crowded.where("many").select(F.col("u").alias("g"), "v", "n")
    long = staged(_long(lists._hot).unionByName(clusters).distinct(), "long")
    met = _pairs(lists, light).unionByName(crowded.where("not many").select("u", "v")).distinct()
    pairs = _near_pairs(met, sets).select(F.col("u").alias("g"), "v")
    found = _verified(docs, sets, _parted(pairs, MEMBER).unionByName(_parted(long.select("g", "v"), PIVOTED)))
    release(*lists._parts, crowded)
    links = found.where(F.col("state") == LINKED).select("u", "v")
    if not long.limit(1).count():
        return links
    states = found.where("pivoted").select(F.col("u").alias("g"), "v", "state")
    return links.unionByName(_verified(docs, sets, _blocks(long.join(states, ["g", "v"]))).select("u", "v"))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, with k and t, the key and the hash of its text, and its root set."""
    sets = sets_of(docs)
    small = sets.where(F.col("n").between(1, MOST_LIGHT * 2)).groupBy("n").agg(F.countDistinct("v").alias("c")).collect()
    longer = sets.where(F.col("n") > MOST_LIGHT * 2).agg(F.coalesce(F.sum(F.floor(F.col("n") / 5) + 1), F.lit(0)).alias("c")).first()
    light = choose_light({r.n: r.c for r in small}, longer.c)
    total = sets.count()
    frequent, weights = frequent_shingles(docs, total), word_weights(docs, total)
    links = _light_links(sets, light).unionByName(_heavy_links(docs, sets, frequent, weights, light))
    roots = components(links)
    distinct = sets.groupBy("v").agg(F.min("k").alias("low"))
    by_root = distinct.join(roots.withColumnRenamed("u", "v"), "v", "left").select("v", "low", F.coalesce("root", "v").alias("root"))
    lowest = by_root.groupBy("root").agg(F.min("low").alias("component"))
    named = by_root.join(lowest, "root").select("v", "component", "root")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k"))
    real = lambda c: F.when(c != _NONE, c)
    return sets.join(named, "v").select(real(F.col("k")).alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), real(component).alias("component_id"), "k", "t", "root")


def _by_keys(docs: DataFrame, keys: DataFrame, kept: bool) -> DataFrame:
    """docs with _k and _t, of rows whose (k, t) is among the keys, if they are kept, or of all others. Texts of the others
    stay where they are: few keys are broadcast, and with many only rows that may be among them are shuffled."""
    keys = staged(keys.select(F.col("k").alias("_k"), F.col("t").alias("_t")), "keys")
    how = "left_semi" if kept else "left_anti"
    if keys.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(keys), ["_k", "_t"], how)
    among = _may_be_among(keys, "_k", "_t")("_k", "_t")
    found = docs.where(among).join(keys, ["_k", "_t"], how)
    return found if kept else docs.where(~among).unionByName(found.select(*[F.col(f"`{c}`") for c in docs.columns]))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each component, of the smallest doc_id; documents without shingles all stay."""
    names = docs.columns
    found = staged(join_components(docs).where("n_shingles > 0").select("k", "t", "root"), "components")
    first = found.groupBy("root").agg(F.min(F.struct("k", "t")).alias("first"))
    others = found.join(first, "root").where((F.col("k") != F.col("first.k")) | (F.col("t") != F.col("first.t"))).select("k", "t").distinct()
    keyed = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NONE))).withColumn("_t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = _by_keys(keyed, others, False)
    again = found.groupBy("k", "t").count().where("count > 1").select("k", "t")
    if again.limit(1).count():  # rows that repeat key and text
        twice = _by_keys(kept, again, True).dropDuplicates(["_k", "_t"])
        kept = _by_keys(kept, again, False).unionByName(twice.select(*[F.col(f"`{c}`") for c in kept.columns]))
    return kept.select(*[F.col(f"`{c}`") for c in names])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
