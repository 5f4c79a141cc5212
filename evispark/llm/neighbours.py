"""Approximate nearest neighbours by adaptive dimension scan in probed lists.

Centres are fitted on a bounded sample; every vector is indexed in its nearest list. A list of over SPLIT vectors is
divided again, into cells around centres fitted on a sample of its own, so that cells keep their size while the table
grows. A query meets its nearest cells, as many as a sample's own neighbours ask for and at least as hold k + 1 vectors.

Vectors are rotated by one random orthogonal matrix and laid out in column blocks of BLOCK dimensions. Within a probed
cell, a candidate's partial squared distance over the first d of D rotated dimensions, scaled by D / d, is held against
a bound on the query's k-th distance: a candidate beyond (1 + EPSILON / sqrt(d)) of it is given up, by the test that a
random rotation makes valid. The bound comes from the first vectors of a cell and, for all cells but a query's nearest,
from what that one gave. What survives is ranked by the exact double-precision distance of the original vectors.

Equal vectors are one class: only its k + 1 smallest ids can be among anyone's k nearest, so the class keeps these and
nothing is lost. Cells of more than CHUNK vectors are scanned in chunks, so a hot cell is many tasks of bounded size.

Null vectors, zero vectors, those of another length than most, and those with null or non-finite components take no
part, neither do rows without id. Ids that repeat are rows of their own: each is a query by itself, and a query leaves
out its own row alone. With fewer than k other vectors a query gets all of them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors that the centres are fitted on, and their bytes, at most.
SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: Vectors in a list, or in a cell of a divided one, about.
LIST = 1000
#: Lists at most; their centres are the only thing that is sent to all executors.
LISTS = 4096
#: Lists of more vectors are divided, into CELLS cells at most.
SPLIT = 4 * LIST
CELLS = 1024
#: Vectors of a divided list that a task deals to its cells, about, and queries that a task holds against its centres.
DEAL = 8192
#: Share of true neighbours that the probed cells should hold, as a sample's own neighbours tell.
HELD = 0.97
#: Queries of the sample by which the number of probed cells is chosen, and lists that these look into at most.
TRIALS = 200
MOST_LISTS = 256
BLOCK = 16
EPSILON = 2.1
#: Vectors in a chunk of a cell, about.
CHUNK = 2048
SEED = 11


def usable(column: Column) -> Column:
    """A vector of finite components, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def fit_centres(x: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """k-means by Lloyd's rounds; an empty list starts anew at a random vector."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= lists:
        return x
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        nearest = (centres @ x.T * -2 + (centres**2).sum(axis=1)[:, None]).argmin(axis=0)
        counts = np.bincount(nearest, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), lists)])
    return centres


def choose_probes(x: np.ndarray, centres: np.ndarray, k: int, held: float = HELD) -> int:
    """As many lists, nearest first, as hold that share of the k nearest of TRIALS sampled vectors within the sample.
    Neighbours in a sample are further off than in the whole table, so the number is rather too large than too small."""
    if not len(x):
        return 1
    asked = x[np.random.default_rng(SEED).permutation(len(x))[:TRIALS]]
    norms, own = (centres**2).sum(axis=1), (x**2).sum(axis=1)
    lists = (x @ centres.T * -2 + norms).argmin(axis=1)
    near = np.argsort(asked @ x.T * -2 + own, axis=1, kind="stable")[:, : k + 1]
    place = np.argsort(np.argsort(asked @ centres.T * -2 + norms, axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(held * len(ranks))))]) + 1


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scan(query: np.ndarray, blocks: list[np.ndarray], k: int, bound: float) -> tuple[np.ndarray, int]:
    """Rows that no block gave up, and how many row-blocks were read. bound: squared distance of the k-th so far."""
    alive = np.arange(blocks[0].shape[0])
    partial, done, read = np.zeros(len(alive)), 0, 0
    total = sum(b.shape[1] for b in blocks)
    for b in blocks:
        read += len(alive)
        width = b.shape[1]
        partial += ((b[alive] - query[done : done + width]) ** 2).sum(axis=1)
        done += width
        if done < total and np.isfinite(bound):
            ok = partial * (total / done) <= bound * (1 + EPSILON / np.sqrt(done)) ** 2
            alive, partial = alive[ok], partial[ok]
        if not len(alive):
            break
    return alive, read


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, less the rows' own norms."""
    return x @ centres.T * -2 + (centres**2).sum(axis=1)


def _digest() -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64("v").alias("d1"), F.xxhash64(F.lit("v"), "v").alias("d2")]


@dataclass
class Index:
    rows: DataFrame  # id, v, list, cell, chunk
    cells: DataFrame  # list, cell, n, chunks
    inner: DataFrame | None  # list, centres (of its cells, one after the other), of divided lists
    centres: np.ndarray
    sizes: dict[int, int]  # vectors by list
    dimensions: int
    probes: int
    k: int


def _divide(dealt: DataFrame, sizes: dict[int, int], dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of divided lists with their cells, and the centres of the cells."""
    divided = F.col("list").isin([n for n, size in sizes.items() if size > SPLIT])
    first = F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("id"), "id"))
    sample = dealt.where(divided).withColumn("nth", first).where(F.col("nth") <= 8 * CELLS).drop("nth")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["list"].iloc[0])
        cells = max(1, min(CELLS, len(rows) // 8, -(-sizes[number] // LIST)))
        return pd.DataFrame({"list": [number], "centres": [fit_centres(np.stack(rows.sort_values("id").v.to_numpy()), cells).ravel()]})

    inner = staged(sample.groupBy("list").applyInPandas(fit, "list int, centres array<double>"), "cells")
    parts = F.ceil(F.col("size") / DEAL).cast("int")
    spark = dealt.sparkSession
    known = spark.createDataFrame([(n, size) for n, size in sizes.items() if size > SPLIT], "list int, size bigint")
    centres = inner.join(F.broadcast(known), "list").select("list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "centres")  # a row for each list
    rows = dealt.join(F.broadcast(known), "list").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")).drop("size")

    def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left[["id", "v", "list"]].assign(cell=np.empty(0, np.int32))
        m = np.asarray(right.centres.iloc[0]).reshape(-1, dimensions)
        return left[["id", "v", "list"]].assign(cell=_nearest(np.stack(left.v.to_numpy()), m).argmin(axis=1).astype(np.int32))

    return rows.groupBy("list", "part").cogroup(centres.groupBy("list", "part")).applyInPandas(deal, "id bigint, v array<double>, list int, cell int"), inner


def build(vectors: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding") -> Index:
    """The staged index of every usable vector's class, its centres, and how many cells to probe."""
    spark = vectors.sparkSession
    v = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimensions, total = (found[0]["d"], found[0]["count"]) if found else (1, 0)
    rows = rows.where(F.size("v") == dimensions)
    # only the smallest ids of a class of equal vectors can be among the nearest; ranks are cut before the shuffle
    equal = Window.partitionBy("d1", "d2").orderBy("id")
    rows = rows.select("id", "v", *_digest()).withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k + 1).select("id", "v")
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dimensions)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").toArrow().column("v").combine_chunks()
    x = np.asarray(sample.flatten(), np.float64).reshape(-1, dimensions)
    lists = int(min(max(1, total // LIST), LISTS, max(1, len(x) // 8)))
    centres = fit_centres(x, lists) if len(x) else np.zeros((1, dimensions))
    told = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(list=_nearest(np.stack(batch.v.to_numpy()), told.value).argmin(axis=1).astype(np.int32))

    dealt = staged(rows.mapInPandas(deal, "id bigint, v array<double>, list int"), "vectors")
    sizes = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # a row for each list
    inner = None
    if any(size > SPLIT for size in sizes.values()):
        divided, inner = _divide(dealt, sizes, dimensions)
        whole = dealt.where(~F.col("list").isin([n for n, size in sizes.items() if size > SPLIT]))
        dealt = staged(whole.withColumn("cell", F.lit(0)).unionByName(divided), "vectors")
    else:
        dealt = dealt.withColumn("cell", F.lit(0))
    cells = staged(dealt.groupBy("list", "cell").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "cells")
    chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")).cast("int")
    indexed = dealt.join(cells, ["list", "cell"]).select("id", "v", "list", "cell", chunk.alias("chunk"))
    index = Index(indexed, cells, inner, centres, sizes, dimensions, choose_probes(x, centres, k), k)
    if inner is not None:
        index.probes = measured_probes(index, x)
    return index


def measured_probes(index: Index, x: np.ndarray) -> int:
    """As many cells, nearest first, as hold the share HELD of the k nearest of TRIALS sampled vectors in the whole table,
    which is scanned for them once. Cells beyond the MOST_LISTS nearest lists count as beyond all."""
    spark, k = index.rows.sparkSession, index.k
    asked = x[np.random.default_rng(SEED).permutation(len(x))[:TRIALS]]
    told = spark.sparkContext.broadcast(asked)

    def scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest of a task for each trial."""
        trials = told.value
        norms, d, where = (trials**2).sum(axis=1), np.empty((0, len(trials))), np.empty((0, len(trials), 2), np.int32)
        for batch in batches:
            if len(batch):
                m = np.stack(batch.v.to_numpy())
                here = np.broadcast_to(batch[["list", "cell"]].to_numpy(np.int32)[:, None], (len(m), len(trials), 2))
                d, where = np.concatenate([d, m @ trials.T * -2 + norms + (m**2).sum(axis=1)[:, None]]), np.concatenate([where, here])
                near = np.argsort(d, axis=0, kind="stable")[: k + 1]
                d, where = np.take_along_axis(d, near, 0), np.take_along_axis(where, near[..., None], 0)
        yield pd.DataFrame({"uid": np.tile(np.arange(len(trials)), len(d)), "list": where[..., 0].ravel(), "cell": where[..., 1].ravel(), "d": d.ravel()})

    found = index.rows.select("v", "list", "cell").mapInPandas(scan_all, "uid bigint, list int, cell int, d double")
    best = F.row_number().over(Window.partitionBy("uid").orderBy("d", "list", "cell"))
    true = found.withColumn("_r", best).where(F.col("_r") <= k + 1).select("uid", "list", "cell")
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(asked)], "uid bigint, v array<double>")
    ranked = _targets(replace(index, probes=min(MOST_LISTS, len(index.sizes))), queries, every=True)
    ranks = true.join(ranked, ["uid", "list", "cell"], "left").select(F.coalesce("nth", F.lit(1 << 30)).alias("nth")).toPandas().nth.to_numpy()
    wanted = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(HELD * len(ranks))))]) if len(ranks) else 1
    return min(wanted, MOST_LISTS * CELLS)


def _targets(index: Index, queries: DataFrame, every: bool = False) -> DataFrame:
    """(uid, list, cell, chunks, nth): the cells that each query meets, nearest first, or every cell of the probed lists."""
    spark, probes, k = queries.sparkSession, index.probes, index.k
    most = CELLS if every else max(probes, k + 1)
    filled = np.array(sorted(index.sizes), np.int32)
    told = spark.sparkContext.broadcast((filled, index.centres[filled], np.array([index.sizes[n] for n in filled.tolist()], np.int64)))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, centres, sizes = told.value
        for batch in batches:
            if len(batch) and len(names):
                d = _nearest(np.stack(batch.v.to_numpy()), centres)
                order = np.argsort(d, axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < k + 1).sum(axis=1) + 1
                n = np.minimum(np.maximum(enough, probes), len(names))
                rows, at = np.repeat(np.arange(len(batch)), n), np.concatenate([o[:m] for o, m in zip(order, n)])
                yield pd.DataFrame({"uid": batch.uid.to_numpy()[rows], "list": names[at], "cell": np.int32(0), "d": d[rows, at]})

    near = queries.select("uid", "v").mapInPandas(probe, "uid bigint, list int, cell int, d double")
    if index.inner is not None:
        divided, dimensions = F.col("list").isin([n for n, size in index.sizes.items() if size > SPLIT]), index.dimensions
        near = staged(near, "probes")
        asked = near.where(divided).select("uid", "list").join(queries.select("uid", "v"), "uid")
        parts = near.where(divided).groupBy("list").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("parts"))
        asked = asked.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")
        centres = index.inner.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centres")

        def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"uid": np.empty(0, np.int64), "list": np.empty(0, np.int32), "cell": np.empty(0, np.int32), "d": np.empty(0)})
            d = _nearest(np.stack(left.v.to_numpy()), np.asarray(right.centres.iloc[0]).reshape(-1, dimensions))
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            rows = np.repeat(np.arange(len(left)), order.shape[1])
            return pd.DataFrame({"uid": left.uid.to_numpy()[rows], "list": left["list"].to_numpy()[rows], "cell": order.ravel().astype(np.int32), "d": d[rows, order.ravel()]})

        inner = asked.groupBy("list", "part").cogroup(centres.groupBy("list", "part")).applyInPandas(choose, "uid bigint, list int, cell int, d double")
        near = near.where(~divided).unionByName(inner)
    by_distance = Window.partitionBy("uid").orderBy("d", "list", "cell")
    before = F.coalesce(F.sum("n").over(by_distance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = near.join(index.cells, ["list", "cell"]).withColumn("nth", F.row_number().over(by_distance)).withColumn("before", before)
    return staged(ranked.where(F.lit(every) | (F.col("nth") <= probes) | (F.col("before") < k + 1)).select("uid", "list", "cell", "chunks", "nth"), "targets")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """queries: id, v. The k nearest of each one, as query_id, rank, vec_id, score."""
    k, dimensions = index.k, index.dimensions
    edges = [(a, min(a + BLOCK, dimensions)) for a in range(0, dimensions, BLOCK)]
    several = queries.select("id", "v", *_digest()).groupBy("id", "d1", "d2").agg(F.first("v").alias("v"), F.count("*").cast("int").alias("copies"))
    queries = staged(several.select(F.xxhash64("id", "d1", "d2").alias("uid"), "id", "v", "copies"), "queries")
    targets = _targets(index, queries)
    told = queries.sparkSession.sparkContext.broadcast(rotation(dimensions))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"uid": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        right = right.sort_values("id", kind="stable")
        turn = told.value
        ids, m = right["id"].to_numpy(), np.stack(right.v.to_numpy())
        turned = m @ turn
        blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in edges]
        found = []
        for uid, v, bound in zip(left["uid"].to_numpy(), left.v.to_numpy(), left.bound.to_numpy()):
            rotated = v @ turn
            if len(ids) > k:  # another bound, from as many candidates as could be the answer, in full
                first = ((turned[: 4 * k] - rotated) ** 2).sum(axis=1)
                bound = min(bound, np.partition(first, k)[k])
            alive, _ = scan(rotated, blocks, k, bound)
            exact = np.sqrt(((m[alive] - v) ** 2).sum(axis=1))
            best = np.lexsort((ids[alive], exact))[: k + 1]
            found.append((np.full(len(best), uid), ids[alive][best], exact[best]))
        uid, vec_id, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"uid": uid, "vec_id": vec_id, "score": score})

    def scanned(targets: DataFrame, bounds: DataFrame | None) -> DataFrame:
        asked = targets.join(queries.select("uid", "v"), "uid")
        asked = asked.withColumn("bound", F.lit(float("inf"))) if bounds is None else asked.join(bounds, "uid", "left").fillna(float("inf"), "bound")
        asked = asked.select("uid", "v", "bound", "list", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        keys = ["list", "cell", "chunk"]
        return asked.groupBy(*keys).cogroup(index.rows.groupBy(*keys)).applyInPandas(look, "uid bigint, vec_id bigint, score double")

    nearest = staged(scanned(targets.where("nth = 1"), None), "nearest")
    by_score = Window.partitionBy("uid").orderBy("score", "vec_id")
    kth = nearest.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") == k + 1)
    # a little more than the distance itself, which the rotation may change in its last digits
    bounds = kth.select("uid", (F.col("score") * F.col("score") * (1 + 1e-9)).alias("bound"))
    near = nearest.unionByName(scanned(targets.where("nth > 1"), bounds))
    near = near.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1).join(queries.select("uid", "id", "copies"), "uid")
    # the query's own row is the first of its id at no distance
    own = (F.col("vec_id") == F.col("id")) & (F.col("score") == 0)
    others = near.withColumn("own", F.min(F.when(own, F.col("nth"))).over(Window.partitionBy("uid"))).where("own IS NULL OR nth <> own")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("score", "vec_id"))
    ranked = others.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build(vectors)
    v = F.col("embedding").cast("array<double>")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v"))
    return search(index, queries.where(usable(F.col("v")) & (F.size("v") == index.dimensions)))
