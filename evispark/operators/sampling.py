"""Samplers, splits and packings. Seeds order rows by a hash, so every engine draws the same."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.numeric import seeded, unit_interval


def per_stratum(rows: DataFrame, strata: list[str], key: str, n: int | Column, seed: int) -> DataFrame:
    """n rows of each stratum; ranks are cut before the shuffle."""
    order = Window.partitionBy(*strata).orderBy(seeded(seed, F.col(key)), key)
    return rows.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def head_then_sample(rows: DataFrame, order: list[Column], key: str, n: int, seed: int) -> DataFrame:
    """Of the best 3 n rows, n by a seeded hash."""
    return rows.orderBy(*order).limit(3 * n).orderBy(seeded(seed, F.col(key)), key).limit(n)


def two_strata(rows: DataFrame, first: Column, key: str, n: int, share: float, seed: int) -> DataFrame:
    """A share of n from the rows where `first` holds and the remainder from the others; each side's ranks are cut in every
    task, so n rows a task are all that moves."""
    of_first, order = round(n * share), [seeded(seed, F.col(key)), F.col(key)]
    holds = F.coalesce(first, F.lit(False))
    return rows.where(holds).orderBy(*order).limit(of_first).unionByName(rows.where(~holds).orderBy(*order).limit(n - of_first))


def even_quota(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows, the same number of each group; what is left over goes round the groups, in order, while they have rows."""
    groups = rows.select(group).distinct().count()
    base, extra = divmod(n, max(1, groups))
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    # one row more of each group is all that a round can hand out; short groups pass theirs on
    near = ranked.where(F.col("_nth") <= base + extra + n)
    full = near.where(F.col("_nth") <= base)
    short = n - full.count()
    rest = near.where(F.col("_nth") > base).orderBy("_nth", group, key).limit(short)
    return full.unionByName(rest).drop("_nth")


def weighted_order(rows: DataFrame, strata: str, key: str, alpha: float, seed: int) -> DataFrame:
    """Draws without replacement whose chance goes with a stratum's size to the power alpha: smaller `draw` comes first."""
    sizes = rows.groupBy(F.col(strata).alias("_s")).agg(F.count("*").alias("_size"))
    weight = F.pow(F.col("_size").cast("double"), F.lit(alpha)) / F.col("_size")
    u = unit_interval(seeded(seed, F.col(key)))
    return rows.join(sizes, F.col(strata).eqNullSafe(F.col("_s"))).withColumn("draw", -F.log(F.greatest(u, F.lit(1e-12))) / weight).drop("_s", "_size")


def _placed(rows: DataFrame, cells: list[str], key: str, seed: int) -> DataFrame:
    """rows with _nth, their place in their cell by a seeded hash, and _n, the cell's size; a cell may span many tasks."""
    from evispark.operators.windows import running

    hashed = rows.withColumn("_h", seeded(seed, F.col(key)))
    ranked = running(hashed, cells, ["_h", key], {"_nth": F.lit(1)}).drop("_h")
    sizes = rows.groupBy(*[F.col(c).alias(f"_c_{c}") for c in cells]).agg(F.count("*").alias("_n"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in cells])
    return ranked.join(sizes, same).drop(*[f"_c_{c}" for c in cells])


def subset_epochs(rows: DataFrame, strata: str, key: str, fraction: float, epochs: int, seed: int) -> DataFrame:
    """Each epoch takes the same fraction of every stratum, going on where the last one ended, and interleaves the strata."""
    base = _placed(rows, [strata], key, seed).withColumn("_i", F.col("_nth") - 1).drop("_nth").withColumn("_take", F.greatest(F.lit(1), F.floor(F.col("_n") * fraction + 0.5)))
    each = base.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = F.pmod(F.col("_i") - F.col("epoch") * F.col("_take"), F.col("_n"))
    u = unit_interval(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(strata).cast("string")), 256))
    return each.withColumn("_place", place).where(F.col("_place") < F.col("_take")).withColumn("position", (F.col("_place") + u) / F.col("_take")).drop("_i", "_n", "_take", "_place")


def quota_split(rows: DataFrame, cells: list[str], key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """Each cell's rows, in seeded order, dealt to the splits by their shares, rounded half up; the first takes the rest."""
    ranked = _placed(rows, cells, key, seed)
    names = list(shares)
    split, below = F.lit(names[0]), F.lit(0)
    for name in names[1:]:
        upper = below + F.floor(F.col("_n") * shares[name] + 0.5)
        split = F.when((F.col("_nth") > below) & (F.col("_nth") <= upper), name).otherwise(split)
        below = upper
    return ranked.withColumn("split", split).drop("_nth", "_n")


def search_split(groups: DataFrame, cells: list[str], quotas: dict[tuple, dict[str, int]], trials: int, seed: int) -> DataFrame:
    """Group-disjoint split: trials of seeded group orders, dealt greedily to exact quotas of each cell; the trial of the
    smallest penalty wins. groups: group_id, size and the cell columns; their number is what a driver can hold."""
    table = groups.select("group_id", "size", *cells).toPandas().sort_values("group_id").reset_index(drop=True)
    spark = groups.sparkSession

    def deal(trial: int) -> tuple[float, list[str]]:
        rng = np.random.default_rng([seed, trial])
        left = {cell: dict(q) for cell, q in quotas.items()}
        split = [""] * len(table)
        for i in rng.permutation(len(table)):
            cell = tuple(table.loc[i, cells])
            names = [n for n, k in left.get(cell, {}).items() if k >= table.loc[i, "size"]]
            split[i] = max(names, key=lambda n: left[cell][n]) if names else "train"
            if names:
                left[cell][split[i]] -= int(table.loc[i, "size"])
        return float(sum(k * k / (quotas[c][n] + 1) for c, q in left.items() for n, k in q.items())), split

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"trial": batch.id, "penalty": [deal(int(t))[0] for t in batch.id]})

    best = spark.range(trials).mapInPandas(run, "trial bigint, penalty double").orderBy("penalty", "trial").first()
    out = table[["group_id"]].assign(split=deal(best.trial)[1], trial=best.trial, penalty=best.penalty)
    return spark.createDataFrame(out)


def split_faults(rows: DataFrame, key: str, all_keys: DataFrame) -> DataFrame:
    """(fault, n): keys in two splits, keys without a split, keys that aren't known."""
    twice = rows.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.lit("overlap").alias("fault"), F.count("*").alias("n"))
    missing = all_keys.join(rows, key, "left_anti").agg(F.lit("missing").alias("fault"), F.count("*").alias("n"))
    unknown = rows.join(all_keys, key, "left_anti").agg(F.lit("unknown").alias("fault"), F.count("*").alias("n"))
    return twice.unionByName(missing).unionByName(unknown)


def longest_first(rows: DataFrame, batch: str, key: str, cost: str, shards: int) -> DataFrame:
    """Within each batch, the longest row to the shard with the least so far. A batch is what one step holds."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        load = np.zeros(shards)
        shard = []
        pdf = pdf.sort_values([cost, key], ascending=[False, True])
        for c in pdf[cost]:
            at = int(load.argmin())
            load[at] += c
            shard.append(at)
        return pdf.assign(shard=np.array(shard, np.int32))[[batch, key, cost, "shard"]]

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (batch, key, cost)) + ", shard int"
    return rows.select(batch, key, cost).groupBy(batch).applyInPandas(deal, schema)


def next_fit(rows: DataFrame, batch: str, key: str, length: str, capacity: int) -> DataFrame:
    """Within each batch, in order of length, a row joins the open pack if it fits, and opens the next one if not."""
    types = dict(rows.dtypes)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key])
        packs, used, at = [], 0, 0
        for n in pdf[length]:
            if used and used + n > capacity:
                used, at = 0, at + 1
            used += n
            packs.append(at)
        return pdf.assign(pack=np.array(packs, np.int32))[[batch, key, length, "pack"]]

    schema = ", ".join(f"`{c}` {types[c]}" for c in (batch, key, length)) + ", pack int"
    return rows.select(batch, key, length).groupBy(batch).applyInPandas(pack, schema)


def stride_minibatches(rows: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """Rows in seeded order, every m-th to the same minibatch. The order is ranked in ranges of its hash."""
    from evispark.operators.windows import global_rank

    hashed = rows.withColumn("_h", seeded(seed, F.col(key)))
    hashed = hashed.withColumn("_h8", F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"))
    return global_rank(hashed, ["_h8", "_h", key], "_rank").withColumn("mb", F.pmod(F.col("_rank") - 1, F.lit(m)).cast("int")).drop("_h", "_h8", "_rank")
