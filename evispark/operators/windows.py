"""Ordered folds over turns, items and samples, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disclosure_fold(turns: DataFrame, keys: list[str], order: str, ids: str, valid: Column, opening: Column | None = None) -> DataFrame:
    """Adds seen_before and fresh. Only valid turns disclose; what the opening holds is seen from the start."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    earlier = F.flatten(F.collect_list(F.when(valid, F.col(ids))).over(before))
    seen = F.array_distinct(F.concat(opening if opening is not None else none, F.coalesce(earlier, none)))
    out = turns.withColumn("seen_before", seen)
    return out.withColumn("fresh", F.when(valid, F.array_except(F.col(ids), F.col("seen_before"))).otherwise(none))


def rerequests(ids: Column, seen: Column) -> Column:
    """How many requested ids were seen, each as often as it is requested."""
    return F.size(F.filter(ids, lambda i: F.array_contains(seen, i)))


def previous(turns: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return turns.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def hypothesis_updates(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Turns with a call after a turn with a call or call errors: the pairs in which hypotheses are updated."""
    w = Window.partitionBy(*keys).orderBy(order)
    called = F.lag(F.col("call_ids").isNotNull() | (F.size(F.coalesce("call_errors", F.array().cast("array<string>"))) > 0)).over(w)
    pairs = turns.withColumn("_before", F.lag(F.struct(F.col(order), F.col("assistant"))).over(w)).withColumn("_called", called)
    return pairs.where(F.col("_called") & F.col("call_ids").isNotNull()).select(*turns.columns, F.col("_before.assistant").alias("before"))


def ledger_breaks(moves: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Moves whose state before isn't the one that the hypothesis was left in."""
    w = Window.partitionBy(*keys, "hypothesis").orderBy(order)
    return moves.withColumn("_left", F.lag("after").over(w)).where(F.col("_left").isNotNull() & (F.col("_left") != F.col("before"))).drop("_left")


def switches(rows: DataFrame, keys: list[str], order: str, value: str, none: str = "-") -> DataFrame:
    """How often a value changes from one row to the next; `none` on either side is no change."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    changed = (F.col(value) != before) & (F.col(value) != none) & (before != none)
    return rows.withColumn("_c", F.coalesce(changed, F.lit(False)).cast("bigint")).groupBy(*keys).agg(F.sum("_c").alias("switches"))


def standard_advantage(rows: DataFrame, group: list[str], reward: Column, scaled: bool = True) -> DataFrame:
    w = Window.partitionBy(*group)
    centred = reward - F.avg(reward).over(w)
    return rows.withColumn("advantage", centred / (F.stddev_pop(reward).over(w) + 1e-6) if scaled else centred)


def centre_by_decision(rows: DataFrame, group: list[str], decision: Column, total: Column, d: Column) -> DataFrame:
    """Within a group's decision the mean of what goes beyond the decision's own reward is taken off; undecided rows stay."""
    w = Window.partitionBy(*group, decision)
    return rows.withColumn("centred", F.when(decision.isNull(), total).otherwise(total - F.avg(total - d).over(w)))


def number_by_first_use(rows: DataFrame, within: list[str], key: str, order: list[str], group_no: str = "group_no", item_no: str = "item_no") -> DataFrame:
    """Groups numbered by their first row, rows numbered within their group."""
    own = Window.partitionBy(*within, key)
    first = F.min(F.struct(*order)).over(own)
    rank = F.dense_rank().over(Window.partitionBy(*within).orderBy("_first"))
    return rows.withColumn("_first", first).withColumn(group_no, rank).withColumn(item_no, F.row_number().over(own.orderBy(*order))).drop("_first")


def opening_record(items: DataFrame, within: str, order: str, wanted: Column, k: int) -> DataFrame:
    """The first k wanted items of each record, or its first item if none is wanted, numbered anew."""
    w = Window.partitionBy(within).orderBy(order)
    any_wanted = F.max(wanted.cast("int")).over(Window.partitionBy(within))
    nth_wanted = F.sum(wanted.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = items.withColumn("_any", any_wanted).withColumn("_nth", nth_wanted).withColumn("_row", F.row_number().over(w))
    chosen = (wanted & (F.col("_nth") <= k)) | ((F.col("_any") == 0) & (F.col("_row") == 1))
    return marked.where(chosen).withColumn("new_id", F.when(F.col("_any") == 1, F.col("_nth")).otherwise(1).cast("int")).drop("_any", "_nth", "_row")


def global_rank(rows: DataFrame, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """row_number over the whole table without one task for all of it: ranks within ranges of the first key, and each
    range's base. Bounds are quantiles of that key."""
    key = order[0]
    bounds = sorted({b for b in rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)])).first()[0] or []})

    def dealt(low: int, high: int) -> Column:
        """How many bounds lie below the key, by halves."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) > F.lit(bounds[middle]), dealt(middle + 1, high)).otherwise(dealt(low, middle))

    ranged = rows.withColumn("_range", dealt(0, len(bounds)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return ranged.withColumn("_within", within).join(F.broadcast(sizes.select("_range", base.alias("_base"))), "_range").withColumn(name, (F.col("_base") + F.col("_within")).cast("bigint")).drop("_range", "_within", "_base")


def running(rows: DataFrame, within: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums, in order, within groups of any size; a sum of ones is a row number. Rows are sorted into ranges
    by group and order, so a group may span many tasks: sums run within a range, and what a group's earlier ranges hold is
    added. Null groups are groups of their own."""
    from evispark.storage import partitions, staged

    spark = rows.sparkSession
    held = rows.select("*", *[v.alias(f"_v_{k}") for k, v in sums.items()]).repartitionByRange(partitions(spark), *within, *order)
    held = staged(held.withColumn("_range", F.spark_partition_id()), "ranges")  # so that a range is the same at every reading
    own = Window.partitionBy("_range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = held.select("*", *[F.sum(f"_v_{k}").over(own).alias(f"_own_{k}") for k in sums])
    # a row for each range and each group within it
    totals = held.groupBy("_range", *within).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g_{c}") for c in within], *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_base_{k}") for k in sums])
    same = F.col("_range") == F.col("_r")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return inner.join(bases, same).select(*rows.columns, *[(F.col(f"_own_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])


def before(rows: DataFrame, within: str, key: str, columns: list[str]) -> DataFrame:
    """rows with `prev_` columns of the row before, by key, in a group of any size; first rows are left out. Keys are unique.
    Only keys are sorted; the columns are fetched by key."""
    nth = running(rows.select(within, key), [within], [key], {"_nth": F.lit(1)})
    last = nth.select(F.col(within).alias("_w"), F.col(key).alias("_key"), (F.col("_nth") + 1).alias("_n"))
    pairs = nth.join(last, (F.col("_nth") == F.col("_n")) & F.col(within).eqNullSafe(F.col("_w"))).select(key, "_key")
    earlier = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return rows.join(pairs, key).join(earlier, "_key").drop("_key")


def adjacent_pairs(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """The shortest row goes; the next two are a pair, and so on. A last single row goes too."""
    ranked = global_rank(rows, order, "_rank").where("_rank > 1").withColumn("pair_no", F.floor((F.col("_rank") - 2) / 2).cast("bigint"))
    side = F.col("_rank") % 2 == 0
    return ranked.groupBy("pair_no").agg(F.max(F.when(side, F.col(key))).alias("left_id"), F.max(F.when(~side, F.col(key))).alias("right_id")).where("left_id IS NOT NULL AND right_id IS NOT NULL")


def next_section(lines: DataFrame, keys: list[str], line_no: str, heading: Column) -> DataFrame:
    """Lines with the number of the heading they stand under, 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(heading.cast("int")).over(w))


def first_hit(requests: DataFrame, keys: list[str], order: str, hit: Column) -> DataFrame:
    """The place of the first request that hits, from 1, and what an early hit earns."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    out = requests.withColumn("_nth", nth).groupBy(*keys).agg(F.min(F.when(hit, F.col("_nth"))).alias("first_hit"))
    return out.withColumn("k_time", F.coalesce(F.greatest(F.lit(0.0), (5 - F.col("first_hit")) / 4), F.lit(0.0)))


def removal_levels(items: DataFrame, case: str, key: str, seed: int) -> DataFrame:
    """Rows (case, level, key): nested removals of 40, 75 and 100 % of each case's items, in one seeded order."""
    from evispark.functions.numeric import seeded

    order = Window.partitionBy(case).orderBy(seeded(seed, F.col(key)), key)
    ranked = items.withColumn("_nth", F.row_number().over(order)).withColumn("_k", F.count("*").over(Window.partitionBy(case)))
    k = F.col("_k")
    n75 = F.greatest(F.lit(1), F.floor(k * 0.75 + 0.5))
    n75 = F.when(k >= 3, F.least(n75, k - 1)).otherwise(n75)
    n40 = F.greatest(F.lit(1), F.floor(k * 0.40 + 0.5))
    n40 = F.when(k >= 3, F.least(n40, n75 - 1)).otherwise(n40)
    levels = F.array(F.struct(F.lit("level_040").alias("level"), n40.alias("n")), F.struct(F.lit("level_075").alias("level"), n75.alias("n")), F.struct(F.lit("level_100").alias("level"), k.alias("n")))
    return ranked.select(case, key, "_nth", F.explode(levels).alias("_l")).where(F.col("_nth") <= F.col("_l.n")).select(case, F.col("_l.level").alias("level"), key)
