"""Reports to evidence packages: routing, verification, near-duplicates, sources, review and assembly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import contains_quote, coverage, norm, overlap, words
from evispark.storage import release, small_batches, staged

MOST_ALIKE = 0.88
#: Rows of keys that may be broadcast.
BROADCAST_ROWS = 300_000


def label_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """A declared role counts before the labelled one; a block with neither is appendix."""
    return blocks.join(labels.select("case_id", "block_idx", "label_role"), ["case_id", "block_idx"], "left").withColumn("role", F.coalesce("role", "label_role", F.lit("appendix"))).drop("label_role")


def route_texts(blocks: DataFrame) -> DataFrame:
    """(case_id, analysis, conclusion, status): joined texts; without conclusion blocks, those whose heading says so, and
    without these the last 4000 characters."""
    ordered = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("block_idx", "text")))), lambda s: s["text"]), "\n\n")
    role = F.col("role")
    hint = F.lower("label").rlike("conclusion|finding|cause|closing")
    grouped = blocks.groupBy("case_id").agg(ordered(role.isin("analysis", "mixed")).alias("analysis"), ordered(role == "conclusion").alias("_c"), ordered(hint).alias("_h"), ordered(F.lit(True)).alias("_all"))
    last = F.substring("_all", F.greatest(F.length("_all") - 3999, F.lit(1)), F.lit(4000))
    conclusion = F.when(F.col("_c") != "", F.col("_c")).when(F.col("_h") != "", F.col("_h")).otherwise(last)
    status = F.when(F.col("_c") != "", "declared").when(F.col("_h") != "", "by_heading").otherwise("by_position")
    return grouped.select("case_id", "analysis", conclusion.alias("conclusion"), status.alias("status"))


def verify_items(items: DataFrame, sources: DataFrame, key: list[str], least_overlap: float = 0.6) -> DataFrame:
    """Items with quote_found, overlap and accepted, against the text of their block."""
    both = items.join(sources.select(*key, F.col("text").alias("_source")), key)
    normed = both.withColumn("_quote", norm("quote")).withColumn("_item", words(norm("text"))).withColumn("_src", norm("_source"))
    normed = normed.withColumn("_pool", F.array_distinct(words(F.col("_src"))))
    out = normed.withColumn("quote_found", contains_quote(F.col("_src"), F.col("_quote"))).withColumn("overlap", overlap(F.col("_item"), F.col("_pool")))
    return out.withColumn("accepted", F.col("quote_found") | (F.col("overlap") >= least_overlap)).drop("_source", "_quote", "_item", "_src", "_pool")


def enough_items(items: DataFrame, least: int = 10) -> DataFrame:
    """(case_id, items): cases with so many accepted items or more; the others don't make a package."""
    return items.where("accepted").groupBy("case_id").agg(F.count("*").alias("items")).where(F.col("items") >= least)


def block_coverage(items: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Share of each block's words that its items hold."""
    pool = items.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list(words(norm("text"))))).alias("_pool"))
    return sources.join(pool, key, "left").select(*key, coverage(F.coalesce("_pool", F.array().cast("array<string>")), words(norm("text"))).alias("coverage"))


def near_duplicates(items: DataFrame, case: str, order: str, text: str, threshold: float = MOST_ALIKE, normed: bool = True) -> DataFrame:
    """(case, order, dropped): in order, nulls last, an item whose word set is that alike to a kept one goes; sets under
    three words always stay. Only kept items drop others. Of equal sets in a case the first decides for all, so alike
    pairs are looked for among distinct sets, and only those that have one are resolved."""
    w = words(norm(text) if normed else F.lower(text))
    bag = F.coalesce(F.array_sort(F.array_distinct(w)), F.array().cast("array<string>"))
    named = items.select(case, order, bag.alias("_bag")).withColumn("_n", F.size("_bag")).withColumn("_set", F.xxhash64(F.col(case).isNull(), case, "_n", "_bag"))
    place = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"))
    bags = staged(named.withColumn("_place", place), "bags")
    firsts = staged(bags.groupBy("_set").agg(F.min("_place").alias("_first")), "firsts")
    sets = bags.join(firsts, "_set").where(F.col("_place") == F.col("_first")).select("_set", F.col(case).alias("_case"), "_first", "_n", "_bag")
    sets = staged(sets, "sets")
    links, parts = _alike_sets(sets, threshold)
    gone = _followers(links)
    release(sets, *parts)
    decided = firsts.join(gone.select(F.col("v").alias("_set"), F.lit(True).alias("_gone")), "_set", "left")
    again = F.row_number().over(Window.partitionBy("_set", "_place").orderBy("_n")) > 1  # items that repeat set and order
    out = bags.select(case, order, "_n", "_set", "_place").withColumn("_again", again).join(decided, "_set")
    dropped = (F.col("_n") >= 3) & (F.col("_gone").isNotNull() | F.col("_again") | (F.col("_place") != F.col("_first")))
    return out.select(case, order, dropped.alias("dropped"))


def _levels(threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each level, and its parts: sets whose smaller one is of the level differ in fewer words than these."""
    least, parts = [1], []
    while least[-1] <= most:
        top = math.floor(least[-1] / threshold + 1e-9)
        parts.append(math.floor((1 - threshold) / threshold * top + 1e-9) + 1)
        least.append(top + 1)
    return np.array(least[: len(parts)], np.int64), np.array(parts, np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _alike_sets(sets: DataFrame, threshold: float) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(u, v): alike sets of a case, u before v; and the staged tables that this is read from. Alike sets differ in few words, so if all words are dealt by their hash to
    more parts than these, one part of both is equal, and they meet on it. Parts are as many as the smaller set's level
    asks for; the larger one is of that level or the next, so each set is dealt for its own level and the one below."""

    @F.pandas_udf("array<bigint>")
    def dealt(batch: pd.Series) -> pd.Series:
        least, parts = _levels(threshold, max(map(len, batch), default=0))
        held = []
        for hashes in batch:
            w = _mix(np.asarray(hashes, np.int64).view(np.uint64))
            own = int(np.searchsorted(least, len(w), "right")) - 1
            found = []
            for level in range(max(0, own - 1), own + 1):
                n = parts[level]
                sums = np.zeros(n, np.uint64)
                np.add.at(sums, (w >> np.uint64(20)) % np.uint64(n), w)
                found.append(_mix(sums + _mix(np.arange(n, dtype=np.uint64) + np.uint64((level + 1) << 32))))
            held.append(np.concatenate(found).view(np.int64))
        return pd.Series(held, index=batch.index, dtype=object)

    small_batches(sets.sparkSession)
    word = F.transform("_bag", lambda x: F.xxhash64(x))
    each = sets.where("_n > 0").select(F.xxhash64("_case").alias("_in"), "_set", "_n", F.explode(dealt(word)).alias("p"))
    met = each.select(F.xxhash64("_in", "p").alias("p"), "_set", "_n")
    a, b = (met.select("p", *[F.col(c).alias(f"{c}_{s}") for c in ("_set", "_n")]) for s in "ab")
    near = (F.col("_set_a") < F.col("_set_b")) & (F.least("_n_a", "_n_b") >= threshold * F.greatest("_n_a", "_n_b"))
    pairs = staged(a.join(b, "p").where(near).select(F.col("_set_a").alias("u"), F.col("_set_b").alias("v")).distinct(), "pairs")
    linked = pairs.select(F.col("u").alias("_set")).unionByName(pairs.select(F.col("v").alias("_set"))).distinct()
    if pairs.count() <= BROADCAST_ROWS:
        linked = F.broadcast(linked)
    few = staged(sets.join(linked, "_set", "left_semi").dropDuplicates(["_set"]).select("_set", F.struct("_first", "_set").alias("at"), "_case", "_n", "_bag"), "linked")
    left, right = (few.select(F.col("_set").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("at", "_case", "_n", "_bag")]) for k in "uv")
    both = pairs.join(left, "u").join(right, "v").where(F.col("_case_u").eqNullSafe(F.col("_case_v")))
    jaccard = F.size(F.array_intersect("_bag_u", "_bag_v")) / F.size(F.array_union("_bag_u", "_bag_v"))
    ahead = F.col("at_u") < F.col("at_v")
    ordered = [F.when(ahead, a).otherwise(b).alias(name) for name, a, b in (("u", F.col("u"), F.col("v")), ("v", F.col("v"), F.col("u")))]
    return both.where((jaccard >= threshold) & (F.when(ahead, F.col("_n_v")).otherwise(F.col("_n_u")) >= 3)).select(*ordered), (pairs, few)


def _followers(pairs: DataFrame) -> DataFrame:
    """(v): what greedy selection in order drops, of pairs (u, v) with u before v. In each round, whatever nothing left
    precedes is kept and drops what it is paired with; a round decides the first of every component at least."""
    left = staged(pairs, "pairs")
    gone = pairs.sparkSession.createDataFrame([], "v bigint")
    while not left.isEmpty():
        leaders = left.select("u").distinct().join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        out = staged(left.join(leaders, "u").select("v").distinct(), "followers")
        gone = gone.unionByName(out)
        before, left = left, staged(left.join(out, "v", "left_anti").join(out.withColumnRenamed("v", "u"), "u", "left_anti"), "pairs")
        release(before)
    return gone


def alike_pairs(items: DataFrame, case: str, key: str, bag: Column, threshold: float = MOST_ALIKE) -> DataFrame:
    """(case, a_id, b_id, jaccard): pairs of a case whose sets are that alike. Equal sets are one class; classes meet on words
    of their prefixes, rarest in the case first, so a class meets few others, and pairs of items are made of alike classes
    at the end."""
    bags = items.select(case, key, F.array_sort(F.array_distinct(bag)).alias("_bag")).withColumn("_n", F.size("_bag")).where("_n > 0").withColumn("_set", F.xxhash64(F.col(case), "_bag"))
    sets = bags.groupBy(case, "_set").agg(F.first("_bag").alias("_bag"), F.first("_n").alias("_n"), F.count("*").alias("_items"))
    each = sets.select(case, "_set", "_n", "_items", F.explode("_bag").alias("_w"))
    frequency = each.groupBy(case, "_w").agg(F.count("*").alias("_df"))
    w = Window.partitionBy(case, "_set").orderBy("_df", "_w")
    prefix = each.join(frequency, [case, "_w"]).withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= F.col("_n") - F.ceil(F.col("_n") * threshold) + 1).where("_df > 1")
    a, b = (prefix.select(case, "_w", *[F.col(c).alias(f"{c}_{s}") for c in ("_set", "_n", "_pos")]) for s in "ab")
    # an overlap that the threshold asks for has to fit behind the word that two sets meet on
    need = F.ceil((F.col("_n_a") + F.col("_n_b")) * threshold / (1 + threshold) - 1e-9)
    room = F.least(F.col("_n_a") - F.col("_pos_a"), F.col("_n_b") - F.col("_pos_b")) + 1
    near = (F.col("_set_a") < F.col("_set_b")) & (F.least("_n_a", "_n_b") >= threshold * F.greatest("_n_a", "_n_b")) & (room >= need)
    pairs = a.join(b, [case, "_w"]).where(near).select(case, "_set_a", "_set_b").distinct()
    left, right = (sets.select(case, F.col("_set").alias(f"_set_{s}"), F.col("_bag").alias(f"_{s}")) for s in "ab")
    both = pairs.join(left, [case, "_set_a"]).join(right, [case, "_set_b"])
    jaccard = F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))
    alike = both.select(case, "_set_a", "_set_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)
    alike = alike.unionByName(sets.where("_items > 1").select(case, F.col("_set").alias("_set_a"), F.col("_set").alias("_set_b"), F.lit(1.0).alias("jaccard")))
    ids, others = (bags.select(case, F.col("_set").alias(f"_set_{s}"), F.col(key).alias(f"_{s}")) for s in "ab")
    found = alike.join(ids, [case, "_set_a"]).join(others, [case, "_set_b"])
    apart = (F.col("_set_a") != F.col("_set_b")) | (F.col("_a") < F.col("_b"))
    return found.where(apart & (F.col("_a") != F.col("_b"))).select(case, F.least("_a", "_b").alias("a_id"), F.greatest("_a", "_b").alias("b_id"), "jaccard")


def canonical_sources(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Proposed sources by their canonical id, S1 on, in order of first use; unmapped ones go to the case's first."""
    joined = items.join(mapping.select("case_id", "proposed", "target"), ["case_id", "proposed"], "left")
    first = F.first("target", ignorenulls=True).over(Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = joined.withColumn("unmapped", F.col("target").isNull()).withColumn("target", F.coalesce("target", first))
    seen = F.min("pos").over(Window.partitionBy("case_id", "target"))
    return filled.withColumn("_first", seen).withColumn("source_id", F.concat(F.lit("S"), F.dense_rank().over(Window.partitionBy("case_id").orderBy("_first")))).drop("_first")


def number_items(items: DataFrame) -> DataFrame:
    """Evidence ids E<group>.<n>: groups by first appearance of their label, items within."""
    from evispark.operators.windows import number_by_first_use

    out = number_by_first_use(items, ["case_id"], "label", ["pos"])
    return out.withColumn("evidence_id", F.concat(F.lit("E"), F.col("group_no"), F.lit("."), F.col("item_no")))


def apply_review(items: DataFrame, leak_ids: DataFrame, rejections: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items without leaks, and rejections with their verdict, less those that are none; both numbered anew."""
    kept = number_items(items.join(leak_ids, ["case_id", "evidence_id"], "left_anti").drop("evidence_id", "group_no", "item_no"))
    judged = rejections.join(verdicts, ["case_id", "idx"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("unreviewed"))).where("verdict <> 'not_a_rejection'")
    return kept, judged.withColumn("reference_id", F.concat(F.lit("C"), F.row_number().over(Window.partitionBy("case_id").orderBy("idx"))))


def plan_cases(candidates: DataFrame, built: DataFrame, prefix: str) -> DataFrame:
    """A case id for every native id: the one it was built under, else the next serial numbers in order."""
    serial = F.regexp_extract("case_id", r"(\d+)$", 1).cast("int")
    top = built.agg(F.coalesce(F.max(serial), F.lit(0)).alias("_top"))  # one row
    joined = candidates.join(built.select("native_id", "case_id"), "native_id", "left")
    from evispark.operators.windows import running

    new = running(joined.where("case_id IS NULL").drop("case_id").withColumn("_all", F.lit(0)), ["_all"], ["native_id"], {"_nth": F.lit(1)}).drop("_all").join(F.broadcast(top))
    number = (F.col("_top") + F.col("_nth")).cast("string")
    named = new.withColumn("case_id", F.concat(F.lit(prefix), F.when(F.length(number) > 4, number).otherwise(F.lpad(number, 4, "0")))).drop("_nth", "_top")
    return joined.where("case_id IS NOT NULL").withColumn("new", F.lit(False)).unionByName(named.withColumn("new", F.lit(True)))


def opening_brief(items: DataFrame) -> DataFrame:
    """(case_id, brief): the record E1 in full, everything else as an index of titles, with counts."""
    opening = F.col("evidence_id").startswith("E1.")
    line = F.when(opening, F.concat(F.col("evidence_id"), F.lit(" | "), F.col("neutral_title"), F.lit("\n"), F.col("text"))).otherwise(F.concat(F.col("evidence_id"), F.lit(" | "), F.col("neutral_title")))
    listed = items.groupBy("case_id").agg(*[F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("pos", line.alias("line"))))), lambda s: s["line"]).alias(n) for c, n in ((opening, "_open"), (~opening, "_index"))])
    part = lambda name, c: F.concat(F.lit(f"## {name} ("), F.size(c).cast("string"), F.lit(")\n"), F.array_join(c, "\n"))
    return listed.select("case_id", F.concat(part("Record", "_open"), F.lit("\n\n"), part("Index", "_index")).alias("brief"))
