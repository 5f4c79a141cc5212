"""Groups of samples: which are kept, and what is drawn again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_status(samples: DataFrame, group: str, reward: str, straggler: Column, infra: Column, sequence: Column, judge: Column, late: Column | None = None) -> DataFrame:
    """One status a group: the first rung that any of its samples is on, identical rewards last."""
    some = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    status = F.when(some(straggler), "straggler").when(some(infra), "infra").when(some(sequence), "sequence")
    if late is not None:
        status = status.when(some(late), "judge_deadline")
    status = status.when(some(judge), "judge_failure").when(F.max(reward) - F.min(reward) <= 1e-9, "identical_rewards").otherwise("kept")
    return samples.groupBy(group).agg(status.alias("status"), F.count("*").alias("samples"))


def usable_dimensions(judgements: DataFrame, group: str, dimension: str, failed: Column) -> DataFrame:
    """Judgements less every dimension that failed in any sample of the group."""
    w = Window.partitionBy(group, dimension)
    return judgements.withColumn("_failed", F.max(failed.cast("int")).over(w)).where("_failed = 0").drop("_failed")


def refill(kept: int, least: int, keep_rate: float) -> int:
    """How many groups to draw again."""
    return max(0, math.ceil((least - kept) / max(keep_rate, 0.25)))


def over_long(rows: DataFrame, tokens: str, limit: int, per_turn: int) -> DataFrame:
    """Rows whose opening leaves no room for a turn."""
    return rows.where(F.col(tokens) >= limit - per_turn)


def stale(rows: DataFrame, version: str, now: str, bound: int) -> DataFrame:
    return rows.where(F.col(now) - F.col(version) > bound)


def past_cutoff(done: Column, total: Column, kept_groups: Column, least_groups: int, share: float = 0.9) -> Column:
    """Whether a step stops waiting: enough groups are kept and that share of its rollouts has ended."""
    return (kept_groups >= least_groups) & (total > 0) & (done >= share * total)


def choose_routes(routes: DataFrame, n: int) -> DataFrame:
    """(route, slot) of n requests, each to the route with the least in hand, by name among equals; paused routes take
    none. routes: route, load, paused. A row for each request and route, so n is a batch's size."""
    free = routes.where(~F.coalesce("paused", F.lit(False))).select("route", F.explode(F.sequence(F.col("load"), F.col("load") + F.lit(n - 1))).alias("at"))
    return free.orderBy("at", "route").limit(n).groupBy("route").agg(F.count("*").alias("requests"))
