"""Rates of decisions against labels. A missing decision is a third class, wrong against any label and never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy_by_families(rows: DataFrame, decision: str, label: str, families: list[tuple[str, ...]]) -> DataFrame:
    """n, ok and acc for every family of keys at once, as grouping sets; keys outside a family are null there."""
    keys = sorted({k for f in families for k in f})
    graded = rows.withColumn("_ok", F.col(decision).eqNullSafe(F.col(label)).cast("bigint"))
    grouped = graded.groupingSets([[F.col(k) for k in f] for f in families], *[F.col(k) for k in keys])
    flags = [F.grouping(k).cast("int").alias(f"g_{k}") for k in keys]
    out = grouped.agg(F.count("*").alias("n"), F.sum("_ok").alias("ok"), *flags)
    return out.withColumn("acc", F.round(F.col("ok") / F.col("n"), 6))


def recall_of(label: str, value: str, decision: str) -> Column:
    return F.avg(F.when(F.col(label) == value, F.col(decision).eqNullSafe(F.col(label)).cast("double")))


def balanced_accuracy(rows: DataFrame, decision: str, label: str, *by: str) -> DataFrame:
    """Recalls of both classes and their mean; null where a class is missing."""
    out = rows.groupBy(*by).agg(recall_of(label, "closed", decision).alias("recall_closed"), recall_of(label, "not_closed", decision).alias("recall_open"))
    return out.withColumn("balanced", F.round((F.col("recall_closed") + F.col("recall_open")) / 2, 6))


def confusion_cells(rows: DataFrame, decision: str, label: str) -> DataFrame:
    """n and share of all for each pair of decision and label."""
    cells = rows.groupBy(F.col(decision).alias("decision"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))  # one row
    return cells.join(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def contrast(rows: DataFrame, variant: str, value: Column, base: str, others: list[str], *by: str) -> DataFrame:
    """The mean of a value under each variant and what each loses against the base."""
    means = rows.withColumn("_value", value.cast("double")).groupBy(*by).pivot(variant, [base, *others]).agg(F.round(F.avg("_value"), 6))
    return means.select(*by, *[F.col(f"`{v}`").alias(f"rate_{v}") for v in (base, *others)], *[F.round(F.col(f"`{base}`") - F.col(f"`{v}`"), 6).alias(f"drop_{v}") for v in others])


def paired_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of two judges on the same samples: pairs, mean difference, mean absolute difference, agreement. Nulls are skipped."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    d = F.col("_a") - F.col("_b")
    return both.agg(F.count(d).alias("pairs"), F.round(F.avg(d), 6).alias("mean_diff"), F.round(F.avg(F.abs(d)), 6).alias("mean_abs_diff"), F.round(F.avg(F.when(d.isNotNull(), (d == 0).cast("double"))), 6).alias("agree"))


def merged_answers(rows: DataFrame, answers: str, *by: str) -> DataFrame:
    """Counters question -> [yes, n], added up, with the yes-rate; a question that was never put has no rate."""
    each = rows.select(*by, F.explode(answers).alias("question", "counter"))
    out = each.groupBy(*by, "question").agg(F.sum(F.element_at("counter", 1)).alias("yes"), F.sum(F.element_at("counter", 2)).alias("n"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("yes"), F.col("n")), 6))


def judge_health(calls: DataFrame, failed: Column, parse_failed: Column, inconsistent: Column, *by: str) -> DataFrame:
    """Calls, rates and whether any rate is over its limit."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = calls.groupBy(*by).agg(F.count("*").alias("calls"), rate(failed).alias("failure_rate"), rate(parse_failed).alias("parse_rate"), rate(inconsistent).alias("inconsistent_rate"))
    alert = (F.col("failure_rate") > 0.05) | (F.col("parse_rate") > 0.02) | (F.col("inconsistent_rate") > 0.10)
    return out.select(*by, "calls", *[F.round(c, 6).alias(c) for c in ("failure_rate", "parse_rate", "inconsistent_rate")], alert.alias("alert"))


def latency(calls: DataFrame, value: str, *by: str) -> DataFrame:
    """p50, p95 by lower rank, and the largest. Values are ranked in ranges, so no group has to fit a task."""
    from evispark.operators.windows import running

    there = calls.where(F.col(value).isNotNull()).select(*by, value)
    ranked = running(there, list(by), [value], {"_nth": F.lit(1)})
    sizes = there.groupBy(*by).agg(F.count("*").alias("_n"), F.max(value).alias("most"))
    keyed = ranked.withColumn("_by", F.struct(*by)).drop(*by).join(sizes.withColumn("_by", F.struct(*by)), "_by")
    at = {name: F.floor(F.lit(p) * (F.col("_n") - 1)) + 1 == F.col("_nth") for name, p in (("p50", 0.5), ("p95", 0.95))}
    return keyed.where(at["p50"] | at["p95"]).groupBy(*by).agg(*[F.max(F.when(c, F.col(value))).alias(name) for name, c in at.items()], F.first("most").alias("most"))


def cost(calls: DataFrame, reported: Column, computed: Column, *by: str) -> DataFrame:
    """Reported cost where there is one, else tokens times price."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce(reported, computed)), 6).alias("cost"))


def reward_parts(rows: DataFrame, total: str, judged: str) -> DataFrame:
    return rows.agg(F.avg(judged).alias("judge_part"), F.avg(F.col(total) - F.col(judged)).alias("program_part"))


def wrong_but_rewarded(rows: DataFrame, d: str, advantage: str) -> DataFrame:
    """Share of wrong decisions with an advantage above zero."""
    return rows.where((F.col(d) < 0) & F.col(advantage).isNotNull()).agg(F.round(F.avg((F.col(advantage) > 0).cast("double")), 6).alias("share"), F.count("*").alias("n"))


def summary(records: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for a run: rates over its records, errors, turns and rounds a case, accuracy by class and their mean, and
    accuracy by source as a map. records: case_id, source, status, marker, citations_seen, error_turns, turns, fetch_rounds;
    labels: case_id, closure. A record without a label is an error."""
    joined = records.join(labels.select("case_id", "closure"), "case_id", "left")
    label = F.coalesce("closure", F.raise_error(F.concat(F.lit("no label: "), F.col("case_id"))))
    rows = joined.withColumn("closure", label).withColumn("_ok", F.col("marker").eqNullSafe(F.col("closure")))
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")), 6)
    right = {k: F.avg(F.when(F.col("closure") == k, F.col("_ok").cast("double"))) for k in ("closed", "not_closed")}
    whole = rows.agg(
        F.count("*").alias("records"), rate(F.col("status") == "final").alias("final_rate"), rate(F.col("marker").isNull()).alias("no_marker_rate"), rate(F.col("citations_seen")).alias("valid_citation_rate"),
        mean("error_turns").alias("tool_error_turns_per_case"), mean("turns").alias("turns_per_case"), mean("fetch_rounds").alias("fetch_rounds_per_case"), rate(F.col("status") == "turn_limit").alias("turn_limit_rate"),
        F.round(right["closed"], 6).alias("acc_closed"), F.round(right["not_closed"], 6).alias("acc_not_closed"), F.round((right["closed"] + right["not_closed"]) / 2, 6).alias("balanced"),
    )
    each = rows.groupBy("source").agg(F.round(F.avg(F.col("_ok").cast("double")), 6).alias("acc"))
    by = each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "acc")))).alias("acc_by_source"))  # a row for each source
    return whole.crossJoin(by)  # two single rows


def judge_counts(calls: DataFrame, *by: str) -> DataFrame:
    """By window: requests, cache hits, attempts, retries, errors and parse failures by kind, calls by key, tokens and cost.
    calls: cached, attempts, errors (array of kinds), parse_failures (array of kinds), key, prompt_tokens,
    completion_tokens, cost. Kinds and keys are few."""
    keys = list(by)
    counted = lambda column, name: calls.select(*keys, F.explode(column).alias("_k")).groupBy(*keys, "_k").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_n")))).alias(name))
    whole = calls.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.sum(F.col("cached").cast("bigint")).alias("cache_hits"), F.sum("attempts").alias("http_attempts"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 6).alias("cost"),
    )
    apart = F.filter("parse_failures", lambda k: ~k.isin("truncated", "inconsistent"))
    rates = calls.groupBy(*keys).agg(F.round(F.try_divide(F.sum(F.size(apart)), F.sum("attempts")), 6).alias("parse_failure_rate"))
    out = whole.join(rates, keys)
    for column, name in ((F.col("errors"), "errors"), (F.col("parse_failures"), "parse_failures"), (F.when(~F.col("cached"), F.array("key")), "per_key")):
        out = out.join(counted(column, name), keys, "left")
    return out
