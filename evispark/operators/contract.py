"""The package contract as a table of violations, one row for each rule broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
CASE_FIELDS = ["case_id", "domain", "task_question", "initial_context", "version", "package_hash"]
ITEM_FIELDS = ["evidence_id", "neutral_title", "text", "source_id"]


def _rule(rows: DataFrame, broken: Column, rule: str, location: Column) -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(True))).select("case_id", location.alias("location"), F.lit(rule).alias("rule"))


def violations(packages: DataFrame, evidence: DataFrame, digest: str | None = None) -> DataFrame:
    """(case_id, location, rule). packages: the fields and sources MAP; evidence: case_id, pos and the item's fields.
    digest: a column of packages with the recomputed hash."""
    case = F.lit("case")
    at = F.concat(F.lit("evidence_items["), F.col("pos").cast("string"), F.lit("]"))
    out = []
    for c in CASE_FIELDS:
        out.append(_rule(packages, F.col(c).isNull() | (F.trim(c) == ""), f"{c} is empty", case))
        out.append(_rule(packages, F.coalesce(F.col(c).rlike(CONTROL), F.lit(False)), f"{c} has control characters", case))
    out.append(_rule(packages, ~F.col("case_id").rlike("^[A-Za-z][A-Za-z0-9_-]{0,63}$"), "case_id is not opaque", case))
    out.append(_rule(packages, ~F.col("package_hash").rlike("^[0-9a-f]{64}$"), "package_hash is no digest", case))
    out.append(_rule(packages, F.col("sources").isNotNull() & (F.size("sources") == 0), "sources is empty", case))
    odd = F.exists(F.map_keys(F.coalesce("sources", F.create_map().cast("map<string,string>"))), lambda k: ~k.rlike("^S[0-9]+$"))
    out.append(_rule(packages, odd, "a source id is malformed", case))
    if digest:
        out.append(_rule(packages, ~F.col("package_hash").eqNullSafe(F.col(digest)), "package_hash is stale", case))
    out.append(_rule(packages.join(evidence, "case_id", "left_anti"), F.lit(True), "no evidence items", case))
    for c in ITEM_FIELDS:
        out.append(_rule(evidence, F.col(c).isNull() | (F.trim(c) == ""), f"{c} is empty", at))
        out.append(_rule(evidence, F.coalesce(F.col(c).rlike(CONTROL), F.lit(False)), f"{c} has control characters", at))
    out.append(_rule(evidence, ~F.col("evidence_id").rlike(r"^E[0-9]+(?:\.[0-9]+)*$"), "evidence_id is malformed", at))
    out.append(_rule(evidence, ~F.col("source_id").rlike("^S[0-9]+$"), "source_id is malformed", at))
    twice = evidence.groupBy("case_id", "evidence_id").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = evidence.join(twice, ["case_id", "evidence_id"]).where("pos > _first")
    out.append(_rule(again, F.lit(True), "evidence_id is there twice", at))
    declared = packages.where(F.col("sources").isNotNull()).select("case_id", F.map_keys("sources").alias("_declared"))
    out.append(_rule(evidence.join(declared, "case_id"), ~F.array_contains("_declared", F.col("source_id")), "source_id is not declared", at))
    return reduce(DataFrame.unionByName, out)


def tool_arguments_valid(ids: Column, reason: Column) -> Column:
    """1 to 12 distinct ids of the deep grammar and a reason of 10 characters."""
    return F.coalesce(F.size(ids).between(1, 12) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: i.rlike(r"^E[1-9][0-9]*\.[1-9][0-9]*$")) & (F.length(F.trim(reason)) >= 10), F.lit(False))


def call_errors(text: Column) -> Column:
    """What is wrong with a tool call in a reply, in order; empty if nothing is or there is no call."""
    opens = F.size(F.regexp_extract_all(text, F.lit("<tool_call>"), F.lit(0)))
    closes = F.size(F.regexp_extract_all(text, F.lit("</tool_call>"), F.lit(0)))
    name = F.regexp_extract(text, r"<function=([^>]*)>", 1)
    checks = F.array(
        F.when(opens != closes, "malformed markup"),
        F.when(opens > 1, "multiple calls"),
        F.when((opens == 1) & (name != "fetch_evidence"), "unknown tool"),
        F.when((opens == 1) & text.rlike(r"(?s)</tool_call>\s*\S"), "trailing text"),
    )
    return F.filter(checks, lambda c: c.isNotNull())
