"""Audited trajectories mended: what an audit found, local edits and new evidence, revised final answers, attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import evidence_ids, issue_kind

MARKER = r"CASE (?:NOT )?CLOSED"
#: Code points of a revised final answer, of a new item's title and of its quote, at least.
LEAST_FINAL, LEAST_TITLE, LEAST_QUOTE = 50, 8, 20
MOST_ITEMS = 3


def triage_before(issues: DataFrame, seen: DataFrame, rounds: DataFrame) -> DataFrame:
    """issues with kind, about_final and later: cited items that weren't seen before the round that is complained of.
    issues: case_id, issue_id, at_round, finding, ids; seen: case_id, evidence_id, turn; rounds: case_id, n."""
    joined = issues.join(rounds.select("case_id", F.col("n").alias("_n")), "case_id", "left").withColumn("about_final", F.col("at_round") > F.col("_n"))
    ids = F.sort_array(F.array_distinct(F.concat(F.coalesce("ids", F.array().cast("array<string>")), evidence_ids("finding"))))
    cited = joined.select("case_id", "issue_id", "at_round", "about_final", F.explode(ids).alias("evidence_id")).join(seen, ["case_id", "evidence_id"])
    late = cited.where(~F.col("about_final") & (F.col("turn") >= F.col("at_round"))).groupBy("case_id", "issue_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("later"))
    out = joined.withColumn("kind", issue_kind(F.col("finding"), F.col("about_final"))).join(late, ["case_id", "issue_id"], "left")
    return out.withColumn("later", F.coalesce("later", F.array().cast("array<string>"))).drop("_n")


def triage_after(before: DataFrame, texts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(case_id, issue_id, kind, claimed, changed, signal): what became of each finding. texts: case_id, at_round, old,
    new; resolutions: case_id, issue_id, status."""
    claims = resolutions.select("case_id", "issue_id", F.col("status").alias("claimed"))
    joined = before.join(texts, ["case_id", "at_round"], "left").join(claims, ["case_id", "issue_id"], "left")
    changed = ~F.col("old").eqNullSafe(F.col("new"))
    signal = F.when(F.col("claimed") == "not_fixable", "unfixable").when((F.col("claimed") == "fixed") & ~changed, "claimed without a change").otherwise("to be scored")
    return joined.select("case_id", "issue_id", "kind", "claimed", changed.alias("changed"), signal.alias("signal"))


def unresolved(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(case_id, issue_id, rule): findings without exactly one disposition, dispositions of nothing, unknown ones."""
    allowed = ("fixed", "partially_fixed", "not_fixable", "already_acceptable")
    keys = ["case_id", "issue_id"]
    told = lambda df, rule: df.select(*keys, F.lit(rule).alias("rule"))
    twice = resolutions.groupBy(*keys).count().where("count > 1")
    found = [(issues.join(resolutions, keys, "left_anti"), "no disposition"), (resolutions.join(issues, keys, "left_anti"), "no such finding"), (twice, "several dispositions"), (resolutions.where(~F.col("status").isin(*allowed)), "unknown disposition")]
    return reduce(DataFrame.unionByName, [told(df, rule) for df, rule in found])


def revise_finals(finals: DataFrame, proposals: DataFrame) -> DataFrame:
    """(case_id, text, status): only the last message changes, and its closure marker stays: one that a proposal lacks is
    put back, one that stands elsewhere or a short proposal is rejected, a truncated reply is a failure. Cases without a
    proposal keep their text. finals: case_id, final; proposals: case_id, proposed, finish_reason."""
    joined = finals.join(proposals.withColumn("_there", F.lit(True)), "case_id", "left")
    proposed = F.col("proposed")
    marker, leads = F.regexp_extract("final", f"^{MARKER}", 0), F.coalesce(proposed.rlike(f"^{MARKER}"), F.lit(False))
    short = F.coalesce(F.length(F.trim(proposed)) < LEAST_FINAL, F.lit(True))
    misplaced = (marker != "") & ~leads & F.coalesce(proposed.rlike(rf"\b{MARKER}\b"), F.lit(False))
    status = F.when(F.col("_there").isNull(), "kept").when(F.col("finish_reason") == "length", "truncated").when(short | misplaced, "rejected").otherwise("revised")
    restored = F.when((marker != "") & ~leads, F.concat(marker, F.lit(" — "), F.ltrim(proposed))).otherwise(proposed)
    return joined.withColumn("status", status).select("case_id", F.when(F.col("status") == "revised", restored).otherwise(F.col("final")).alias("text"), "status")


def reserved_ids(items: DataFrame) -> DataFrame:
    """(case_id, reserved): the ids that new items of a case have to take, in order: a group of their own, after all others."""
    group = F.regexp_extract("evidence_id", r"^E(\d+)\.", 1).cast("int")
    top = items.groupBy("case_id").agg(F.max(group).alias("_g"))
    return top.select("case_id", F.transform(F.sequence(F.lit(1), F.lit(MOST_ITEMS)), lambda n: F.concat(F.lit("E"), F.col("_g") + 1, F.lit("."), n)).alias("reserved"))


def additions(proposed: DataFrame, items: DataFrame, originals: DataFrame) -> DataFrame:
    """Proposed items with char_offset, quote_sha and problem: null if the item may be added. proposed: case_id, pos
    (from 1), evidence_id, neutral_title, kind, source_id, quote; originals: case_id, original, the text that alone may be
    quoted. A quote has to stand there exactly once."""
    sources = items.groupBy("case_id").agg(F.collect_set("source_id").alias("_sources"))
    joined = proposed.join(reserved_ids(items), "case_id", "left").join(sources, "case_id", "left").join(originals, "case_id", "left")
    quote, original = F.coalesce("quote", F.lit("")), F.coalesce("original", F.lit(""))
    at = F.position(quote, original)
    again = F.position(quote, original, at + 1)
    n = F.count("*").over(Window.partitionBy("case_id"))
    problem = F.coalesce(
        F.when(n > MOST_ITEMS, "too many items"),
        F.when(~F.coalesce(F.get("reserved", F.col("pos") - 1) == F.col("evidence_id"), F.lit(False)), "not the reserved id"),
        F.when(F.coalesce(F.length(F.trim("neutral_title")) < LEAST_TITLE, F.lit(True)) | F.coalesce(F.trim("kind") == "", F.lit(True)), "no title or kind"),
        F.when(~F.coalesce(F.array_contains("_sources", F.col("source_id")), F.lit(False)), "unknown source"),
        F.when(F.length(F.trim(quote)) < LEAST_QUOTE, "quote too short"),
        F.when((at == 0) | (again > 0), "quote not there exactly once"),
    )
    return joined.withColumn("problem", problem).withColumn("char_offset", F.when(F.col("problem").isNull(), at - 1)).withColumn("quote_sha", F.sha2(quote, 256)).drop("reserved", "_sources", "original")


def attempt_outcomes(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(case_id, status, reason, retry): how a case's repair ended. attempts: case_id, attempt, transport (null, `http_error`
    or an uncertain state), finish_reason, parsed, edits, error (of the compiler).

    What is uncertain is never repeated; a failed request, a truncated or unreadable reply and an edit that doesn't compile
    get one more, directed attempt; a readable reply without edits ends the case, as does one that compiles."""
    failure = F.coalesce(
        F.when(F.col("transport") == "http_error", "http error"), F.when(F.col("finish_reason") == "length", "truncated"),
        F.when(~F.coalesce("parsed", F.lit(False)), "invalid json"), F.when((F.col("edits") > 0) & F.col("error").isNotNull(), F.concat(F.lit("compiler: "), F.col("error"))),
    )
    uncertain = F.col("transport").isNotNull() & (F.col("transport") != "http_error")
    step = F.when(uncertain, F.col("transport")).when(failure.isNotNull(), "failed").when(F.coalesce("edits", F.lit(0)) == 0, "unfixable_or_no_change").otherwise("compiled_review_draft")
    each = attempts.where(F.col("attempt") <= most).withColumn("_step", step).withColumn("_why", F.when(step == "failed", failure))
    ends = F.min(F.when(F.col("_step") != "failed", F.struct("attempt", "_step")))
    out = each.groupBy("case_id").agg(ends.alias("_end"), F.max_by("_why", "attempt").alias("_why"), F.max("attempt").alias("_n"))
    status = F.when(F.col("_end").isNotNull(), F.col("_end._step")).when(F.col("_n") >= most, "repair_failed").otherwise("to be retried")
    return out.select("case_id", status.alias("status"), F.when(F.col("_end").isNull(), F.col("_why")).alias("reason"), (F.col("_end").isNull() & (F.col("_n") < most)).alias("retry"))
