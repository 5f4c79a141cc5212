"""Trajectories: replay of what was disclosed, format rules, edits, and the quality gate."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import closure_marker, evidence_ids
from evispark.operators.contract import tool_arguments_valid
from evispark.operators.windows import disclosure_fold

KEYS = ["case_id", "sample"]


def replay(turns: DataFrame, openings: DataFrame) -> DataFrame:
    """turns with seen_before and fresh. openings: case_id, opening ARRAY of ids."""
    joined = turns.join(openings, "case_id").withColumn("_ids", F.coalesce("call_ids", F.array().cast("array<string>")))
    valid = F.col("call_ids").isNotNull() & (F.size(F.coalesce("call_errors", F.array().cast("array<string>"))) == 0) & F.col("return_error").isNull()
    return disclosure_fold(joined, KEYS, "turn", "_ids", valid, F.col("opening")).drop("_ids")


def results(turns: DataFrame, openings: DataFrame, finals: DataFrame) -> DataFrame:
    """One row a rollout: rounds, requested, fetched, disclosed and cited ids, whether all cited ones were seen, marker."""
    folded = replay(turns, openings)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))
    out = folded.groupBy(*KEYS).agg(F.sum(F.col("call_ids").isNotNull().cast("int")).alias("fetch_rounds"), flat(F.col("call_ids")).alias("requested"), flat(F.col("fresh")).alias("fetched"), F.first("opening").alias("opening"))
    both = finals.join(out, KEYS, "left")
    disclosed = F.array_union(F.coalesce("opening", F.array().cast("array<string>")), F.coalesce("fetched", F.array().cast("array<string>")))
    cited = F.array_distinct(evidence_ids("final_answer"))
    return both.withColumn("disclosed", disclosed).withColumn("cited", cited).withColumn("citations_seen", F.size(F.array_except("cited", "disclosed")) == 0).withColumn("marker", closure_marker("final_answer"))


def format_violations(turns: DataFrame, openings: DataFrame, finals: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, sample, turn, rule) of every broken rule."""
    folded = replay(turns, openings)
    ended = results(turns, openings, finals).join(labels.select("case_id", "closure"), "case_id", "left")
    w = Window.partitionBy(*KEYS).orderBy("turn")
    forward = F.size(F.array_except(evidence_ids("assistant"), F.concat("seen_before", F.coalesce("call_ids", F.array().cast("array<string>"))))) > 0
    rules = [
        (folded, "a turn is missing", F.coalesce(F.col("turn") - F.lag("turn").over(w) != 1, F.col("turn") != 1)),
        (folded, "arguments are invalid", F.col("call_ids").isNotNull() & ~tool_arguments_valid(F.col("call_ids"), F.col("reason"))),
        (folded, "the return is not what was asked", F.col("call_ids").isNotNull() & F.col("return_error").isNull() & ~F.sort_array("returned_ids").eqNullSafe(F.sort_array("fresh"))),
        (folded, "an item is cited before it was seen", forward),
    ]
    by_turn = [df.withColumn("_bad", bad).where("_bad").select(*KEYS, "turn", F.lit(rule).alias("rule")) for df, rule, bad in rules]
    final_rules = [("no marker", F.col("marker").isNull()), ("the marker is not the label", F.col("marker").isNotNull() & (F.col("marker") != F.col("closure"))), ("a cited item was never seen", ~F.col("citations_seen"))]
    by_end = [ended.where(bad).select(*KEYS, F.lit(None).cast("int").alias("turn"), F.lit(rule).alias("rule")) for rule, bad in final_rules]
    return reduce(DataFrame.unionByName, [*by_turn, *by_end])


def first_seen(folded: DataFrame) -> DataFrame:
    """(case_id, sample, evidence_id, turn): when each item was first seen, 0 for the opening."""
    opened = folded.select(*KEYS, F.explode("opening").alias("evidence_id"), F.lit(0).alias("turn")).distinct()
    later = folded.select(*KEYS, F.explode("fresh").alias("evidence_id"), "turn")
    return opened.unionByName(later).groupBy(*KEYS, "evidence_id").agg(F.min("turn").alias("turn"))


def gate(first: DataFrame, second: DataFrame, revised: DataFrame, good: int = 4, mendable: int = 3) -> DataFrame:
    """(case_id, outcome, use): what becomes of each case after one audit, a revision of the final answer and a second audit.
    first and second: case_id, score, hard; revised: case_id, status."""
    a = first.select("case_id", F.col("score").alias("s1"), F.col("hard").alias("h1"))
    b = second.select("case_id", F.col("score").alias("s2"), F.col("hard").alias("h2"))
    joined = a.join(revised.select("case_id", F.col("status").alias("rev")), "case_id", "left").join(b, "case_id", "left")
    hard1, hard2 = F.coalesce("h1", F.lit(False)), F.coalesce("h2", F.lit(False))
    result = (
        F.when(F.col("s1").isNull(), "not_audited").when(hard1, "rejected_hard").when(F.col("s1") >= good, "accepted_first")
        .when(F.col("s1") != mendable, "rejected_score").when(~F.col("rev").eqNullSafe("ok"), "revision_failed")
        .when(F.col("s2").isNull(), "not_audited_again").when(~hard2 & (F.col("s2") >= good), "accepted_revised").otherwise("rejected_revised")
    )
    out = joined.withColumn("outcome", result)
    use = F.when(F.col("outcome") == "accepted_first", "first").when(F.col("outcome") == "accepted_revised", "revised")
    return out.select("case_id", "outcome", use.alias("use"))


def apply_patches(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """(case_id, target, text, error): a case's edits, in order; each must find its old text exactly once, and the first
    that doesn't stops the case. A case's edits are few."""
    listed = patches.groupBy("case_id", "target").agg(F.sort_array(F.collect_list(F.struct("op_no", "old", "new"))).alias("ops"))
    joined = texts.join(listed, ["case_id", "target"], "left")

    @F.pandas_udf("struct<text:string,error:string>")
    def edit(text: pd.Series, ops: pd.Series) -> pd.DataFrame:
        rows = []
        for t, steps in zip(text, ops):
            error = None
            for op in [] if steps is None else steps:
                if t is None or not op["old"] or t.count(op["old"]) != 1:
                    error = f"edit {op['op_no']}: the old text is not there exactly once"
                    break
                t = t.replace(op["old"], op["new"])
            rows.append((t, error))
        return pd.DataFrame(rows, columns=["text", "error"])

    out = joined.withColumn("_e", edit(F.col("text"), F.col("ops")))
    return out.select("case_id", "target", "_e.text", "_e.error")


def best_candidate(candidates: DataFrame, case: str, valid: str, priority: str) -> DataFrame:
    """The valid candidate of highest priority for each case."""
    w = Window.partitionBy(case).orderBy(priority)
    return candidates.where(F.col(valid)).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
