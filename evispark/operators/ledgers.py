"""Hypothesis ledgers: a turn's text compiled from claims and states, and what a ledger breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import evidence_ids, strict_section

# The sections of a turn, and the lines of a claim and of a state.
CLAIMS, UPDATE, LEDGER, CHECK = "Current hypotheses", "Evidence and hypothesis update", "Hypothesis ledger", "Next discriminating check"
CLAIM = r"^(H[0-9]+) — (.+)$"
STATE = r"^(H[0-9]+) \[([^\]→]+) → ([^\]]+)\] — (.+)$"
OPEN = "open"


def compile_turns(rounds: DataFrame, claims: DataFrame, states: DataFrame) -> DataFrame:
    """(case_id, round, content): rounds: case_id, round, note, reason; claims: case_id, hypothesis, claim; states: case_id,
    round, hypothesis, status, basis. Each state goes on from the one before, the first from `open`."""
    before = F.coalesce(F.lag("status").over(Window.partitionBy("case_id", "hypothesis").orderBy("round")), F.lit(OPEN))
    line = F.concat(F.col("hypothesis"), F.lit(" ["), F.col("_before"), F.lit(" → "), F.col("status"), F.lit("] — "), F.col("basis"))
    ordered = lambda x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hypothesis", x.alias("x")))), lambda s: s["x"]), "\n")
    moves = states.withColumn("_before", before).groupBy("case_id", "round").agg(ordered(line).alias("_moves"))
    stable = claims.groupBy("case_id").agg(ordered(F.concat_ws(" — ", "hypothesis", "claim")).alias("_claims"))
    parts = {CLAIMS: F.col("_claims"), UPDATE: F.col("note"), LEDGER: F.col("_moves"), CHECK: F.col("reason")}
    content = F.concat_ws("\n\n", *[F.concat(F.lit(f"## {name}\n"), value) for name, value in parts.items()])
    return rounds.join(moves, ["case_id", "round"]).join(stable, "case_id").select("case_id", "round", content.alias("content"))


def _lines(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def problems(rounds: DataFrame) -> DataFrame:
    """(case_id, round, rule) of every broken rule. rounds: case_id, round, content, reason."""
    cut = rounds.select("case_id", "round", "reason", strict_section("content", CLAIMS, UPDATE).alias("_c"), strict_section("content", LEDGER, CHECK).alias("_l"), strict_section("content", CHECK).alias("_q"))
    rows = cut.withColumn("_claims", _lines(F.col("_c.text"))).withColumn("_moves", _lines(F.col("_l.text")))
    first = F.first("_claims").over(Window.partitionBy("case_id").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_stable", first)
    whole = F.col("_c.problem").isNull() & F.col("_l.problem").isNull()
    by_round = [
        ("a section is missing", ~whole | F.col("_q.problem").isNotNull()),
        ("malformed hypotheses", F.col("_c.problem").isNull() & ((F.size("_claims") < 2) | F.exists("_claims", lambda x: ~x.rlike(CLAIM)))),
        ("claims changed", F.col("_c.problem").isNull() & (F.sort_array("_claims") != F.sort_array("_stable"))),
        ("a ledger line is missing", whole & (F.size("_moves") != F.size("_stable"))),
        ("malformed ledger line", whole & F.exists("_moves", lambda x: ~x.rlike(STATE))),
        ("the next check is not the request's reason", F.col("_q.problem").isNull() & ~F.col("_q.text").eqNullSafe(F.col("reason"))),
    ]
    out = [rows.where(bad).select("case_id", "round", F.lit(rule).alias("rule")) for rule, bad in by_round]
    each = rows.where(whole).select("case_id", "round", "_stable", F.posexplode("_moves").alias("_at", "_x")).where(F.col("_x").rlike(STATE))
    part = lambda k: F.trim(F.regexp_extract("_x", STATE, k))
    moves = each.select("case_id", "round", "_at", "_stable", part(1).alias("hypothesis"), part(2).alias("before"), part(3).alias("after"), part(4).alias("basis"))
    left = F.coalesce(F.lag("after").over(Window.partitionBy("case_id", "hypothesis").orderBy("round", "_at")), F.lit(OPEN))
    known = F.exists("_stable", lambda x: F.regexp_extract(x, CLAIM, 1) == F.col("hypothesis"))
    again = F.row_number().over(Window.partitionBy("case_id", "round", "hypothesis").orderBy("_at")) > 1
    judged = moves.withColumn("_left", left).withColumn("_again", again)
    by_move = [
        ("unknown or repeated hypothesis, or another state before", ~known | F.col("_again") | (F.col("before") != F.col("_left"))),
        ("a state changed without a citation", (F.col("before") != F.col("after")) & (F.size(evidence_ids("basis")) == 0)),
    ]
    out += [judged.where(bad).select("case_id", "round", F.lit(rule).alias("rule")) for rule, bad in by_move]
    return reduce(DataFrame.unionByName, out)
