"""Plans to trajectories: what a plan breaks, the messages that it makes, and how a live run ended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import closure_marker, evidence_ids
from evispark.operators.windows import disclosure_fold

#: What a case may stop for, besides its context.
BUDGETS = ("case_token_budget", "turn_token_budget", "wall_budget")
#: Rounds of a plan, and items of a request, at least and at most.
ROUNDS, REQUEST = (3, 16), (1, 12)
NONE = "array<string>"


def hypotheses(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bH[0-9]+\b"), F.lit(0)))


def known_items(items: DataFrame) -> DataFrame:
    """(case_id, known, opening): a case's ids, and those that its record shows from the start. A case's items are few."""
    ids = F.col("evidence_id")
    return items.groupBy("case_id").agg(F.sort_array(F.collect_set(ids)).alias("known"), F.sort_array(F.collect_set(F.when(ids.startswith("E1."), ids))).alias("opening"))


def deliveries(rounds: DataFrame, items: DataFrame, keys: list[str], order: str = "round", ids: str = "fetch_ids") -> DataFrame:
    """Rounds with known, opening, seen_before, what is delivered (fresh), what was already, and ids of no item."""
    joined = rounds.join(known_items(items), "case_id", "left")
    known = F.coalesce("known", F.array().cast(NONE))
    joined = joined.withColumn("unknown", F.array_except(ids, known))
    folded = disclosure_fold(joined, keys, order, ids, F.size("unknown") == 0, F.coalesce("opening", F.array().cast(NONE)))
    return folded.withColumn("already_delivered", F.filter(ids, lambda i: F.array_contains("seen_before", i)))


def plan_problems(rounds: DataFrame, items: DataFrame, finals: DataFrame, withheld: DataFrame) -> DataFrame:
    """(case_id, round, rule) of every broken rule; round is null for rules of the whole plan.

    rounds: case_id, round, note, fetch_ids, reason; finals: case_id, final, expected (`determined`, `undetermined` or
    null); withheld: case_id, value."""
    folded = deliveries(rounds, items, ["case_id"])
    first = Window.partitionBy("case_id").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    folded = folded.withColumn("_declared", F.first(hypotheses(F.col("note"))).over(first)).withColumn("_first", F.first("round").over(first))
    said = F.concat_ws(" ", "note", "reason")
    opens = F.col("round") == F.col("_first")
    shape = (F.trim("note") == "") | ~F.size("fetch_ids").between(*REQUEST) | (F.size(F.array_distinct("fetch_ids")) != F.size("fetch_ids")) | (F.length("reason") < 10)
    by_round = [
        ("empty note, bad ids or short reason", F.coalesce(shape, F.lit(True))),
        ("unknown evidence id", F.size("unknown") > 0),
        ("forward citation", F.size(F.array_except(evidence_ids(said), F.col("seen_before"))) > 0),
        ("first note lacks two hypotheses", opens & (F.size("_declared") < 2)),
        ("undeclared hypothesis", ~opens & (F.size(F.array_except(hypotheses(F.col("note")), F.col("_declared"))) > 0)),
    ]
    out = [folded.where(bad).select("case_id", "round", F.lit(rule).alias("rule")) for rule, bad in by_round]
    whole = F.lit(None).cast("int").alias("round")
    seen = folded.groupBy("case_id").agg(F.count("*").alias("_n"), F.first("opening").alias("_opening"), F.array_distinct(F.flatten(F.collect_list("fresh"))).alias("_fresh"), F.lower(F.concat_ws(" ", F.collect_list(said))).alias("_said"))
    ended = finals.join(seen, "case_id", "left").withColumn("_seen", F.concat(F.coalesce("_opening", F.array().cast(NONE)), F.coalesce("_fresh", F.array().cast(NONE))))
    marker = F.when(F.col("final").startswith("CASE NOT CLOSED"), "undetermined").when(F.col("final").startswith("CASE CLOSED"), "determined")
    rules = [
        ("round count", ~F.coalesce("_n", F.lit(0)).between(*ROUNDS)),
        ("final lacks its marker", marker.isNull()),
        ("marker conflicts with the label", marker.isNotNull() & F.col("expected").isin("determined", "undetermined") & (marker != F.col("expected"))),
        ("final cites unread evidence", F.size(F.array_except(evidence_ids("final"), F.col("_seen"))) > 0),
    ]
    out += [ended.where(bad).select("case_id", whole, F.lit(rule).alias("rule")) for rule, bad in rules]
    shown = ended.join(withheld.where(F.length("value") >= 4), "case_id")
    shows = F.contains(F.concat_ws(" ", "_said", F.lower("final")), F.lower("value"))
    out.append(shown.where(shows).select("case_id", whole, F.lit("a withheld identifier shows").alias("rule")).distinct())
    return reduce(DataFrame.unionByName, out)


def plan_messages(rounds: DataFrame, items: DataFrame, finals: DataFrame, briefs: DataFrame, final_only: bool = False) -> DataFrame:
    """(case_id, pos, role, content, call_id, loss): the conversation that a plan makes. Only what the model says is
    learned from, or its final answer alone, as in samples written by hand; a request's answer holds the items that are
    new, and names those that were there already."""
    folded = deliveries(rounds, items, ["case_id"])
    call = F.concat(F.lit("call_"), F.lpad(F.col("round").cast("string"), 3, "0"))
    texts = items.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", F.struct("evidence_id", "neutral_title", "text", "source_id").alias("item")))).alias("_items"))
    both = folded.join(texts, "case_id", "left")
    again = F.when(F.size("already_delivered") > 0, F.col("already_delivered"))
    answer = F.to_json(F.struct(F.transform("fresh", lambda i: F.try_element_at("_items", i)).alias("evidence_items"), again.alias("already_delivered")))
    row = lambda pos, role, content, c, loss: [pos.cast("int").alias("pos"), F.lit(role).alias("role"), content.alias("content"), c.alias("call_id"), F.lit(loss).alias("loss")]
    none = F.lit(None).cast("string")
    length = rounds.groupBy("case_id").agg(F.max("round").alias("_last"))
    return (
        briefs.select("case_id", *row(F.lit(0), "user", F.col("brief"), none, False))
        .unionByName(folded.select("case_id", *row(F.col("round") * 2 - 1, "assistant", F.col("note"), call, not final_only)))
        .unionByName(both.select("case_id", *row(F.col("round") * 2, "tool", answer, call, False)))
        .unionByName(finals.join(length, "case_id", "left").select("case_id", *row(F.coalesce("_last", F.lit(0)) * 2 + 1, "assistant", F.col("final"), none, True)))
    )


def run_status(turns: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """By rollout: status, final_answer, turns and marker. turns: keys, turn, assistant, call_ids (null: no call),
    call_errors, runtime_error, stop (why a generation was cut off, or null).

    A failed turn or one that was cut off ends the run; so does a turn without a call, as the final answer, which is
    malformed if the call was; otherwise the turns ran out."""
    last = F.max_by(F.struct("assistant", "call_ids", F.coalesce("call_errors", F.array().cast(NONE)).alias("call_errors"), "runtime_error", "stop"), "turn")
    ended = turns.groupBy(*keys).agg(last.alias("_l"), F.count("*").alias("turns"), F.sum(F.col("call_ids").isNotNull().cast("int")).alias("fetch_rounds"))
    stop, silent = F.col("_l.stop"), F.col("_l.call_ids").isNull()
    status = (
        F.when(F.col("_l.runtime_error").isNotNull(), "runtime_error")
        .when(stop.isNotNull(), F.when(stop.isin(*BUDGETS), stop).otherwise("context_limit"))
        .when(silent, F.when(F.size("_l.call_errors") > 0, "malformed_final").otherwise("final"))
        .otherwise(F.when(F.col("turns") >= limit, "turn_limit").otherwise("unfinished"))
    )
    out = ended.withColumn("status", status).withColumn("final_answer", F.when(F.col("status").isin("final", "malformed_final"), F.col("_l.assistant")))
    return out.withColumn("marker", closure_marker("final_answer")).select(*keys, "status", "final_answer", "turns", "fetch_rounds", "marker")


def lane_violations(items: DataFrame, families: DataFrame, lane: str) -> DataFrame:
    """(case_id, rule): cases that a privacy lane must not call for. Private cases of the host family stay on their own
    route, and no other case comes there; public lanes take none of them; a case without a known family goes nowhere."""
    joined = items.join(families.select("case_id", "family"), "case_id", "left")
    host = F.coalesce(F.col("family") == "host", F.lit(False))
    rules = {
        "private_host_restricted": [("not a host case on the private route", ~host | ~F.coalesce(F.col("route") == "api", F.lit(False)))],
        "public_nonmedical": [("a host case on a public route", host)],
    }
    if lane not in rules:
        raise ValueError(f"unknown lane {lane!r}")
    every = [("no known family", F.col("family").isNull()), *rules[lane]]
    twice = items.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("a case is there twice").alias("rule"))
    found = [joined.where(bad).select("case_id", F.lit(rule).alias("rule")) for rule, bad in every]
    return reduce(DataFrame.unionByName, found, twice)


def training_rows(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases with their key items: what the teacher's final answer cites, those of them that a run has to fetch, and what
    is wrong. cases: case_id, final, opening, closure; labels: case_id, closure of the split's metadata."""
    key = F.array_distinct(evidence_ids("final"))
    out = cases.join(labels.select("case_id", F.col("closure").alias("_label")), "case_id", "left").withColumn("key_ids", key)
    out = out.withColumn("key_fetchable_ids", F.array_except("key_ids", "opening")).withColumn("teacher_marker", closure_marker("final"))
    wrong = F.array(
        F.when(F.col("_label").isNull(), "no metadata"), F.when(F.col("_label") != F.col("closure"), "label differs from metadata"),
        F.when(~F.col("teacher_marker").eqNullSafe(F.col("closure")), "marker differs from label"), F.when(F.size("key_fetchable_ids") == 0, "no fetchable key"),
    )
    return out.withColumn("problems", F.array_compact(wrong)).drop("_label")


def by_family(pool: DataFrame, packages: DataFrame, references: DataFrame, trajectories: DataFrame) -> DataFrame:
    """(case_id, family, package_hash, reference): host cases take their reference from a trajectory, all others from a
    reference file; a pool row without both is left out, so that a count shows it."""
    both = pool.join(packages, "case_id")
    host = both.where("family = 'host'").join(trajectories.select("case_id", F.col("result").alias("reference")), "case_id")
    others = both.where("family <> 'host'").join(references.select("case_id", "reference"), "case_id")
    return host.select("case_id", "family", "package_hash", "reference").unionByName(others.select("case_id", "family", "package_hash", "reference"))
