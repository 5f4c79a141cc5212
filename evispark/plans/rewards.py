"""Rewards, requests to judges and behaviour, over the cases that `case_tables` makes out of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import text as t
from evispark.operators import compile as comp
from evispark.operators import judging
from evispark.operators import rewards as r
from evispark.plans.case_tables import CASES, case_tables
from evispark.plans.registry import query
from evispark.sources.readers import table

KEYED = CASES + """
, keyed AS (SELECT folded.*, list_sort(list_filter(known, lambda x: x LIKE '%.2' AND x NOT LIKE 'E1.%')) AS key FROM folded),
asked AS (SELECT *, len(list_filter(fresh, lambda x: list_contains(key, x))) AS hits FROM keyed WHERE len(unknown) = 0)
"""


def keyed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds with what was seen; every second item outside the record is a key item."""
    tables = case_tables(spark, sf_dir)
    folded = comp.deliveries(tables["rounds"], tables["items"], ["case_id"])
    key = F.sort_array(F.filter("known", lambda i: i.endswith(".2") & ~i.startswith("E1.")))
    return folded.withColumn("key_ids", key).withColumn("valid", F.size("unknown") == 0)


@query(KEYED + """
SELECT case_id, round, CAST(len(fetch_ids) AS INT) AS n_ids, CAST(len(list_filter(fetch_ids, lambda x: NOT list_contains(seen, x))) AS INT) AS n_new, CAST(hits AS INT) AS key_new, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k1, round(hits / len(fetch_ids), 6) AS k2,
  CAST(len(list_filter(key, lambda x: NOT list_contains(seen, x))) AS INT) AS unread, round(0.3 * CASE WHEN hits > 0 THEN 1 ELSE 0 END + 0.2 * hits / len(fetch_ids) + CASE round % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.1 END, 6) AS score FROM asked
""")
def fetch_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program and judged parts of every valid request; a third isn't judged, a third is well judged."""
    out = r.fetch_program(keyed_rounds(spark, sf_dir).where("valid"), ["case_id"], "fetch_ids", "key_ids", "round")
    judged = lambda good, bad: F.when(F.col("round") % 3 == 1, good).when(F.col("round") % 3 == 2, bad)
    score = r.request_score(F.col("K1"), F.col("K2"), judged("yes", "no"), judged("no", "yes"), judged("no", "no"))
    return out.select("case_id", "round", "n_ids", "n_new", "key_new", F.col("K1").alias("k1"), F.round("K2", 6).alias("k2"), F.size("unread_key_before").alias("unread"), F.round(score, 6).alias("score"))


@query(KEYED + """
, each AS (SELECT case_id, any_value(key) AS key, avg(least(1.0, 3.0 * hits / len(fetch_ids))) AS mean, list_distinct(flatten(list(fetch_ids))) AS ids, list_distinct(flatten(list(fresh))) AS fetched FROM asked GROUP BY case_id)
SELECT case_id, round(CASE WHEN len(key) = 0 THEN 0.0 ELSE (mean + least(1.0, 3.0 * len(list_filter(ids, lambda x: list_contains(key, x))) / len(ids))) / 2 END, 6) AS key_hit,
  round(CASE WHEN len(key) = 0 THEN 0.0 ELSE len(list_filter(fetched, lambda x: list_contains(key, x))) / len(key) END, 6) AS key_coverage FROM each
""")
def key_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed_rounds(spark, sf_dir).where("valid")
    hit = r.key_hit(rows, ["case_id"], "fresh", "fetch_ids", "key_ids")
    covered = rows.groupBy("case_id").agg(F.round(r.key_coverage(F.array_distinct(F.flatten(F.collect_list("fresh"))), F.first("key_ids")), 6).alias("key_coverage"))
    return hit.withColumn("key_hit", F.round("key_hit", 6)).join(covered, "case_id")


@query("""
WITH d AS (SELECT doc_id, quality, toxic, doc_id % 11 AS a, doc_id % 7 AS b, CASE doc_id % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'not_closed' END AS decision, CASE quality WHEN 1 THEN 'closed' ELSE 'not_closed' END AS label FROM labels),
p AS (SELECT *, (0.05 * a + 0.05 * b) / 2 + 0.25 AS fet, greatest(-1.0, least(1.0, (-0.5 + a / 10.0) * 2 + (-0.5 + b / 10.0))) AS hyp, CASE WHEN decision IS NULL THEN 0.0 WHEN decision = label THEN 0.5 ELSE -0.5 END AS status,
  CASE decision WHEN 'closed' THEN -1 + 0.2 * a WHEN 'not_closed' THEN -0.5 + 0.1 * a - 0.5 + 0.1 * b ELSE 0.0 END AS judged FROM d)
SELECT doc_id, round(CAST(fet + hyp + status + judged - 0.4 AS DOUBLE), 6) + 0.0 AS total, round(CAST(0.25 + status - 0.4 AS DOUBLE), 6) + 0.0 AS program, round(CAST(2 * fet + 0.5 * hyp + status + judged - 0.4 AS DOUBLE), 6) + 0.0 AS weighted FROM p
""")
def first_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reward from scores of documents, by its program's parts alone, and by other weights."""
    k = F.col("doc_id")
    a, b = (k % 11).cast("int"), (k % 7).cast("int")
    decision, label = F.when(k % 3 == 0, "closed").when(k % 3 == 1, "not_closed"), F.when(F.col("quality") == 1, "closed").otherwise("not_closed")
    total = lambda **more: F.round(r.first_total(decision, label, a.cast("double"), b.cast("double"), F.array(a, b), F.array(a, a, b), F.lit(0.25), F.lit(-0.4), **more), 6) + 0.0
    return table(spark, sf_dir, "labels").select("doc_id", total().alias("total"), total(phase=1).alias("program"), total(weights={"fetch": 2.0, "hypothesis": 0.5}).alias("weighted"))


@query("""
WITH d AS (SELECT doc_id, ['yes', 'no', 'partial'][CAST(doc_id % 3 + 1 AS INT)] AS x, ['yes', 'no'][CAST(doc_id % 2 + 1 AS INT)] AS y, doc_id % 5 AS n FROM labels),
q AS (SELECT *, CASE x WHEN 'yes' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS xs, CASE y WHEN 'yes' THEN 1.0 ELSE 0.0 END AS ys, CASE WHEN n > 0 THEN 1 - 1.0 / n ELSE 0.0 END AS c3 FROM d)
SELECT doc_id, round(CAST(0.35 * xs + 0.25 * ys + 0.20 * CASE WHEN x = 'yes' THEN 1 ELSE 0 END + 0.20 * ys AS DOUBLE), 6) AS conclusion, round(CAST(0.3 * ys + 0.4 * CASE WHEN x = 'yes' THEN 1 ELSE 0 END + 0.3 * ys AS DOUBLE), 6) AS gap,
  round(CAST(0.2 * ys + 0.2 * xs + 0.2 * ys + 0.2 * c3 + 0.2 * CASE WHEN x = 'yes' THEN 1 ELSE 0 END AS DOUBLE), 6) AS later_conclusion, round(CAST(CASE WHEN y = 'yes' THEN 0.3 + 0.4 * CASE WHEN x = 'yes' THEN 1 ELSE 0 END + 0.3 * ys ELSE 0.5 * ys END AS DOUBLE), 6) AS later_gap,
  CASE WHEN n > 2 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS gate FROM q
""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    x, y, n = F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("partial"), F.when(k % 2 == 0, "yes").otherwise("no"), k % 5
    c3 = r.claims_share(n, F.lit(1))
    parts = {"conclusion": r.conclusion_quality(x, y, x, y), "gap": r.gap_quality(y, x, y), "later_conclusion": r.later_conclusion_quality(y, x, y, c3, x), "later_gap": r.later_gap_quality(y, x, y)}
    gate = r.gate(F.when(n > 2, 1.0).otherwise(-1.0))
    return table(spark, sf_dir, "labels").select("doc_id", *[F.round(v, 6).alias(name) for name, v in parts.items()], gate.cast("double").alias("gate"))


@query("""
WITH d AS (SELECT doc_id % 6 AS k, count(*) AS n FROM documents GROUP BY 1), e(k, h1, h2, h3, h4, h5, score) AS (VALUES (0, true, true, false, false, true, 1.0), (1, true, false, true, false, false, 0.15), (2, true, false, true, true, true, 0.15), (3, false, false, false, false, true, 1.0), (4, true, false, false, false, false, 0.45), (5, false, false, false, true, false, 0.0))
SELECT k, h1, h2, h3, h4, h5, CAST(score AS DOUBLE) AS score, n FROM d JOIN e USING (k)
""")
def hypothesis_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of update, judged: moved rightly, not moved, another one moved, nothing to move, unknown rank, moved idly."""
    k = (F.col("doc_id") % 6).alias("k")
    judged = [(("H1", True, "supports", True), ("H2", True, "weakens", False)), (("H1", True, "supports", True), ("H2", False, "unrelated", False)), (("H1", True, "weakens", True), ("H2", False, "unrelated", False)),
              (("H1", False, "unrelated", False), ("H2", False, "unrelated", False)), (("H1", True, "supports", True), ("H2", False, "unrelated", False)), (("H1", False, "unrelated", False), ("H3", False, "unrelated", False))]
    updates = ["H1 [open → favored] H2 [open -> weakened]", "H1 [open → open]", "H2 [open → favored]", "nothing", "H1 [open → strange]", "H3 [favored → weakened]"]
    rows = [(i, u, [dict(zip(("hypothesis", "touched", "direction", "main"), h)) for h in j], i in (0, 2, 3)) for i, (u, j) in enumerate(zip(updates, judged))]
    told = spark.createDataFrame(rows, "k bigint, u string, j array<struct<hypothesis:string,touched:boolean,direction:string,main:boolean>>, g boolean")
    each = table(spark, sf_dir, "documents").groupBy(k).agg(F.count("*").alias("n")).join(told, "k").withColumn("p", r.hypothesis_program(F.col("u"), F.col("j"), F.col("g")))
    flags = [F.col(f"p.h{i}") for i in range(1, 6)]
    return each.select("k", *[c.alias(f"h{i}") for i, c in enumerate(flags, 1)], F.round(r.update_score(*flags), 6).alias("score"), "n")


REQUESTS = KEYED + r"""
, titled AS (SELECT case_id, map_from_entries(list((evidence_id, neutral_title))) AS titles FROM items GROUP BY case_id),
lines AS (SELECT a.*, titles, list_transform(fetch_ids, lambda x: x || ' | ' || titles[x] || CASE WHEN list_contains(seen, x) THEN ' | ALREADY READ' ELSE ' | NEW' END) AS req, list_transform(list_filter(key, lambda x: NOT list_contains(seen, x)), lambda x: x || ' | ' || titles[x]) AS unread FROM asked a JOIN titled USING (case_id))
"""


def judged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, question, items, key_ids)."""
    items = case_tables(spark, sf_dir)["items"]
    value = F.struct(F.col("neutral_title").alias("title"), F.lit("observation").alias("kind"), F.lit("body").alias("text"))
    ids = F.filter(F.sort_array(F.collect_set("evidence_id")), lambda i: i.endswith(".2") & ~i.startswith("E1."))
    return items.groupBy("case_id").agg(F.lit("q").alias("question"), F.map_from_entries(F.collect_list(F.struct("evidence_id", value))).alias("items"), ids.alias("key_ids"))


@query(REQUESTS + r"""
, body AS (SELECT case_id, round, row_number() OVER (PARTITION BY case_id ORDER BY round) AS nth, '## State at the moment of the request' || chr(10) || note || chr(10) || chr(10) || '## Already read' || chr(10) || CASE WHEN len(seen) > 0 THEN array_to_string(list_sort(seen), ', ') ELSE '(none)' END || chr(10) || chr(10) ||
  '## Requested' || chr(10) || array_to_string(req, chr(10)) || chr(10) || chr(10) || '## Stated reason' || chr(10) || reason || chr(10) || chr(10) || '## Key items still unread (not shown to the investigator)' || chr(10) || CASE WHEN len(unread) > 0 THEN array_to_string(unread, chr(10)) ELSE '(none)' END AS body FROM lines)
SELECT case_id, sha256('# Task question' || chr(10) || 'q' || chr(10) || chr(10) || string_agg('# ' || nth || chr(10) || body, chr(10) || chr(10) ORDER BY round) || chr(10) || chr(10) || 'Answer for every request.') AS digest, CAST(count(*) AS INT) AS n_items FROM body GROUP BY case_id
""")
def fetch_judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = keyed_rounds(spark, sf_dir).drop("key_ids").select("case_id", F.col("round").alias("turn"), F.col("note").alias("assistant"), F.col("fetch_ids").alias("call_ids"), "reason", "seen_before", "valid")
    out = judging.fetch_requests(folded, judged_cases(spark, sf_dir), ["case_id"])
    return out.select("case_id", F.sha2("request", 256).alias("digest"), "n_items")


@query(REQUESTS + r"""
, pairs AS (SELECT folded.*, lag(note) OVER w AS before, lag(fresh) OVER w AS returned, lag(len(unknown) > 0) OVER w AS failed FROM folded WINDOW w AS (PARTITION BY case_id ORDER BY round)),
body AS (SELECT case_id, round, row_number() OVER (PARTITION BY case_id ORDER BY round) AS nth, '## State before' || chr(10) || before || chr(10) || chr(10) || '## Just returned' || chr(10) || CASE WHEN failed THEN '(the fetch failed: unknown id)' WHEN len(returned) = 0 THEN '(no new evidence)' ELSE array_to_string(list_transform(returned, lambda x: x || ' | ' || titles[x] || ' | observation' || chr(10) || 'body'), chr(10) || chr(10)) END ||
  chr(10) || chr(10) || '## Update' || chr(10) || note AS body FROM pairs JOIN titled USING (case_id) WHERE before IS NOT NULL)
SELECT case_id, sha256('# Task question' || chr(10) || 'q' || chr(10) || chr(10) || string_agg('# ' || nth || chr(10) || body, chr(10) || chr(10) ORDER BY round) || chr(10) || chr(10) || 'Answer for every update.') AS digest, CAST(count(*) AS INT) AS n_items FROM body GROUP BY case_id
""")
def hypothesis_judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = keyed_rounds(spark, sf_dir).drop("key_ids").select("case_id", F.col("round").alias("turn"), F.col("note").alias("assistant"), F.col("fetch_ids").alias("call_ids"), F.lit(None).cast("array<string>").alias("call_errors"), "fresh", F.when(~F.col("valid"), "unknown id").alias("return_error"))
    out = judging.hypothesis_requests(turns, judged_cases(spark, sf_dir), ["case_id"])
    return out.select("case_id", F.sha2("request", 256).alias("digest"), "n_items")


@query(REQUESTS + r"""
, e AS (SELECT f.case_id, conv_id, final, titles, CASE WHEN final LIKE 'CASE CLOSED%' THEN 'E1.1' ELSE 'E2.1' END AS cited, list_sort(map_keys(titles)) AS store FROM finals f JOIN titled USING (case_id) WHERE final LIKE 'CASE%')
SELECT case_id, sha256('# Task question' || chr(10) || 'q' || chr(10) || chr(10) || '# Decision' || chr(10) || CASE WHEN final LIKE 'CASE CLOSED%' THEN 'CASE CLOSED' ELSE 'CASE NOT CLOSED' END || chr(10) || chr(10) || '# Final answer' || chr(10) || final || chr(10) || chr(10) || '# Cited items' || chr(10) ||
  CASE WHEN list_contains(store, cited) THEN cited || ' | ' || titles[cited] || ' | observation' || chr(10) || 'body' ELSE cited || ' | (no such item in the case)' END || CASE WHEN cited = 'E1.1' THEN '' ELSE '  [CITED BUT NEVER READ]' END || chr(10) || chr(10) || '# Read' || chr(10) || 'E1.1 | ' || titles['E1.1'] || chr(10) || chr(10) ||
  '# Not read' || chr(10) || CASE WHEN len(store) > 1 THEN array_to_string(list_transform(list_transform(list_sort(list_transform(list_filter(store, lambda x: x <> 'E1.1'), lambda x: CAST(split_part(substr(x, 2), '.', 1) AS INT) * 10 + CAST(split_part(x, '.', 2) AS INT))), lambda n: 'E' || (n // 10) || '.' || (n % 10)), lambda x: x || ' | ' || titles[x]), chr(10)) ELSE '(none)' END || chr(10) || chr(10) ||
  '# Reference (not shown to the investigator)' || chr(10) || CASE conv_id % 2 WHEN 0 THEN 'CASE CLOSED' ELSE 'CASE NOT CLOSED' END || chr(10) || chr(10) || '(none)' || chr(10) || chr(10) || 'offic [...]' || chr(10) || chr(10) || 'one' || chr(10) || 'two' || chr(10) || chr(10) ||
  CASE WHEN final LIKE 'CASE CLOSED%' THEN 'Score the conclusion; the gap must be null (the case was closed).' ELSE 'Score the conclusion and the gap.' END) AS digest, CAST(1 AS INT) AS n_items FROM e
""")
def closure_judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    finals = case_tables(spark, sf_dir)["finals"]
    results = finals.select("case_id", F.col("final").alias("final_answer"), F.array(F.lit("E1.1")).alias("disclosed"), t.closure_marker("final").alias("marker"))
    closure = F.when(F.col("conv_id") % 2 == 0, "closed").otherwise("not_closed")
    more = finals.select("case_id", closure.alias("closure"), F.lit("official").alias("official"), F.lit(None).cast("string").alias("teacher_final"), F.array(F.lit("one"), F.lit("two")).alias("alternatives"))
    out = judging.closure_requests(results, judged_cases(spark, sf_dir).join(more, "case_id"), ["case_id"], most=5)
    return out.select("case_id", F.sha2("request", 256).alias("digest"), "n_items")


@query(KEYED + r"""
, h AS (SELECT *, ['H1'] || CASE WHEN round % 2 = 0 THEN ['H2'] ELSE [] END AS hs, round % 4 = 3 AS erred FROM keyed),
f AS (SELECT case_id, count(*) AS turns, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS hypothesis_count, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS most, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS later, count(*) AS fetches, avg(len(fetch_ids)) AS per_fetch,
  sum(CASE WHEN len(unknown) = 0 AND NOT erred THEN len(again) ELSE 0 END) AS rerequested, count(*) FILTER (erred OR len(unknown) > 0) AS invalid, avg(round * 10.0) AS tokens, list_distinct(flatten(list(CASE WHEN len(unknown) = 0 AND NOT erred THEN fetch_ids ELSE [] END))) AS fetched, any_value(key) AS key FROM h GROUP BY case_id)
SELECT f.case_id, CAST(hypothesis_count AS INT) AS hypothesis_count, CAST(most AS INT) AS hypothesis_count_max_per_turn, CAST(later AS BIGINT) AS new_hypotheses_after_turn1, fetches, per_fetch AS ids_per_fetch, CAST(rerequested AS BIGINT) AS rerequested_items, invalid AS invalid_fetch_turns, invalid / fetches AS invalid_format_rate, tokens AS tokens_per_turn,
  CAST(CASE WHEN turns > 1 THEN 1 ELSE 0 END AS BIGINT) AS hypotheses_ruled_out, CAST(turns // 2 + (turns - 1) // 2 - 0 AS BIGINT) AS leading_switches, CASE WHEN len(key) > 0 THEN len(list_filter(fetched, lambda x: list_contains(key, x))) / len(key) END AS key_recall,
  CASE WHEN len(key) > 0 AND len(fetched) > 0 THEN len(list_filter(fetched, lambda x: list_contains(key, x))) / len(fetched) END AS key_precision, CAST(length(final) AS INT) AS final_answer_chars, CAST(CASE WHEN final LIKE 'CASE%' THEN 1 ELSE 0 END AS INT) AS final_citations, true AS citations_valid FROM f JOIN finals USING (case_id)
""")
def rollout_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns state H2 too and favour it over H1, odd ones favour H1 and rule H2 out."""
    rows, k = keyed_rounds(spark, sf_dir), F.col("round")
    said = F.when(k % 2 == 0, "## Current hypotheses\nH1 — a\nH2 — b\n## Hypothesis ledger\nH1 [favored → open]\nH2 [open → favored]").otherwise("## Current hypotheses\nH1 — a\n## Hypothesis ledger\nH1 [open → favored]\nH2 [favored → ruled out]")
    last = F.max("round").over(Window.partitionBy("case_id")) == k
    said = F.when((k == 1) & last, "## Current hypotheses\nH1 — a\n## Hypothesis ledger\nH1 [open → favored]").when(last & (k % 2 == 0), "## Current hypotheses\nH1 — a\nH2 — b\n## Hypothesis ledger\nH1 [favored → ruled out]\nH2 [open → favored]").otherwise(said)
    turns = rows.select("case_id", k.alias("turn"), said.alias("assistant"), F.col("fetch_ids").alias("call_ids"), F.when(k % 4 == 3, F.array(F.lit("trailing text"))).alias("call_errors"), F.when(~F.col("valid"), "unknown id").alias("return_error"), "seen_before", "fresh", (k * 10).alias("gen_tokens"))
    finals = case_tables(spark, sf_dir)["finals"].select("case_id", F.col("final").alias("final_answer"), F.lit(True).alias("citations_seen"))
    return judging.behaviour(turns, finals, rows.groupBy("case_id").agg(F.first("key_ids").alias("key_ids")), ["case_id"])
