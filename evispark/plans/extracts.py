"""Extraction steps, ledgers, judge answers, run summaries and calls, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import numeric as nf
from evispark.functions import text as t
from evispark.operators import evaluation, extraction, judging, ledgers, windows
from evispark.plans.case_tables import CASES, case_tables
from evispark.plans.registry import query
from evispark.sources import readers
from evispark.sources.readers import table
from evispark.streaming import folds, modelcall

BLOCKS = """
WITH b AS (SELECT 'c' || conv_id AS case_id, CAST(turn AS INT) AS block_idx, CASE WHEN (conv_id + turn) % 4 = 0 THEN NULL WHEN conv_id % 3 = 0 AND turn = 1 THEN 'conclusion' ELSE 'analysis' END AS declared, CASE WHEN turn % 3 = 2 THEN 'Findings' ELSE 'Section' END AS label, text, conv_id FROM conversations),
r AS (SELECT *, coalesce(declared, CASE WHEN block_idx % 2 = 0 THEN 'mixed' END, 'appendix') AS role FROM b)
"""


def role_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t_ = F.col("conv_id"), F.col("turn")
    declared = F.when((k + t_) % 4 == 0, None).when((k % 3 == 0) & (t_ == 1), "conclusion").otherwise("analysis")
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), k).alias("case_id"), t_.cast("int").alias("block_idx"), declared.alias("role"), F.when(t_ % 3 == 2, "Findings").otherwise("Section").alias("label"), "text")
    labels = rows.where("block_idx % 2 = 0").select("case_id", "block_idx", F.lit("mixed").alias("label_role"))
    return extraction.label_blocks(rows, labels)


@query(BLOCKS + "SELECT role, count(*) AS n FROM r GROUP BY role")
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_blocks(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"))


@query(BLOCKS + """
, g AS (SELECT case_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FILTER (role IN ('analysis', 'mixed')), '') AS analysis, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FILTER (role = 'conclusion'), '') AS c,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_idx) FILTER (label = 'Findings'), '') AS h, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS whole FROM r GROUP BY case_id)
SELECT case_id, sha256(analysis) AS analysis, sha256(CASE WHEN c <> '' THEN c WHEN h <> '' THEN h ELSE right(whole, 4000) END) AS conclusion, CASE WHEN c <> '' THEN 'declared' WHEN h <> '' THEN 'by_heading' ELSE 'by_position' END AS status FROM g
""")
def routed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction.route_texts(role_blocks(spark, sf_dir))
    return out.select("case_id", F.sha2("analysis", 256).alias("analysis"), F.sha2("conclusion", 256).alias("conclusion"), "status")


@query(CASES + """
, kept AS (SELECT case_id, pos, split_part(evidence_id, '.', 1) AS label FROM items WHERE pos % 5 <> 4), f AS (SELECT *, min(pos) OVER (PARTITION BY case_id, label) AS first_pos FROM kept)
SELECT case_id, 'E' || dense_rank() OVER (PARTITION BY case_id ORDER BY first_pos) || '.' || row_number() OVER (PARTITION BY case_id, label ORDER BY pos) AS evidence_id, pos, CAST(NULL AS VARCHAR) AS reference_id FROM f
UNION ALL SELECT case_id, CAST(NULL AS VARCHAR), round, 'C' || row_number() OVER (PARTITION BY case_id ORDER BY round) FROM rounds WHERE round % 3 <> 0
""")
def reviewed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth item leaks; every third rejection is none."""
    tables = case_tables(spark, sf_dir)
    items = tables["items"].select("case_id", "pos", "evidence_id", F.split("evidence_id", r"\.")[0].alias("label"), F.lit(0).alias("group_no"), F.lit(0).alias("item_no"))
    rejections = tables["rounds"].select("case_id", F.col("round").alias("idx"))
    verdicts = rejections.where("idx % 3 <> 1").withColumn("verdict", F.when(F.col("idx") % 3 == 0, "not_a_rejection").otherwise("sound"))
    kept, left = extraction.apply_review(items, items.where("pos % 5 = 4").select("case_id", "evidence_id"), rejections, verdicts)
    none = F.lit(None).cast("string")
    return kept.select("case_id", "evidence_id", "pos", none.alias("reference_id")).unionByName(left.select("case_id", none.alias("evidence_id"), F.col("idx").alias("pos"), "reference_id"))


@query("""
WITH w AS (SELECT doc_id, text, string_split(lower(text), ' ') AS ws FROM documents), n AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[a-z0-9][a-z0-9''\\-.]*') AS raw, regexp_extract_all(trim(regexp_replace(lower(substr(text, 1, CAST(length(text) // 2 AS BIGINT))), '\\s+', ' ', 'g')), '[a-z0-9][a-z0-9''\\-.]*') AS half FROM documents),
f AS (SELECT doc_id, list_filter(raw, lambda x: length(x) > 1 AND NOT list_contains([STOPS], x)) AS source, list_filter(half, lambda x: length(x) > 1 AND NOT list_contains([STOPS], x)) AS pool FROM n)
SELECT doc_id, round(CASE WHEN len(source) = 0 THEN 1.0 ELSE len(list_filter(source, lambda x: list_contains(pool, x))) / len(source) END, 6) AS coverage FROM f
""".replace("STOPS", ", ".join(f"'{w}'" for w in t.STOP_WORDS)))
def block_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a document the first half of it covers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    halves = docs.select("doc_id", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))
    return extraction.block_coverage(halves, docs, ["doc_id"]).select("doc_id", F.round("coverage", 6).alias("coverage"))


@query(CASES + """
, s AS (SELECT case_id, round, round % 5 = 4 AS gap, round % 4 = 3 AS idle FROM rounds),
c AS (SELECT case_id, round, count(*) OVER (PARTITION BY case_id) AS n FROM s)
SELECT 'a state changed without a citation' AS rule, count(*) AS n FROM s WHERE idle HAVING count(*) > 0 UNION ALL SELECT 'the next check is not the request''s reason', count(*) FROM s WHERE gap HAVING count(*) > 0
""")
def ledger_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled turns: in every round H2 moves, without a citation in some; some requests give another reason."""
    rounds, k = case_tables(spark, sf_dir)["rounds"], F.col("round")
    hypotheses = F.explode(F.array(F.lit("H1"), F.lit("H2"))).alias("hypothesis")
    claims = rounds.select("case_id").distinct().select("case_id", hypotheses).withColumn("claim", F.lit("a stable claim"))
    status = F.when(F.col("hypothesis") == "H1", "open").otherwise(F.when(k % 2 == 1, "favored").otherwise("weakened"))
    states = rounds.select("case_id", "round", hypotheses).withColumn("status", status).withColumn("basis", F.when(k % 4 == 3, "nothing cited here").otherwise("as E1.1 shows"))
    turns = ledgers.compile_turns(rounds, claims, states).join(rounds.select("case_id", "round", "reason"), ["case_id", "round"])
    turns = turns.withColumn("reason", F.when(k % 5 == 4, "another").otherwise(F.col("reason")))
    return ledgers.problems(turns).groupBy("rule").agg(F.count("*").alias("n"))


@query(CASES + """
, m AS (SELECT case_id, round, CASE WHEN round % 3 = 0 THEN 'weakened' ELSE 'open' END AS before, 'open' AS after FROM rounds)
SELECT case_id, count(*) AS n FROM m WHERE round > 1 AND before <> 'open' GROUP BY case_id
""")
def broken_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = case_tables(spark, sf_dir)["rounds"].select("case_id", "round", F.lit("H1").alias("hypothesis"), F.when(F.col("round") % 3 == 0, "weakened").otherwise("open").alias("before"), F.lit("open").alias("after"))
    return windows.ledger_breaks(moves, ["case_id"], "round").groupBy("case_id").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT conv_id, turn, text, row_number() OVER w AS nth FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, lag(nth % 3 <> 0 OR nth % 2 = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS called, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM a)
SELECT conv_id, turn, CAST(length(before) AS INT) AS before FROM p WHERE called AND nth % 3 <> 0
""")
def hypothesis_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every third place make no call; those of every second one have call errors."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("assistant"), nth.alias("nth"))
    turns = turns.select("conv_id", "turn", "assistant", F.when(F.col("nth") % 3 != 0, F.array(F.lit("E1.1"))).alias("call_ids"), F.when(F.col("nth") % 2 == 0, F.array(F.lit("bad"))).alias("call_errors"))
    return windows.hypothesis_updates(turns, ["conv_id"], "turn").select("conv_id", "turn", F.length("before").alias("before"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
s AS (SELECT doc_id, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines FROM s GROUP BY ALL
""")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines stand for headings."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return windows.next_section(lines, ["doc_id"], "line_no", F.length("line") < 40).groupBy("doc_id", "section").agg(F.count("*").alias("lines"))


@query("""
WITH e AS (SELECT l_orderkey, l_discount - l_tax AS d FROM lineitem)
SELECT l_orderkey, round(sum(-least(exp(d) * 0.7, greatest(0.98, least(1.03, exp(d))) * 0.7)), 4) AS loss, round(sum(exp(-d) + d - 1), 5) AS divergence FROM e GROUP BY l_orderkey
""")
def token_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's discount and tax stand for a token's log-probabilities."""
    tokens = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_discount").cast("double").alias("n"), F.col("l_tax").cast("double").alias("o"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tokens.alias("t")).select("l_orderkey", F.col("t.n").alias("n"), F.col("t.o").alias("o"))
    total = lambda a, digits: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), digits)
    return rows.select("l_orderkey", total(nf.clipped_loss(F.col("n"), F.col("o"), F.lit(0.7), 0.02, 0.03), 4).alias("loss"), total(nf.k3_divergence(F.col("n"), F.col("o")), 5).alias("divergence"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("""
WITH d AS (SELECT doc_id % 8 AS k, count(*) AS n FROM documents GROUP BY 1), e(k, problem) AS (VALUES (0, NULL), (1, 'schema'), (2, 'missing_items'), (3, 'out_of_range'), (4, 'inconsistent'), (5, 'inconsistent'), (6, 'out_of_range'), (7, 'schema'))
SELECT k, problem, n FROM d JOIN e USING (k)
""")
def update_answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound answer, no JSON, too few items, a direction and a word that don't exist, a touched one that is unrelated, a
    main one that isn't touched, and a missing field."""
    one = '{"hyps":[{"id":"H1","touched":%s,"direction":"%s"}],"main":"%s","H5":{"answer":"%s"}}'
    item = lambda *x: '{"items":[' + one % x + "]}"
    answers = [item("true", "supports", "H1", "yes"), "none", '{"items":[]}', item("true", "sideways", "H1", "yes"), item("true", "unrelated", "H1", "yes"), item("true", "weakens", "H2", "no"), item("false", "unrelated", "", "maybe"), '{"items":[{"hyps":[{"id":"H1"}],"main":"H1","H5":{"answer":"yes"}}]}']
    told = spark.createDataFrame(list(enumerate(answers)), "k bigint, answer string")
    each = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 8).alias("k")).agg(F.count("*").alias("n")).join(told, "k")
    return judging.update_answers(each, "answer", F.lit(1)).select("k", "problem", "n")


@query("""
WITH d AS (SELECT doc_id % 6 AS k, count(*) AS n FROM documents GROUP BY 1), e(k, problem) AS (VALUES (0, NULL), (1, NULL), (2, 'inconsistent'), (3, 'missing_items'), (4, 'out_of_range'), (5, 'schema'))
SELECT k, problem, n FROM d JOIN e USING (k)
""")
def closure_answer_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = lambda x: '{"answer":"%s"}' % x
    conclusion = lambda c1b="partial": '{"C1a":%s,"C1b":%s,"C2":%s,"C4":%s,"claims":[{"claim":"c","supported":true}]}' % tuple(map(answer, ("yes", c1b, "no", "yes")))
    gap = '{"G1":%s,"G2":%s,"G3":%s}' % tuple(map(answer, ("yes", "no", "yes")))
    whole = lambda c, g: '{"conclusion":%s,"gap":%s}' % (c, g)
    rows = [(0, whole(conclusion(), "null"), True), (1, whole(conclusion(), gap), False), (2, whole(conclusion(), gap), True), (3, whole(conclusion(), "null"), False), (4, whole(conclusion("maybe"), gap), False), (5, whole("null", gap), False)]
    told = spark.createDataFrame(rows, "k bigint, answer string, closed boolean")
    each = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 6).alias("k")).agg(F.count("*").alias("n")).join(told, "k")
    return judging.closure_answers(each, "answer", F.col("closed")).select("k", "problem", "n")


@query("""
WITH r AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'not_closed' END AS marker, CASE conv_id % 2 WHEN 0 THEN 'closed' ELSE 'not_closed' END AS closure, conv_id % 4 AS source, count(*) AS turns FROM conversations GROUP BY conv_id),
g AS (SELECT *, marker IS NOT DISTINCT FROM closure AS ok FROM r), s AS (SELECT source, round(avg(CAST(ok AS INT)), 6) AS acc FROM g GROUP BY source)
SELECT count(*) AS records, round(avg(CAST(conv_id % 5 <> 0 AS INT)), 6) AS final_rate, round(avg(CAST(marker IS NULL AS INT)), 6) AS no_marker_rate, round(avg(CAST(conv_id % 7 = 0 AS INT)), 6) AS valid_citation_rate, round(avg(conv_id % 3), 6) AS tool_error_turns_per_case, round(avg(turns), 6) AS turns_per_case, round(avg(turns - 1), 6) AS fetch_rounds_per_case,
  round(avg(CAST(conv_id % 5 = 0 AS INT)), 6) AS turn_limit_rate, round(avg(CAST(ok AS INT)) FILTER (closure = 'closed'), 6) AS acc_closed, round(avg(CAST(ok AS INT)) FILTER (closure = 'not_closed'), 6) AS acc_not_closed, round((avg(CAST(ok AS INT)) FILTER (closure = 'closed') + avg(CAST(ok AS INT)) FILTER (closure = 'not_closed')) / 2, 6) AS balanced, (SELECT round(sum((source + 1) * acc), 4) FROM s) AS by_source FROM g
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    records = each.select(k.cast("string").alias("case_id"), (k % 4).alias("source"), F.when(k % 5 == 0, "turn_limit").otherwise("final").alias("status"), F.when(k % 3 == 0, "closed").when(k % 3 == 1, "not_closed").alias("marker"), F.when(k % 7 == 0, True).alias("citations_seen"), (k % 3).alias("error_turns"), "turns", (F.col("turns") - 1).alias("fetch_rounds"))
    out = evaluation.summary(records, each.select(k.cast("string").alias("case_id"), F.when(k % 2 == 0, "closed").otherwise("not_closed").alias("closure")))
    weighed = F.aggregate(F.map_entries("acc_by_source"), F.lit(0.0), lambda s, e: s + (e["key"] + 1) * e["value"])
    return out.withColumn("by_source", F.round(weighed, 4)).drop("acc_by_source")


@query("""
WITH c AS (SELECT event_type, event_id, user_id % 3 AS key, event_id % 4 = 0 AS cached, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 + event_id % 3 END AS attempts, event_id % 5 = 1 AS timeout, event_id % 7 = 1 AS broken, event_id % 7 = 2 AS cut, value FROM events)
SELECT event_type, count(*) AS requests, CAST(count(*) FILTER (cached) AS BIGINT) AS cache_hits, CAST(sum(attempts) AS BIGINT) AS http_attempts, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 10) AS BIGINT) AS completion_tokens, round(sum(value), 6) AS cost,
  round(count(*) FILTER (broken) / sum(attempts), 6) AS parse_failure_rate, CAST(count(*) FILTER (timeout) AS BIGINT) AS timeouts, CAST(count(*) FILTER (cut) AS BIGINT) AS truncated, CAST(count(*) FILTER (key = 1 AND NOT cached) AS BIGINT) AS of_key FROM c GROUP BY event_type
""")
def judge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("event_id"), F.array().cast("array<string>")
    one = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(none)
    cached = k % 4 == 0
    calls = table(spark, sf_dir, "events").select("event_type", cached.alias("cached"), F.when(cached, 0).otherwise(1 + k % 3).alias("attempts"), one(k % 5 == 1, "timeout").alias("errors"), F.concat(one(k % 7 == 1, "schema"), one(k % 7 == 2, "truncated")).alias("parse_failures"), F.concat(F.lit("key"), F.col("user_id") % 3).alias("key"), (k % 100).alias("prompt_tokens"), (k % 10).alias("completion_tokens"), F.col("value").alias("cost"))
    out = evaluation.judge_counts(calls, "event_type")
    at = lambda column, name: F.coalesce(F.try_element_at(column, F.lit(name)), F.lit(0).cast("bigint"))
    return out.withColumn("timeouts", at("errors", "timeout")).withColumn("truncated", at("parse_failures", "truncated")).withColumn("of_key", at("per_key", "key1")).drop("errors", "parse_failures", "per_key")


@query("""
SELECT CASE event_id % 7 WHEN 0 THEN 'http_429' WHEN 1 THEN 'read_timeout' WHEN 2 THEN 'remote_protocol_error' WHEN 3 THEN 'ssl_eof' WHEN 4 THEN 'connect_error' WHEN 5 THEN 'other' END AS status, CASE event_id % 7 WHEN 5 THEN false WHEN 6 THEN NULL ELSE true END AS retried, count(*) AS n FROM events GROUP BY ALL
""")
def transport_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    error = F.when(k == 1, "The read timed out").when(k == 2, "Remote protocol violated").when(k == 3, "SSL: unexpected end").when(k == 4, "connection refused").when(k == 5, "something else")
    out = table(spark, sf_dir, "events").select(modelcall.classify(F.when(k == 0, 429), error).alias("status"))
    return out.withColumn("retried", F.col("status").isin(*modelcall.RETRIED)).groupBy("status", "retried").agg(F.count("*").alias("n"))


@query("""
SELECT CASE doc_id % 4 WHEN 0 THEN 'ntsb' WHEN 1 THEN 'boards' WHEN 2 THEN 'tsb_pipeline' END AS adapter, count(*) AS n FROM documents GROUP BY ALL
""")
def cases_by_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    case = F.concat(F.when(k == 0, "ANTSB-").when(k == 1, "ABRD-").when(k == 2, "ATSP-").otherwise("ANTSBX"), "doc_id")
    return table(spark, sf_dir, "documents").groupBy(readers.adapter_of(case).alias("adapter")).agg(F.count("*").alias("n"))
