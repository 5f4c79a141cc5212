"""Plans, runs, audits and repairs of cases that `case_tables` makes out of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.operators import compile as comp
from evispark.operators import extraction, judging, repair, trajectory
from evispark.plans.case_tables import CASES, case_tables
from evispark.plans.registry import query
from evispark.sources.readers import table

@query(CASES + """
, said AS (SELECT *, first(list_distinct(regexp_extract_all(note, '\\bH[0-9]+\\b'))) OVER (PARTITION BY case_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS declared, list_distinct(regexp_extract_all(note, '\\bH[0-9]+\\b')) AS hs FROM folded),
ended AS (SELECT f.*, n, list_concat(coalesce(opening, []), coalesce(fresh, [])) AS seen, shown FROM finals f LEFT JOIN (SELECT case_id, count(*) AS n, any_value(opening) AS opening, flatten(list(fresh)) AS fresh, bool_or(contains(lower(note || ' ' || reason), 'appears')) AS shown FROM folded GROUP BY case_id) USING (case_id)),
bad AS (
  SELECT 'empty note, bad ids or short reason' AS rule FROM said WHERE len(list_distinct(fetch_ids)) <> len(fetch_ids) OR length(reason) < 10
  UNION ALL SELECT 'unknown evidence id' FROM said WHERE len(unknown) > 0
  UNION ALL SELECT 'forward citation' FROM said WHERE len(list_filter(regexp_extract_all(note, 'E[1-9][0-9]*\\.[1-9][0-9]*'), lambda x: NOT list_contains(seen, x))) > 0
  UNION ALL SELECT 'first note lacks two hypotheses' FROM said WHERE round = 1 AND len(declared) < 2
  UNION ALL SELECT 'undeclared hypothesis' FROM said WHERE round > 1 AND len(list_filter(hs, lambda x: NOT list_contains(declared, x))) > 0
  UNION ALL SELECT 'round count' FROM ended WHERE NOT coalesce(n, 0) BETWEEN 3 AND 16
  UNION ALL SELECT 'final lacks its marker' FROM ended WHERE final = 'no decision'
  UNION ALL SELECT 'marker conflicts with the label' FROM ended WHERE (final LIKE 'CASE CLOSED%' AND expected = 'undetermined') OR (final LIKE 'CASE NOT%' AND expected = 'determined')
  UNION ALL SELECT 'final cites unread evidence' FROM ended WHERE len(list_filter(regexp_extract_all(final, 'E[1-9][0-9]*\\.[1-9][0-9]*'), lambda x: NOT list_contains(seen, x))) > 0
  UNION ALL SELECT 'a withheld identifier shows' FROM ended WHERE conv_id % 5 = 0 AND shown)
SELECT rule, count(*) AS n FROM bad GROUP BY rule
""")
def plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tables(spark, sf_dir)
    withheld = t["finals"].where("conv_id % 5 = 0").select("case_id", F.lit("Appears").alias("value")).unionByName(t["finals"].select("case_id", F.lit("H1").alias("value")))
    return comp.plan_problems(t["rounds"], t["items"], t["finals"], withheld).groupBy("rule").agg(F.count("*").alias("n"))


@query(CASES + """
SELECT case_id, round, CAST(len(fresh) AS INT) AS delivered, CAST(len(again) AS INT) AS already, CAST(len(unknown) AS INT) AS unknown FROM folded
""")
def plan_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tables(spark, sf_dir)
    out = comp.deliveries(t["rounds"], t["items"], ["case_id"])
    return out.select("case_id", "round", F.size("fresh").alias("delivered"), F.size("already_delivered").alias("already"), F.size("unknown").alias("unknown"))


@query(CASES + """
, m AS (SELECT case_id, 0 AS pos, 'user' AS role, 5 AS chars, false AS loss FROM finals UNION ALL SELECT case_id, round * 2 - 1, 'assistant', length(note), true FROM folded
  UNION ALL SELECT case_id, round * 2, 'tool', CAST(len(fresh) * 1000 + len(again) AS BIGINT), false FROM folded UNION ALL SELECT case_id, coalesce(last, 0) * 2 + 1, 'assistant', length(final), true FROM finals LEFT JOIN (SELECT case_id, max(round) AS last FROM rounds GROUP BY case_id) USING (case_id))
SELECT case_id, count(*) AS messages, CAST(count(*) FILTER (loss) AS BIGINT) AS learned, CAST(sum(pos * chars) AS BIGINT) AS checksum FROM m GROUP BY case_id
""")
def plan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tables(spark, sf_dir)
    out = comp.plan_messages(t["rounds"], t["items"], t["finals"], t["finals"].select("case_id", F.lit("brief").alias("brief")))
    answer = F.from_json("content", "evidence_items array<struct<evidence_id:string,text:string>>, already_delivered array<string>")
    weight = F.when(F.col("role") == "tool", F.size(answer["evidence_items"]) * 1000 + F.coalesce(F.size(answer["already_delivered"]), F.lit(0))).otherwise(F.length("content"))
    weight = F.when(F.col("role") == "tool", F.size(answer["evidence_items"]) * 1000 + F.when(answer["already_delivered"].isNull(), 0).otherwise(F.size(answer["already_delivered"]))).otherwise(weight)
    return out.groupBy("case_id").agg(F.count("*").alias("messages"), F.sum(F.col("loss").cast("bigint")).alias("learned"), F.sum((F.col("pos") * weight).cast("bigint")).alias("checksum"))


@query("""
WITH t AS (SELECT conv_id, turn, text, conv_id % 9 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations WHERE role = 'assistant'),
l AS (SELECT *, CASE WHEN k = 0 THEN 'runtime_error' WHEN k = 1 THEN 'wall_budget' WHEN k = 2 THEN 'context_limit' WHEN k = 3 THEN 'malformed_final' WHEN k < 6 THEN 'final' WHEN turns >= 3 THEN 'turn_limit' ELSE 'unfinished' END AS status FROM t WHERE back = 1)
SELECT status, count(*) AS n, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(turns - CASE WHEN k IN (3, 4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS fetches, CAST(count(*) FILTER (status IN ('final', 'malformed_final') AND contains(text, 'CASE CLOSED')) AS BIGINT) AS closed FROM l GROUP BY status
""")
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    k, none = F.col("conv_id") % 9, F.lit(None)
    turns = turns.withColumn("_last", last).select(
        "conv_id", "turn", F.col("text").alias("assistant"), F.when(~F.col("_last") | ~k.isin(3, 4, 5), F.array(F.lit("E1.1"))).alias("call_ids"),
        F.when(F.col("_last") & (k == 3), F.array(F.lit("malformed markup"))).alias("call_errors"), F.when(F.col("_last") & (k == 0), "boom").otherwise(none).alias("runtime_error"),
        F.when(F.col("_last") & (k == 1), "wall_budget").when(F.col("_last") & (k == 2), "length").otherwise(none).alias("stop"),
    )
    out = comp.run_status(turns, ["conv_id"], 3)
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum("turns").alias("turns"), F.sum("fetch_rounds").alias("fetches"), F.sum((F.col("marker") == "closed").cast("bigint")).alias("closed")).fillna(0, "closed")


@query(CASES + """
SELECT rule, count(*) AS n FROM (
  SELECT 'a host case on a public route' AS rule FROM finals WHERE conv_id % 4 = 0 AND conv_id % 10 <> 9 UNION ALL SELECT 'no known family' FROM finals WHERE conv_id % 10 = 9) GROUP BY rule
""")
def lane_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = case_tables(spark, sf_dir)["finals"]
    families = cases.where("conv_id % 10 <> 9").select("case_id", F.when(F.col("conv_id") % 4 == 0, "host").otherwise("report").alias("family"))
    return comp.lane_violations(cases.select("case_id", F.lit("web").alias("route")), families, "public_nonmedical").groupBy("rule").agg(F.count("*").alias("n"))


@query(CASES + """
, t AS (SELECT f.case_id, conv_id, final, list_distinct(regexp_extract_all(final, 'E[1-9][0-9]*\\.[1-9][0-9]*')) AS key, coalesce(opening, []) AS opening, CASE conv_id % 2 WHEN 0 THEN 'closed' ELSE 'not_closed' END AS closure, CASE WHEN final LIKE 'CASE NOT%' THEN 'not_closed' WHEN final LIKE 'CASE CLOSED%' THEN 'closed' END AS marker FROM finals f LEFT JOIN known USING (case_id))
SELECT case_id, CAST(len(key) AS INT) AS n_key, CAST(len(list_filter(key, lambda x: NOT list_contains(opening, x))) AS INT) AS n_fetchable, array_to_string(list_filter([CASE WHEN conv_id % 8 = 7 THEN 'no metadata' END, CASE WHEN conv_id % 8 = 6 THEN 'label differs from metadata' END, CASE WHEN marker IS DISTINCT FROM closure THEN 'marker differs from label' END,
  CASE WHEN len(list_filter(key, lambda x: NOT list_contains(opening, x))) = 0 THEN 'no fetchable key' END], lambda x: x IS NOT NULL), ',') AS problems FROM t
""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tables(spark, sf_dir)
    closure = F.when(F.col("conv_id") % 2 == 0, "closed").otherwise("not_closed")
    cases = t["finals"].withColumn("closure", closure).join(comp.known_items(t["items"]).select("case_id", "opening"), "case_id", "left")
    labels = cases.where("conv_id % 8 <> 7").select("case_id", F.when(F.col("conv_id") % 8 == 6, "other").otherwise(F.col("closure")).alias("closure"))
    out = comp.training_rows(cases, labels)
    return out.select("case_id", F.size("key_ids").alias("n_key"), F.size("key_fetchable_ids").alias("n_fetchable"), F.array_join("problems", ",").alias("problems"))


@query(CASES + """
, p AS (SELECT case_id, CASE WHEN conv_id % 4 = 0 THEN 'host' ELSE 'report' END AS family, 'h' || conv_id AS package_hash, conv_id FROM finals)
SELECT family, count(*) AS n, CAST(count(DISTINCT package_hash) AS BIGINT) AS packages FROM p WHERE (family = 'host' AND conv_id % 3 <> 0) OR (family <> 'host' AND conv_id % 5 <> 0) GROUP BY family
""")
def references_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = case_tables(spark, sf_dir)["finals"]
    pool = cases.select("case_id", F.when(F.col("conv_id") % 4 == 0, "host").otherwise("report").alias("family"))
    packages = cases.select("case_id", F.concat(F.lit("h"), "conv_id").alias("package_hash"))
    trajectories, references = cases.where("conv_id % 3 <> 0").select("case_id", F.col("final").alias("result")), cases.where("conv_id % 5 <> 0").select("case_id", F.col("expected").alias("reference"))
    out = comp.by_family(pool, packages, references, trajectories)
    return out.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("package_hash").alias("packages"))


ISSUES = CASES + """
, n AS (SELECT case_id, count(*) AS n FROM rounds GROUP BY case_id),
first_seen AS (SELECT case_id, evidence_id, min(turn) AS turn FROM (SELECT case_id, unnest(opening) AS evidence_id, 0 AS turn FROM known UNION ALL SELECT case_id, unnest(fresh), round FROM folded) GROUP BY ALL),
issues AS (SELECT case_id, round AS issue_id, CASE WHEN round % 4 = 0 THEN 99 ELSE round END AS at_round, CASE round % 5 WHEN 0 THEN 'premature use of ' WHEN 1 THEN 'the ledger forgets ' WHEN 2 THEN 'did not fetch ' WHEN 3 THEN 'the conclusion ignores ' ELSE 'misreads ' END || fetch_ids[1] AS finding FROM rounds),
before AS (SELECT i.*, at_round > n AS about_final, CASE WHEN finding LIKE 'premature%' THEN 'temporal_evidence' WHEN finding LIKE '%ledger%' THEN 'hypothesis_update' WHEN finding LIKE '%fetch%' THEN 'evidence_selection' WHEN at_round > n OR finding LIKE '%conclusion%' THEN 'final_answer' ELSE 'factual_grounding' END AS kind,
  (SELECT count(*) FROM first_seen s WHERE s.case_id = i.case_id AND s.evidence_id = regexp_extract(finding, 'E[1-9][0-9]*\\.[1-9][0-9]*') AND at_round <= n AND s.turn >= at_round) AS later FROM issues i JOIN n USING (case_id))
"""


def issue_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = case_tables(spark, sf_dir)
    r = F.col("round")
    what = F.when(r % 5 == 0, "premature use of ").when(r % 5 == 1, "the ledger forgets ").when(r % 5 == 2, "did not fetch ").when(r % 5 == 3, "the conclusion ignores ").otherwise("misreads ")
    issues = t["rounds"].select("case_id", r.alias("issue_id"), F.when(r % 4 == 0, 99).otherwise(r).alias("at_round"), F.concat(what, F.get("fetch_ids", F.lit(0))).alias("finding"), F.lit(None).cast("array<string>").alias("ids"))
    folded = comp.deliveries(t["rounds"], t["items"], ["case_id"])
    seen = comp.known_items(t["items"]).select("case_id", F.explode("opening").alias("evidence_id"), F.lit(0).alias("turn")).unionByName(folded.select("case_id", F.explode("fresh").alias("evidence_id"), r.alias("turn")))
    seen = seen.groupBy("case_id", "evidence_id").agg(F.min("turn").alias("turn"))
    return issues, seen, t["rounds"].groupBy("case_id").agg(F.count("*").alias("n"))


@query(ISSUES + "SELECT kind, about_final, count(*) AS n, CAST(sum(later) AS BIGINT) AS later FROM before GROUP BY ALL")
def issue_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.triage_before(*issue_tables(spark, sf_dir))
    return out.groupBy("kind", "about_final").agg(F.count("*").alias("n"), F.sum(F.size("later").cast("bigint")).alias("later"))


@query(ISSUES + """
SELECT kind, CASE issue_id % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'not_fixable' END AS claimed, CASE WHEN issue_id % 3 = 1 THEN 'unfixable' WHEN issue_id % 3 = 0 AND issue_id % 2 = 0 THEN 'claimed without a change' ELSE 'to be scored' END AS signal, count(*) AS n FROM before GROUP BY ALL
""")
def issues_after_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, seen, rounds = issue_tables(spark, sf_dir)
    before = repair.triage_before(issues, seen, rounds)
    k = F.col("issue_id")
    claims = issues.where(k % 3 != 2).select("case_id", "issue_id", F.when(k % 3 == 0, "fixed").otherwise("not_fixable").alias("status"))
    texts = issues.select("case_id", "issue_id", F.lit("old").alias("old"), F.when(k % 2 == 0, "old").otherwise("new").alias("new"))
    out = repair.triage_after(before.drop("at_round").withColumn("at_round", k), texts.withColumnRenamed("issue_id", "at_round"), claims)
    return out.groupBy("kind", "claimed", "signal").agg(F.count("*").alias("n"))


@query(ISSUES + """
SELECT rule, count(*) AS n FROM (SELECT 'no disposition' AS rule FROM issues WHERE issue_id % 3 = 2 UNION ALL SELECT 'no such finding' FROM finals UNION ALL SELECT 'several dispositions' FROM issues WHERE issue_id % 6 = 0 UNION ALL SELECT 'unknown disposition' FROM issues WHERE issue_id % 3 = 1) GROUP BY rule
""")
def unresolved_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, _, _ = issue_tables(spark, sf_dir)
    k = F.col("issue_id")
    claims = issues.where(k % 3 != 2).select("case_id", "issue_id", F.when(k % 3 == 0, "fixed").otherwise("mended").alias("status"))
    claims = claims.unionByName(claims.where("issue_id % 6 = 0")).unionByName(case_tables(spark, sf_dir)["finals"].select("case_id", F.lit(-1).alias("issue_id"), F.lit("fixed").alias("status")))
    return repair.unresolved(issues, claims).groupBy("rule").agg(F.count("*").alias("n"))


@query(CASES + """
, p AS (SELECT case_id, conv_id, final, CASE conv_id % 5 WHEN 0 THEN 'too short' WHEN 1 THEN 'CASE CLOSED and so on, at a length that is long enough to be taken' WHEN 2 THEN 'a text of enough letters that has no marker at its beginning or elsewhere' WHEN 3 THEN 'a text of enough letters that says CASE CLOSED where it should not be said' END AS proposed, conv_id % 7 = 0 AS cut FROM finals),
s AS (SELECT *, regexp_extract(final, '^CASE (?:NOT )?CLOSED') AS marker FROM p),
o AS (SELECT *, CASE WHEN proposed IS NULL THEN 'kept' WHEN cut THEN 'truncated' WHEN length(trim(proposed)) < 50 OR (marker <> '' AND conv_id % 5 = 3) THEN 'rejected' ELSE 'revised' END AS status FROM s)
SELECT case_id, status, CASE WHEN status <> 'revised' THEN final WHEN marker <> '' AND conv_id % 5 <> 1 THEN marker || ' — ' || proposed ELSE proposed END AS text FROM o
""")
def revised_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    finals, k = case_tables(spark, sf_dir)["finals"], F.col("conv_id") % 5
    text = F.when(k == 0, "too short").when(k == 1, "CASE CLOSED and so on, at a length that is long enough to be taken").when(k == 2, "a text of enough letters that has no marker at its beginning or elsewhere").otherwise("a text of enough letters that says CASE CLOSED where it should not be said")
    proposals = finals.where(k != 4).select("case_id", text.alias("proposed"), F.when(F.col("conv_id") % 7 == 0, "length").otherwise("stop").alias("finish_reason"))
    return repair.revise_finals(finals.select("case_id", "final"), proposals)


@query(CASES + """
, top AS (SELECT case_id, max(CAST(regexp_extract(evidence_id, 'E([0-9]+)', 1) AS INT)) + 1 AS g FROM items GROUP BY case_id),
src AS (SELECT case_id, list(DISTINCT source_id) AS known, string_agg(text, ' ' ORDER BY pos) AS original FROM items GROUP BY case_id),
p AS (SELECT i.case_id, i.pos + 1 AS pos, 'E' || (g + CASE WHEN i.pos = 2 THEN 1 ELSE 0 END) || '.' || (i.pos + 1) AS evidence_id, CASE WHEN conv_id % 6 = 1 THEN 'S9' ELSE source_id END AS source_id, substr(text, 1, CASE WHEN conv_id % 6 = 2 THEN 10 ELSE 60 END) AS quote, g, conv_id, original, known FROM items i JOIN top USING (case_id) JOIN src USING (case_id) JOIN finals USING (case_id) WHERE i.pos < CASE WHEN conv_id % 6 = 0 THEN 4 ELSE 3 END),
j AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM p)
SELECT CASE WHEN n > 3 THEN 'too many items' WHEN evidence_id <> 'E' || g || '.' || pos THEN 'not the reserved id' WHEN NOT list_contains(known, source_id) THEN 'unknown source' WHEN length(trim(quote)) < 20 THEN 'quote too short'
  WHEN instr(original, quote) = 0 OR instr(substr(original, instr(original, quote) + 1), quote) > 0 THEN 'quote not there exactly once' END AS problem, count(*) AS n, CAST(sum(instr(original, quote) - 1) FILTER (problem IS NULL) AS BIGINT) AS offsets FROM j GROUP BY 1
""")
def evidence_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = case_tables(spark, sf_dir)
    items, k = t["items"], F.col("conv_id") % 6
    group = F.regexp_extract(F.get("reserved", F.lit(0)), r"E(\d+)", 1).cast("int")
    joined = items.join(repair.reserved_ids(items), "case_id").join(t["finals"].select("case_id", "conv_id"), "case_id").where(F.col("pos") < F.when(k == 0, 4).otherwise(3))
    proposed = joined.select(
        "case_id", (F.col("pos") + 1).alias("pos"), F.concat(F.lit("E"), group + F.when(F.col("pos") == 2, 1).otherwise(0), F.lit("."), F.col("pos") + 1).alias("evidence_id"), F.lit("a new title").alias("neutral_title"),
        F.lit("observation").alias("kind"), F.when(k == 1, "S9").otherwise(F.col("source_id")).alias("source_id"), F.substring("text", F.lit(1), F.when(k == 2, 10).otherwise(60)).alias("quote"),
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    out = repair.additions(proposed, items, items.groupBy("case_id").agg(whole.alias("original")))
    return out.groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.col("char_offset").cast("bigint")).alias("offsets"))


@query(CASES + """
, a AS (SELECT case_id, conv_id % 8 AS k FROM finals),
s AS (SELECT *, CASE k WHEN 0 THEN 'compiled_review_draft' WHEN 1 THEN 'transport_error_uncertain' WHEN 2 THEN 'compiled_review_draft' WHEN 3 THEN 'repair_failed' WHEN 4 THEN 'unfixable_or_no_change' WHEN 5 THEN 'to be retried' WHEN 6 THEN 'repair_failed' ELSE 'unfixable_or_no_change' END AS status FROM a)
SELECT status, CASE k WHEN 3 THEN 'truncated' WHEN 5 THEN 'http error' WHEN 6 THEN 'compiler: no such round' END AS reason, k = 5 AS retry, count(*) AS n FROM s GROUP BY ALL
""")
def repair_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = case_tables(spark, sf_dir)["finals"].select("case_id", (F.col("conv_id") % 8).alias("k"))
    none = F.lit(None).cast("string")
    # by k: attempts as (transport, finish_reason, parsed, edits, error)
    told = {
        0: [(None, "stop", True, 2, None)], 1: [("transport_error_uncertain", None, None, None, None)], 2: [("http_error", None, None, None, None), (None, "stop", True, 1, None)],
        3: [(None, "stop", False, None, None), (None, "length", None, None, None)], 4: [(None, "stop", True, 0, None)], 5: [("http_error", None, None, None, None)],
        6: [(None, "length", None, None, None), (None, "stop", True, 3, "no such round")], 7: [(None, "stop", True, 1, "no such round"), (None, "stop", True, 0, None)],
    }
    rows = [(k, n + 1, *values) for k, each in told.items() for n, values in enumerate(each)]
    attempts = spark.createDataFrame(rows, "k bigint, attempt int, transport string, finish_reason string, parsed boolean, edits int, error string")
    out = repair.attempt_outcomes(cases.join(attempts, "k"))
    return out.groupBy("status", F.coalesce("reason", none).alias("reason"), "retry").agg(F.count("*").alias("n"))


@query(CASES + """
, m AS (SELECT case_id, count(*) + 1 AS n FROM rounds GROUP BY case_id)
SELECT case_id, CASE WHEN conv_id % 2 = 0 THEN 'case_id,messages,package' ELSE 'case_id,messages,package,reference' END AS keys, CAST(coalesce(n, 1) AS INT) AS messages, CAST(conv_id AS BIGINT) AS number FROM finals LEFT JOIN m USING (case_id)
""")
def audit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even cases are audited blind."""
    t = case_tables(spark, sf_dir)
    cases = t["finals"].select("case_id", "conv_id", F.to_json(F.struct(F.col("conv_id").alias("number"))).alias("package"), F.col("expected").alias("reference"))
    said = t["rounds"].select("case_id", F.col("round").alias("pos"), F.lit("assistant").alias("role"), F.col("note").alias("content")).unionByName(t["finals"].select("case_id", F.lit(999).alias("pos"), F.lit("assistant").alias("role"), F.col("final").alias("content")))
    out = judging.audit_requests(cases.where("conv_id % 2 = 0"), said).unionByName(judging.audit_requests(cases.where("conv_id % 2 = 1"), said, blind=False))
    keys = F.array_join(F.sort_array(F.json_object_keys("payload")), ",")
    parsed = F.from_json("payload", "messages array<struct<role:string,content:string>>, package struct<number:bigint>")
    return out.select("case_id", keys.alias("keys"), F.size(parsed["messages"]).alias("messages"), parsed["package"]["number"].alias("number"))


@query(CASES + "SELECT case_id, count(*) AS items FROM items WHERE pos % 3 <> 0 GROUP BY case_id HAVING count(*) >= 3")
def cases_with_enough_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.enough_items(case_tables(spark, sf_dir)["items"].withColumn("accepted", F.col("pos") % 3 != 0), 3)


def rollouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns, openings, finals and labels; a fifth of the cases lacks a turn, a quarter gets back nothing."""
    t = case_tables(spark, sf_dir)
    folded = comp.deliveries(t["rounds"], t["items"], ["case_id"])
    conv = F.substring("case_id", 2, 20).cast("bigint")
    turn = F.when((conv % 5 == 0) & (F.col("round") >= 2), F.col("round") + 1).otherwise(F.col("round"))
    turns = folded.select(
        "case_id", F.lit(0).alias("sample"), turn.alias("turn"), F.col("note").alias("assistant"), F.col("fetch_ids").alias("call_ids"), "reason", F.lit(None).cast("array<string>").alias("call_errors"),
        F.when(conv % 4 == 1, F.array().cast("array<string>")).otherwise(F.col("fresh")).alias("returned_ids"), F.when(F.size("unknown") > 0, "unknown id").alias("return_error"),
    )
    finals = t["finals"].select("case_id", F.lit(0).alias("sample"), F.col("final").alias("final_answer"))
    labels = t["finals"].select("case_id", F.when(F.col("expected") == "determined", "closed").otherwise("not_closed").alias("closure"))
    return turns, comp.known_items(t["items"]).select("case_id", "opening"), finals, labels


ENDED = CASES + """
, agg AS (SELECT case_id, count(*) AS fetch_rounds, list_distinct(flatten(list(fetch_ids))) AS requested, list_distinct(flatten(list(fresh))) AS fetched, any_value(opening) AS opening FROM folded GROUP BY case_id),
ended AS (SELECT f.case_id, f.conv_id, final, expected, fetch_rounds, requested, fetched, list_distinct(list_concat(coalesce(opening, []), coalesce(fetched, []))) AS disclosed, list_distinct(regexp_extract_all(final, 'E[1-9][0-9]*\\.[1-9][0-9]*')) AS cited, CASE WHEN final LIKE 'CASE NOT%' THEN 'not_closed' WHEN final LIKE 'CASE CLOSED%' THEN 'closed' END AS marker FROM finals f LEFT JOIN agg USING (case_id)),
judged AS (SELECT *, len(list_filter(cited, lambda x: NOT list_contains(disclosed, x))) = 0 AS seen FROM ended)
"""


@query(ENDED + """
SELECT case_id, fetch_rounds, CAST(len(requested) AS INT) AS requested, CAST(len(fetched) AS INT) AS fetched, CAST(len(disclosed) AS INT) AS disclosed, CAST(len(cited) AS INT) AS cited, seen AS citations_seen, marker FROM judged
""")
def rollout_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, openings, finals, _ = rollouts(spark, sf_dir)
    out = trajectory.results(turns, openings, finals)
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    return out.select("case_id", F.col("fetch_rounds").cast("bigint").alias("fetch_rounds"), n("requested"), n("fetched"), n("disclosed"), n("cited"), "citations_seen", "marker")


@query(ENDED + """
, r AS (SELECT *, CAST(substr(case_id, 2) AS BIGINT) AS conv FROM folded),
bad AS (SELECT 'a turn is missing' AS rule FROM r WHERE conv % 5 = 0 AND round = 2 UNION ALL SELECT 'arguments are invalid' FROM r WHERE len(list_distinct(fetch_ids)) <> len(fetch_ids) OR length(reason) < 10
  UNION ALL SELECT 'the return is not what was asked' FROM r WHERE len(unknown) = 0 AND conv % 4 = 1 AND len(fresh) > 0
  UNION ALL SELECT 'an item is cited before it was seen' FROM r WHERE len(list_filter(regexp_extract_all(note, 'E[1-9][0-9]*\\.[1-9][0-9]*'), lambda x: NOT list_contains(seen, x) AND NOT list_contains(fetch_ids, x))) > 0
  UNION ALL SELECT 'no marker' FROM judged WHERE marker IS NULL UNION ALL SELECT 'the marker is not the label' FROM judged WHERE marker <> CASE expected WHEN 'determined' THEN 'closed' ELSE 'not_closed' END UNION ALL SELECT 'a cited item was never seen' FROM judged WHERE NOT seen)
SELECT rule, count(*) AS n FROM bad GROUP BY rule
""")
def trace_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.format_violations(*rollouts(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))
