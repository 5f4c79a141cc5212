"""Further operators over the driver's tables: selection, budgets, metrics, reports, call plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import numeric as nf
from evispark.functions import text as t
from evispark.operators import anonymise, groups, judging, segmentation, trajectory, windows
from evispark.plans.registry import query
from evispark.sources import sinks
from evispark.sources.readers import table
from evispark.streaming import modelcall


@query("""
WITH l AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS answer FROM documents),
w AS (SELECT doc_id, lower(text) AS p, list_distinct(regexp_extract_all(lower(answer), '[a-z]{5,}')) AS ws FROM l WHERE answer IS NOT NULL)
SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_filter(ws, lambda x: contains(p, x))) / len(ws) END, 6) AS share FROM w
""")
def answer_leak_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pairs = windows.before(docs, "source", "doc_id", ["text"]).where("prev_text IS NOT NULL")
    return pairs.select("doc_id", F.round(segmentation.answer_share(F.col("text"), F.col("prev_text")), 6).alias("share"))


@query("""
SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 2
""")
def orders_with_both_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.both_kinds(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", ["A", "R"])


@query("""
SELECT * FROM (SELECT event_type, event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS spent FROM events) WHERE spent <= 5000
""")
def within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    out = windows.running(events, ["event_type"], ["ts", "event_id"], {"spent": F.col("value")})
    return out.select("event_type", "event_id", F.round("spent", 4).alias("spent")).where("spent <= 5000")


@query("""
SELECT event_type, CASE WHEN value > 90 THEN 'inflight' ELSE 'done' END AS state, count(*) AS n, CAST(max(ts) AS TIMESTAMP) AS latest FROM events GROUP BY ALL
""")
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("value") > 90, "inflight").otherwise("done")
    return table(spark, sf_dir, "events").groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("""
WITH c AS (SELECT user_id, bool_or(value <= 90) AS done FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT CASE WHEN c.done THEN 'cached' WHEN c.done IS NOT NULL THEN 'uncertain' ELSE 'call' END AS plan, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) GROUP BY ALL
""")
def call_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    prompts = events.select("user_id").distinct().withColumn("prompt", F.concat(F.lit("user "), F.col("user_id")))
    key = modelcall.cache_key("marker", F.concat(F.lit("user "), F.col("user_id")))
    calls = events.where("event_type = 'click'").select(key.alias("prompt_sha"), F.when(F.col("value") > 90, "inflight").otherwise("done").alias("state"))
    return modelcall.call_plan(prompts, calls, "marker").groupBy("plan").agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, path, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM (
  SELECT l_returnflag, unnest(['discount', 'tax', 'quantity']) AS path, unnest([l_discount, l_tax, l_quantity]) AS value FROM lineitem) GROUP BY ALL
""")
def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"))
    return sinks.long_metrics(lines, "l_returnflag", ["discount", "tax", "quantity"]).groupBy("l_returnflag", "path").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


@query("""
SELECT lang, CAST(quantile_cont(n_chars, 0.5) AS BIGINT) AS median, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(CASE WHEN n_chars < 100 THEN 1 ELSE 0 END) AS BIGINT) AS short FROM documents GROUP BY lang
""".replace("CAST(quantile_cont(n_chars, 0.5) AS BIGINT)", "CAST(trunc(quantile_cont(n_chars, 0.5)) AS BIGINT)"))
def record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = F.percentile("n_chars", 0.5).cast("bigint")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(median.alias("median"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum((F.col("n_chars") < 100).cast("bigint")).alias("short"))


@query("""
SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_tax < 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) = 1
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", (F.col("l_tax") < 0.05).alias("valid"), F.struct(-F.col("l_discount"), F.col("l_linenumber")).alias("priority"))
    return trajectory.best_candidate(lines, "l_orderkey", "valid", "priority").select("l_orderkey", "l_linenumber", "l_discount")


@query("""
SELECT o_orderpriority, CAST(arg_min(o_orderkey, length(o_orderstatus || o_orderpriority || CAST(o_custkey AS VARCHAR)) * 10000000 + o_orderkey) AS BIGINT) AS probe FROM orders GROUP BY o_orderpriority
""")
def shortest_row_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.concat("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))) * 10000000 + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", size).alias("probe"))


@query("""
SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS only_documents, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS only_labels,
       (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS shared
""")
def coverage_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, n).select("doc_id") for n in ("documents", "labels"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.exceptAll(b), "only_documents").join(count(b.exceptAll(a), "only_labels")).join(count(a.intersect(b), "shared"))


@query("""
WITH c AS (SELECT source, lang, doc_id % 10 = 0 AS val, count(*) AS n FROM documents GROUP BY ALL), q AS (SELECT source, lang, sum(n) AS total, sum(CASE WHEN val THEN n ELSE 0 END) AS seen FROM c GROUP BY ALL)
SELECT source, round(sum(pow(seen - total * 0.1, 2) / (total * 0.1 + 1)), 6) AS penalty FROM q GROUP BY source
""")
def balance_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("total"), F.sum((F.col("doc_id") % 10 == 0).cast("int")).alias("seen"))
    wanted = F.col("total") * 0.1
    return cells.groupBy("source").agg(F.round(F.sum(F.pow(F.col("seen") - wanted, 2) / (wanted + 1)), 6).alias("penalty"))


@query("""
SELECT lang, CASE WHEN quality = 1 THEN 'closed' ELSE 'not_closed' END AS closure, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS val, CAST(sum(CASE WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS train
FROM documents JOIN labels USING (doc_id) GROUP BY ALL
""")
def split_quota_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("lang", F.when(F.col("quality") == 1, "closed").otherwise("not_closed").alias("closure"), F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"), F.lit(1).cast("bigint").alias("one"))
    out = rows.groupBy("lang", "closure").pivot("split", ["val", "train"]).agg(F.sum("one"))
    return out.select("lang", "closure", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("val", "train")])


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS tokens FROM lineitem) SELECT count(*) AS n, CAST(sum(tokens) AS DOUBLE) AS tokens FROM o WHERE tokens >= 480 - 40
""")
def over_long_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 10).alias("tokens"))
    return groups.over_long(rows, "tokens", 480, 40).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("""
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, 'E[1-9][0-9]*\\.[1-9][0-9]*'))) AS INT) AS cited, round(least(1.0, 3.0 * len(regexp_extract_all(text, 'E1\\.')) / 3), 6) AS share
FROM (SELECT doc_id, 'see E1.' || (doc_id % 3 + 1) || ', E2.' || (doc_id % 4 + 1) || ' and E1.1' AS text FROM documents)
""")
def cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.lit("see E1."), k % 3 + 1, F.lit(", E2."), k % 4 + 1, F.lit(" and E1.1"))
    ids = t.evidence_ids(text)
    opening = F.size(F.filter(ids, lambda i: i.startswith("E1.")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(ids)).alias("cited"), F.round(F.least(F.lit(1.0), 3.0 * opening / 3), 6).alias("share"))


@query("""
WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"case_id":"' || doc_id || '","score":3,"action":"revise"}' WHEN 1 THEN '{"case_id":"x","score":3,"action":"revise"}' WHEN 2 THEN '{"case_id":"' || doc_id || '","score":9,"action":"revise"}' WHEN 3 THEN '{"case_id":"' || doc_id || '","score":1,"action":"no"}' ELSE 'junk' END AS reply FROM documents)
SELECT CASE WHEN NOT json_valid(reply) THEN 'schema' WHEN reply->>'$.case_id' <> CAST(doc_id AS VARCHAR) THEN 'case' WHEN CAST(reply->>'$.score' AS INT) NOT BETWEEN -5 AND 5 THEN 'score' WHEN reply->>'$.action' NOT IN ('accept', 'revise', 'reject') THEN 'action' END AS problem, count(*) AS n FROM a GROUP BY ALL
""")
def audit_reply_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, own = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    reply = lambda case, score, action: F.concat(F.lit('{"case_id":"'), case, F.lit(f'","score":{score},"action":"{action}"}}'))
    text = F.when(k == 0, reply(own, 3, "revise")).when(k == 1, reply(F.lit("x"), 3, "revise")).when(k == 2, reply(own, 9, "revise")).when(k == 3, reply(own, 1, "no")).otherwise("junk")
    rows = table(spark, sf_dir, "documents").select(own.alias("case_id"), text.alias("reply"))
    return judging.audit_replies(rows, "reply").groupBy("problem").agg(F.count("*").alias("n"))


H = [h.replace("'", "''") for h in segmentation.HEADINGS]


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT *, trim(line) AS bare, regexp_replace(line, '\s+$', '') AS tail FROM l),
h AS (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(tail, '{H[0]}') THEN regexp_extract(tail, '{H[0]}', 1) || ' ' || regexp_extract(tail, '{H[0]}', 2) WHEN regexp_matches(tail, '{H[1]}') THEN regexp_extract(tail, '{H[1]}', 1) WHEN regexp_matches(tail, '{H[2]}') THEN regexp_extract(tail, '{H[2]}', 1) ELSE '' END, '\s+', ' ', 'g')) AS found,
  length(bare) BETWEEN 1 AND 120 AND (regexp_matches(lower(bare), '^(?:page\s*)?\d+(?:\s*of\s*\d+)?$') OR regexp_matches(lower(bare), '\bpage \d+ of \d+\b') OR regexp_matches(bare, '^[-–—_.•\s]+$')) AS furniture FROM r)
SELECT doc_id, count(*) AS lines, CAST(count(*) FILTER (NOT furniture AND length(bare) >= 4 AND NOT (regexp_matches(bare, '[.;,]$') AND NOT regexp_matches(line, '{segmentation.NUMBERED}')) AND length(found) BETWEEN 4 AND 90 AND NOT regexp_matches(found, '^\p{{Ll}}')) AS BIGINT) AS headings FROM h GROUP BY doc_id
""")
def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = segmentation.lines(table(spark, sf_dir, "documents"), "doc_id").withColumn("h", segmentation.heading(F.col("line")))
    return each.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("h").alias("headings"))


@query()
def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.blocks(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


PROPER = anonymise.PROPER.replace("'", "''")
COMMON = ", ".join(f"'{w}'" for w in anonymise.COMMON)


@query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g'), '{PROPER}') AS names FROM documents), e AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM d),
c AS (SELECT doc_id, name, count(*) AS n, min(pos) AS first_at FROM e WHERE regexp_split_to_array(name, '\s+')[1] NOT IN ({COMMON}) AND length(name) >= 3 GROUP BY ALL)
SELECT doc_id, name, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_full_match(name, '[A-Z]{{2,6}}') THEN 0 WHEN contains(name, ' ') THEN 1 ELSE 2 END, n DESC, first_at) AS INT) AS place FROM c QUALIFY place <= 60
""")
def proper_noun_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymise.proper_nouns(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
SELECT doc_id, sha256(CAST(json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'text', text) AS VARCHAR)) AS digest FROM documents
""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    return table(spark, sf_dir, "documents").select("doc_id", nf.canonical_digest(package).alias("digest"))
