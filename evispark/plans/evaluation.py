"""Decisions against labels, judges and calls, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import evaluation as ev
from evispark.plans.registry import query
from evispark.sources.readers import table


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label, and the decision that a rule of length makes: none between 300 and 500 characters."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    decision = F.when(F.col("n_chars") >= 500, "closed").when(F.col("n_chars") < 300, "not_closed")
    label = F.when(F.col("quality") == 1, "closed").otherwise("not_closed")
    return joined.select("doc_id", "source", "lang", "n_chars", "toxic", decision.alias("decision"), label.alias("label"))


LABELLED = """
WITH labelled AS (
  SELECT doc_id, source, lang, n_chars, toxic,
         CASE WHEN n_chars >= 500 THEN 'closed' WHEN n_chars < 300 THEN 'not_closed' END AS decision,
         CASE WHEN quality = 1 THEN 'closed' ELSE 'not_closed' END AS label
  FROM documents JOIN labels USING (doc_id))
"""


@query(LABELLED + """
SELECT source, label, CAST(grouping(source) AS INT) AS g_source, CAST(grouping(label) AS INT) AS g_label,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN decision IS NOT DISTINCT FROM label THEN 1 ELSE 0 END) AS BIGINT) AS ok,
       round(sum(CASE WHEN decision IS NOT DISTINCT FROM label THEN 1 ELSE 0 END) / count(*), 6) AS acc
FROM labelled GROUP BY GROUPING SETS ((source, label), (source), (label), ())
""")
def closure_accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy_by_families(labelled(spark, sf_dir), "decision", "label", [("source", "label"), ("source",), ("label",), ()])


@query(LABELLED + """
SELECT source, count(*) AS n, CAST(sum(CASE WHEN decision IS NOT DISTINCT FROM label THEN 1 ELSE 0 END) AS BIGINT) AS ok,
       round(avg(CASE WHEN decision IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END), 6) AS acc
FROM labelled GROUP BY source
""")
def closure_accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy_by_families(labelled(spark, sf_dir), "decision", "label", [("source",)]).drop("g_source")


BALANCED = """
SELECT {by}, avg(CASE WHEN label = 'closed' THEN CASE WHEN decision IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END END) AS recall_closed,
       avg(CASE WHEN label = 'not_closed' THEN CASE WHEN decision IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END END) AS recall_open
FROM labelled GROUP BY {by}
"""


@query("SELECT *, round((recall_closed + recall_open) / 2, 6) AS balanced FROM (" + LABELLED + BALANCED.format(by="source") + ")")
def balanced_accuracy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.balanced_accuracy(labelled(spark, sf_dir), "decision", "label", "source")


@query("SELECT *, round((recall_closed + recall_open) / 2, 6) AS balanced FROM (" + LABELLED + BALANCED.format(by="lang") + ")")
def balanced_accuracy_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.balanced_accuracy(labelled(spark, sf_dir), "decision", "label", "lang")


@query(LABELLED + """
SELECT decision, label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labelled), 6) AS share FROM labelled GROUP BY decision, label
""")
def decision_confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_cells(labelled(spark, sf_dir), "decision", "label")


@query(LABELLED + """
SELECT source, round(avg(CASE WHEN toxic = 0 AND decision IS NOT DISTINCT FROM 'closed' THEN 1.0 WHEN toxic = 0 THEN 0.0 END), 6) AS rate_full,
       round(avg(CASE WHEN toxic = 1 AND decision IS NOT DISTINCT FROM 'closed' THEN 1.0 WHEN toxic = 1 THEN 0.0 END), 6) AS rate_removed,
       round(round(avg(CASE WHEN toxic = 0 AND decision IS NOT DISTINCT FROM 'closed' THEN 1.0 WHEN toxic = 0 THEN 0.0 END), 6)
       - round(avg(CASE WHEN toxic = 1 AND decision IS NOT DISTINCT FROM 'closed' THEN 1.0 WHEN toxic = 1 THEN 0.0 END), 6), 6) AS drop_removed
FROM labelled GROUP BY source
""")
def closed_rate_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("variant", F.when(F.col("toxic") == 1, "removed").otherwise("full"))
    return ev.contrast(rows, "variant", F.col("decision").eqNullSafe("closed"), "full", ["removed"], "source")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("""
SELECT (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS n_missing,
       (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS n_dup
""")
def label_join_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    missing = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n_missing"))
    twice = labels.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("n_dup"))
    return missing.join(F.broadcast(twice))  # one row each


@query("""
SELECT user_id, count(*) AS calls, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate,
       round(avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END), 6) AS parse_rate, round(avg(CASE WHEN event_type = 'view' AND value > 95 THEN 1.0 ELSE 0.0 END), 6) AS inconsistent_rate,
       avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.05 OR avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END) > 0.02
       OR avg(CASE WHEN event_type = 'view' AND value > 95 THEN 1.0 ELSE 0.0 END) > 0.10 AS alert
FROM events GROUP BY user_id
""")
def judge_health_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return ev.judge_health(table(spark, sf_dir, "events"), kind == "error", value < 1, (kind == "view") & (value > 95), "user_id")


@query("""
SELECT event_type, list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1)) + 1 AS BIGINT)] AS p50,
       list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) + 1 AS BIGINT)] AS p95, max(value) AS most
FROM events GROUP BY event_type
""")
def latency_lower_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latency(table(spark, sf_dir, "events").select("event_type", "value"), "value", "event_type")


@query("""
SELECT event_type, count(*) AS calls, round(sum(coalesce(CASE WHEN CAST(props->>'$.k' AS BIGINT) % 2 = 0 THEN CAST(props->>'$.k' AS BIGINT) / 100 END, value * 2 / 1000)), 6) AS cost
FROM events GROUP BY event_type
""")
def cost_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.cost(table(spark, sf_dir, "events"), F.when(k % 2 == 0, k / 100), F.col("value") * 2 / 1000, "event_type")


@query("""
WITH a AS (SELECT user_id, event_type, round(avg(value), 3) AS score FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
     b AS (SELECT user_id, event_type, round(avg(value), 3) AS score FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT count(*) AS pairs, round(avg(a.score - b.score), 4) AS mean_diff, round(avg(abs(a.score - b.score)), 4) AS mean_abs_diff,
       round(avg(CASE WHEN a.score - b.score = 0 THEN 1.0 ELSE 0.0 END), 4) AS agree
FROM a JOIN b USING (user_id, event_type)
""")
def paired_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    half = lambda k: events.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 3).alias("score"))
    out = ev.paired_differences(half(0), half(1), ["user_id", "event_type"], "score")
    return out.select("pairs", *[F.round(c, 4).alias(c) for c in ("mean_diff", "mean_abs_diff", "agree")])


@query("""
SELECT event_type, 'q' || (CAST(props->>'$.k' AS BIGINT) % 4) AS question, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS yes, count(*) AS n,
       round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 6) AS rate
FROM events GROUP BY ALL
""")
def answer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("q"), F.get_json_object("props", "$.k").cast("bigint") % 4)
    rows = table(spark, sf_dir, "events").select("event_type", F.create_map(name, F.array((F.col("value") > 50).cast("bigint"), F.lit(1).cast("bigint"))).alias("answers"))
    return ev.merged_answers(rows, "answers", "event_type")


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN -1 ELSE 1 END AS d,
             (l_extendedprice - avg(l_extendedprice) OVER w) / (stddev_pop(l_extendedprice) OVER w + 1e-6) AS advantage
           FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))
SELECT round(avg(CASE WHEN advantage > 0 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM g WHERE d < 0
""")
def wrong_but_rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evispark.operators.windows import standard_advantage

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_returnflag") == "A", -1).otherwise(1).alias("d"))
    return ev.wrong_but_rewarded(standard_advantage(rows, ["l_orderkey"], F.col("l_extendedprice")), "d", "advantage")


@query("""
SELECT round(avg(l_extendedprice * l_discount), 3) AS judge_part, round(avg(l_extendedprice - l_extendedprice * l_discount), 3) AS program_part FROM lineitem
""")
def reward_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_extendedprice") * F.col("l_discount")).alias("judged"))
    return ev.reward_parts(rows, "l_extendedprice", "judged").select(*[F.round(c, 3).alias(c) for c in ("judge_part", "program_part")])


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: event-time windows."""
    from evispark.streaming.folds import windowed_events

    return windowed_events(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
