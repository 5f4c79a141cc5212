"""Folds over conversations: words stand for evidence ids, turns for requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import windows as w
from evispark.operators.rewards import capped
from evispark.plans.registry import query
from evispark.sources.readers import table

WORDS = "regexp_extract_all(lower(text), '[a-z]{6,}')"


def word_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", ids.alias("ids"), F.length("text").alias("chars"))


FOLD = f"""
WITH t AS (SELECT conv_id, turn, role, {WORDS} AS ids FROM conversations),
f AS (SELECT *, flatten(coalesce(list(CASE WHEN role <> 'system' THEN ids ELSE [] END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS seen FROM t)
"""


@query(FOLD + """
SELECT conv_id, turn, CAST(len(ids) AS INT) AS n_ids, CAST(CASE WHEN role = 'system' THEN 0 ELSE len(list_filter(list_distinct(ids), lambda x: NOT list_contains(seen, x))) END AS INT) AS n_fresh FROM f
""")
def disclosure_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = w.disclosure_fold(word_turns(spark, sf_dir), ["conv_id"], "turn", "ids", F.col("role") != "system")
    return folded.select("conv_id", "turn", F.size("ids").alias("n_ids"), F.size("fresh").alias("n_fresh"))


@query(FOLD + """
, s AS (SELECT conv_id, CAST(sum(len(list_filter(ids, lambda x: list_contains(seen, x)))) AS BIGINT) AS rerequests FROM f GROUP BY conv_id)
SELECT conv_id, rerequests, round(CAST(greatest(-1.0, -0.1 * greatest(0, rerequests - 10)) AS DOUBLE), 6) AS penalty FROM s
""")
def rerequest_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = w.disclosure_fold(word_turns(spark, sf_dir), ["conv_id"], "turn", "ids", F.col("role") != "system")
    n = folded.groupBy("conv_id").agg(F.sum(w.rerequests(F.col("ids"), F.col("seen_before"))).alias("rerequests"))
    return n.withColumn("penalty", F.round(capped(-0.1, F.col("rerequests"), 10, -1.0), 6))


@query("""
SELECT conv_id, turn, prev_role, CAST(length(text) - prev_chars AS BIGINT) AS len_delta FROM (
  SELECT *, lag(role) OVER v AS prev_role, lag(length(text)) OVER v AS prev_chars FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND prev_role IS NOT NULL
""")
def turn_lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = w.previous(word_turns(spark, sf_dir), ["conv_id"], "turn", ["role", "chars"])
    return rows.where("role = 'assistant' AND prev_role IS NOT NULL").select("conv_id", "turn", "prev_role", (F.col("chars") - F.col("prev_chars")).cast("bigint").alias("len_delta"))


@query("""
SELECT conv_id, CAST(sum(CASE WHEN role <> before AND role <> 'system' AND before <> 'system' THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM (
  SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id
""")
def role_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.switches(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", none="system")


@query("""
SELECT conv_id, min(CASE WHEN hit THEN nth END) AS first_hit, CAST(coalesce(greatest(0.0, (5 - min(CASE WHEN hit THEN nth END)) / 4), 0.0) AS DOUBLE) AS k_time FROM (
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS nth, length(text) > 200 AS hit FROM conversations WHERE role = 'assistant') GROUP BY conv_id
""")
def first_hit_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.first_hit(word_turns(spark, sf_dir).where("role = 'assistant'"), ["conv_id"], "turn", F.col("chars") > 200)


@query("""
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('11:' || turn), turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations),
n AS (SELECT *, CASE WHEN k >= 3 THEN least(greatest(1, floor(k * 0.75 + 0.5)), k - 1) ELSE greatest(1, floor(k * 0.75 + 0.5)) END AS n75 FROM r),
m AS (SELECT *, CASE WHEN k >= 3 THEN least(greatest(1, floor(k * 0.40 + 0.5)), n75 - 1) ELSE greatest(1, floor(k * 0.40 + 0.5)) END AS n40 FROM n)
SELECT conv_id, level, count(*) AS n_removed FROM (
  SELECT conv_id, 'level_040' AS level FROM m WHERE nth <= n40 UNION ALL SELECT conv_id, 'level_075' FROM m WHERE nth <= n75 UNION ALL SELECT conv_id, 'level_100' FROM m) GROUP BY ALL
""")
def nested_removal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = w.removal_levels(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 11)
    return levels.groupBy("conv_id", "level").agg(F.count("*").alias("n_removed"))


@query("""
SELECT conv_id, CAST(count(DISTINCT role) AS BIGINT) AS roles, string_agg(role || ':' || turn, ',' ORDER BY turn) AS script FROM conversations GROUP BY conv_id
""")
def conversation_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(":", "role", F.col("turn").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("roles"), F.array_join(F.transform(listed, lambda s: s["line"]), ",").alias("script"))


@query("""
WITH t AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS word FROM conversations)
SELECT conv_id, word, min(turn) AS first_turn FROM t GROUP BY ALL
""")
def first_seen_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = word_turns(spark, sf_dir).select("conv_id", "turn", F.explode(F.array_distinct("ids")).alias("word"))
    return each.groupBy("conv_id", "word").agg(F.min("turn").alias("first_turn"))
