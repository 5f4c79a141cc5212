"""Rollout groups: an order is a group, its lines are samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import groups as g
from evispark.operators import rewards as r
from evispark.operators import windows as w
from evispark.plans.registry import query
from evispark.sources.readers import table


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("l_returnflag") == "R", "closed").when(F.col("l_returnflag") == "A", "not_closed")
    label = F.when(F.col("l_linestatus") == "O", "closed").otherwise("not_closed")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("reward"), decision.alias("decision"), label.alias("label"))


SAMPLES = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, l_extendedprice * (1 - l_discount) AS reward,
  CASE l_returnflag WHEN 'R' THEN 'closed' WHEN 'A' THEN 'not_closed' END AS decision, CASE l_linestatus WHEN 'O' THEN 'closed' ELSE 'not_closed' END AS label FROM lineitem)
"""


@query(SAMPLES + """
SELECT l_orderkey, l_linenumber, round((reward - avg(reward) OVER v) / (stddev_pop(reward) OVER v + 1e-6), 4) AS advantage FROM s WINDOW v AS (PARTITION BY l_orderkey)
""")
def group_advantage_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.standard_advantage(samples(spark, sf_dir), ["l_orderkey"], F.col("reward")).select("l_orderkey", "l_linenumber", F.round("advantage", 4).alias("advantage"))


@query(SAMPLES + """
SELECT l_orderkey, l_linenumber, round(CASE WHEN decision IS NULL THEN reward ELSE reward - avg(reward - CASE WHEN decision = label THEN 1 ELSE -1 END) OVER (PARTITION BY l_orderkey, decision) END, 6) AS centred FROM s
""")
def centre_by_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = w.centre_by_decision(samples(spark, sf_dir), ["l_orderkey"], F.col("decision"), F.col("reward"), r.decision_reward(F.col("decision"), F.col("label")))
    return rows.select("l_orderkey", "l_linenumber", F.round("centred", 6).alias("centred"))


STATUS = SAMPLES + """
, st AS (SELECT l_orderkey, CASE WHEN max(CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END) = 1 THEN 'straggler' WHEN max(CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END) = 1 THEN 'infra'
  WHEN max(CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END) = 1 THEN 'sequence' WHEN max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) = 1 THEN 'judge_failure'
  WHEN max(reward) - min(reward) <= 1e-9 THEN 'identical_rewards' ELSE 'kept' END AS status, count(*) AS samples FROM s GROUP BY l_orderkey)
"""


@query(STATUS + "SELECT status, count(*) AS n FROM st GROUP BY status")
def degenerate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = g.group_status(samples(spark, sf_dir), "l_orderkey", "reward", F.col("l_quantity") >= 50, F.col("l_tax") >= 0.08, F.col("l_discount") >= 0.1, F.col("l_linenumber") == 7)
    return status.groupBy("status").agg(F.count("*").alias("n"))


@query(SAMPLES + """
SELECT CAST(l_linenumber AS BIGINT) AS dimension, count(*) AS n FROM (SELECT *, max(CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey % 100, l_linenumber) AS bad FROM s) WHERE bad = 0 GROUP BY l_linenumber
""")
def usable_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("grp", F.col("l_orderkey") % 100)
    return g.usable_dimensions(rows, "grp", "l_linenumber", F.col("l_tax") >= 0.08).groupBy(F.col("l_linenumber").cast("bigint").alias("dimension")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_totalprice, (row_number() OVER (ORDER BY sha256('3:' || o_orderkey), o_orderkey) - 1) % 4 AS mb FROM orders)
SELECT CAST(mb AS INT) AS mb, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM r GROUP BY mb
""")
def stride_minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evispark.operators.sampling import stride_minibatches

    out = stride_minibatches(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 4, 3)
    return out.groupBy("mb").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(SAMPLES + """
, q AS (SELECT *, CASE WHEN decision IS NOT NULL AND decision = label THEN 1.0 ELSE -1.0 END AS d, l_quantity / 50 AS qc, l_discount * 10 AS qg FROM s),
o AS (SELECT *, CASE WHEN decision IS NULL THEN d WHEN decision = 'closed' THEN d + 2 * qc - 1 ELSE d + 0.5 * (2 * qc - 1) + 0.5 * (2 * qg - 1) END AS outcome FROM q)
SELECT l_orderkey, l_linenumber, round(outcome, 6) AS outcome, round(outcome + CASE WHEN d > 0 THEN 1.0 ELSE 0.3 END * (0.5 * l_tax + l_discount) + CASE WHEN decision IS NULL THEN -2.0 ELSE 0.0 END, 6) AS total FROM o
""")
def reward_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    d = r.decision_reward(F.col("decision"), F.col("label"))
    qc, qg = F.col("l_quantity") / 50, F.col("l_discount") * 10
    missing = F.when(F.col("decision").isNull(), -2.0).otherwise(0.0)
    total = r.later_total(F.col("decision"), d, qc, qg, 0.5 * F.col("l_tax"), F.col("l_discount"), missing)
    return rows.select("l_orderkey", "l_linenumber", F.round(r.outcome(F.col("decision"), d, qc, qg), 6).alias("outcome"), F.round(total, 6).alias("total"))


@query("""
SELECT o_orderkey, round(CAST(CASE WHEN o_orderstatus = 'P' THEN -2.0 ELSE 0.0 END + greatest(-1.0, -0.1 * greatest(0, lines - 6)) + greatest(-1.0, -0.2 * late) AS DOUBLE), 6) AS penalty FROM (
  SELECT o_orderkey, o_orderstatus, count(*) AS lines, sum(CASE WHEN l_shipdate > o_orderdate + INTERVAL 60 DAY THEN 1 ELSE 0 END) AS late FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
""")
def structure_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    late = (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("int")
    each = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("lines"), F.sum(late).alias("late"))
    marker = F.when(F.col("o_orderstatus") != "P", "closed")
    none = F.lit(None).cast("array<string>")
    return each.select("o_orderkey", F.round(r.structure_penalty(marker, F.lit(None).cast("string"), none, F.lit(True), F.col("lines"), F.lit(0), F.col("late")), 6).alias("penalty"))


@query("""
WITH r AS (SELECT n_regionkey AS route, count(*) % 4 AS load, n_regionkey = 2 AS paused FROM nation GROUP BY 1), s AS (SELECT route, unnest(range(load, load + 9)) AS slot FROM r WHERE NOT paused)
SELECT route, count(*) AS requests FROM (SELECT * FROM s ORDER BY slot, route LIMIT 9) GROUP BY route
""")
def route_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("route")).agg((F.count("*") % 4).alias("load"), F.max(F.col("n_regionkey") == 2).alias("paused"))
    return g.choose_routes(routes, 9)


@query("""
SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') >= 0.9 * count(*) AND count(DISTINCT l_returnflag) >= 2 AS past FROM lineitem GROUP BY l_orderkey
""")
def straggler_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are final have ended; flags stand for groups that are kept."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_linestatus") == "F").cast("int")).alias("done"), F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("groups"))
    return each.select("l_orderkey", g.past_cutoff(F.col("done"), F.col("n"), F.col("groups"), 2).alias("past"))
