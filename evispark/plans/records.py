"""Joins, sets, contracts and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import contract, trajectory
from evispark.plans.registry import query
from evispark.sources.readers import table


@query("SELECT sha256(text) AS text_sha, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    return keyed.groupBy("text_sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


@query("SELECT s_suppkey, s_name, CAST(coalesce(lines, 0) AS BIGINT) AS lines FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS lines FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON s_suppkey = l_suppkey")
def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(lines, "s_suppkey", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("""
SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) = 1
""")
def first_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    first = orders.groupBy("c_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey").select("c_custkey", "first.o_orderkey")


@query("""
WITH a AS (SELECT doc_id AS case_id, quality * 2 + toxic * 3 + doc_id % 3 AS score, toxic = 1 AND doc_id % 7 = 0 AS hard FROM labels),
r AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM labels WHERE doc_id % 2 = 0),
b AS (SELECT doc_id AS case_id, 2 + doc_id % 4 AS score, doc_id % 11 = 0 AS hard FROM labels WHERE doc_id % 4 = 0)
SELECT outcome, count(*) AS n, CAST(count(use) AS BIGINT) AS used FROM (SELECT *, CASE outcome WHEN 'accepted_first' THEN 'first' WHEN 'accepted_revised' THEN 'revised' END AS use FROM (
  SELECT CASE WHEN a.hard THEN 'rejected_hard' WHEN a.score >= 4 THEN 'accepted_first' WHEN a.score <> 3 THEN 'rejected_score' WHEN r.status IS DISTINCT FROM 'ok' THEN 'revision_failed'
    WHEN b.score IS NULL THEN 'not_audited_again' WHEN NOT b.hard AND b.score >= 4 THEN 'accepted_revised' ELSE 'rejected_revised' END AS outcome
  FROM a LEFT JOIN r USING (case_id) LEFT JOIN b USING (case_id))) GROUP BY outcome
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    first = labels.select(k.alias("case_id"), (F.col("quality") * 2 + F.col("toxic") * 3 + k % 3).alias("score"), ((F.col("toxic") == 1) & (k % 7 == 0)).alias("hard"))
    revised = labels.where(k % 2 == 0).select(k.alias("case_id"), F.when(k % 5 == 0, "failed").otherwise("ok").alias("status"))
    second = labels.where(k % 4 == 0).select(k.alias("case_id"), (2 + k % 4).alias("score"), (k % 11 == 0).alias("hard"))
    return trajectory.gate(first, second, revised).groupBy("outcome").agg(F.count("*").alias("n"), F.count("use").alias("used"))


@query("""
WITH e AS (SELECT 'c' || conv_id AS case_id, CAST(turn AS INT) AS pos, CASE WHEN turn % 5 = 4 THEN 'X' ELSE 'E1.' || (turn + 1) END AS evidence_id, role AS neutral_title, CASE WHEN turn % 7 = 6 THEN ' ' ELSE text END AS text, CASE WHEN role = 'system' THEN 's' ELSE 'S1' END AS source_id FROM conversations)
SELECT rule, count(*) AS n FROM (
  SELECT 'evidence_id is malformed' AS rule FROM e WHERE NOT regexp_full_match(evidence_id, 'E[0-9]+(\\.[0-9]+)*') UNION ALL
  SELECT 'text is empty' FROM e WHERE trim(text) = '' UNION ALL SELECT 'source_id is malformed' FROM e WHERE NOT regexp_full_match(source_id, 'S[0-9]+') UNION ALL
  SELECT 'source_id is not declared' FROM e WHERE source_id <> 'S1' UNION ALL
  SELECT 'evidence_id is there twice' FROM (SELECT row_number() OVER (PARTITION BY case_id, evidence_id ORDER BY pos) AS k FROM e) WHERE k > 1) GROUP BY rule
""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    case = F.concat(F.lit("c"), F.col("conv_id"))
    evidence = turns.select(case.alias("case_id"), t.cast("int").alias("pos"), F.when(t % 5 == 4, "X").otherwise(F.concat(F.lit("E1."), t + 1)).alias("evidence_id"), F.col("role").alias("neutral_title"), F.when(t % 7 == 6, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("role") == "system", "s").otherwise("S1").alias("source_id"))
    packages = turns.select(case.alias("case_id")).distinct().select("case_id", *[F.lit(c).alias(c) for c in ("domain", "task_question", "initial_context", "version")], F.sha2("case_id", 256).alias("package_hash"), F.create_map(F.lit("S1"), F.lit("one")).alias("sources"))
    return contract.violations(packages, evidence).groupBy("rule").agg(F.count("*").alias("n"))


@query("""
WITH u AS (SELECT doc_id, 'label' AS reason FROM labels UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 5000)
SELECT doc_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM u GROUP BY doc_id
""")
def union_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("reason"))
    b = table(spark, sf_dir, "documents").where("n_chars > 5000").select("doc_id", F.lit("long").alias("reason"))
    return a.unionByName(b).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


@query("""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM documents WHERE doc_id % 17 <> 0)
SELECT 'overlap' AS fault, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'missing', (SELECT count(*) FROM documents ANTI JOIN s USING (doc_id)) UNION ALL SELECT 'unknown', (SELECT count(*) FROM s ANTI JOIN documents USING (doc_id))
""")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evispark.operators.sampling import split_faults

    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    split = F.when(k % 10 == 0, "val").when(k % 10 == 1, "test").otherwise("train")
    return split_faults(docs.where(k % 17 != 0).withColumn("split", split), "doc_id", docs)


@query("""
SELECT l_returnflag, width_bucket AS bin, count(*) AS n FROM (SELECT l_returnflag, CAST(floor((l_quantity - 0) / 5.0) + 1 AS INT) AS width_bucket FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50) GROUP BY ALL
""")
def quantity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = F.width_bucket(F.col("l_quantity"), F.lit(0.0), F.lit(50.0), F.lit(10)).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", bins.alias("bin")).where(F.col("bin").between(1, 10)).groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"))


@query("SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))
