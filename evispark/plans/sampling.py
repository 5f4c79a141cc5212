"""Samplers, splits and packings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import numeric as nf
from evispark.operators import sampling as s
from evispark.operators import windows as w
from evispark.plans.registry import query
from evispark.sources.readers import table


@query("""
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha256('7:' || o_orderkey), o_orderkey) <= 5
""")
def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.per_stratum(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 5, 7)


@query("""
SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60) ORDER BY sha256('5:' || o_orderkey), o_orderkey LIMIT 20
""")
def head_then_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.head_then_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], "o_orderkey", 20, 5).select("o_orderkey")


@query("""
SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality = 0 ORDER BY sha256('9:' || doc_id), doc_id) <= CASE WHEN quality = 0 THEN 28 ELSE 12 END
""")
def two_strata_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.two_strata(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("quality") == 0, "doc_id", 40, 0.7, 9)


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)
(SELECT source, doc_id FROM r WHERE nth <= 2) UNION ALL (SELECT source, doc_id FROM r WHERE nth > 2 ORDER BY nth, source, doc_id LIMIT 13)
""")
def even_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.even_quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 53)


@query("""
WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('13:' || doc_id), doc_id) AS nth, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT source, lang, CASE WHEN nth <= floor(n * 0.1 + 0.5) THEN 'val' WHEN nth <= floor(n * 0.1 + 0.5) + floor(n * 0.15 + 0.5) THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY ALL
""")
def quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.quota_split(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", {"train": 0.75, "val": 0.1, "test": 0.15}, 13)
    return rows.groupBy("source", "lang", "split").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('2:' || o_orderkey), o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
e AS (SELECT *, greatest(1, floor(n * 0.1 + 0.5)) AS take, unnest([0, 1, 2]) AS epoch FROM b)
SELECT CAST(epoch AS INT) AS epoch, o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM e WHERE ((i - epoch * take) % n + n) % n < take GROUP BY ALL
""")
def subset_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.subset_epochs(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 0.1, 3, 2)
    return out.groupBy("epoch", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""
WITH d AS (SELECT o_orderkey, o_orderpriority, (CAST('0x' || substr(sha256('4:' || o_orderkey), 1, 8) AS BIGINT)) / 4294967296.0 AS u, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, round(-ln(greatest(u, 1e-12)) / (pow(CAST(n AS DOUBLE), 0.5) / n), 4) AS draw FROM d
""")
def weighted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.weighted_order(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 0.5, 4).select("o_orderkey", F.round("draw", 4).alias("draw"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS k FROM documents), p AS (SELECT CAST(floor((k - 2) / 2) AS BIGINT) AS pair_no, k % 2 AS side, doc_id FROM r WHERE k > 1)
SELECT pair_no, max(CASE WHEN side = 0 THEN doc_id END) AS left_id, max(CASE WHEN side = 1 THEN doc_id END) AS right_id FROM p GROUP BY pair_no HAVING count(*) = 2
""")
def adjacent_length_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.adjacent_pairs(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], "doc_id")


@query("""
WITH f AS (SELECT source, lang, doc_id, min(doc_id) OVER (PARTITION BY source, lang) AS first FROM documents)
SELECT source, doc_id, CAST(dense_rank() OVER (PARTITION BY source ORDER BY first) AS INT) AS group_no, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS INT) AS item_no FROM f
""")
def first_appearance_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.number_by_first_use(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source"], "lang", ["doc_id"]).select("source", "doc_id", "group_no", "item_no")


@query("""
WITH m AS (SELECT source, doc_id, lang = 'en' AS wanted, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS nth,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, bool_or(lang = 'en') OVER (PARTITION BY source) AS any_en FROM documents)
SELECT source, doc_id, CASE WHEN any_en THEN nth ELSE 1 END AS new_id FROM m WHERE (wanted AND nth <= 4) OR (NOT any_en AND r = 1)
""")
def opening_record_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.opening_record(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id", F.col("lang") == "en", 4).select("source", "doc_id", "new_id")


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 61, 4) AS BIGINT) % 8 AS INT) AS route FROM documents")
def hash_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", nf.route(F.col("doc_id").cast("string"), 8).alias("route"))


@query("SELECT conv_id, turn, CAST('0x' || substr(sha256(concat_ws(':', 17, CAST(conv_id AS VARCHAR), turn)), 1, 8) AS BIGINT) AS seed FROM conversations")
def turn_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nf.turn_seed(F.lit(17), F.col("conv_id").cast("string"), F.col("turn")).alias("seed"))


@query("""
WITH RECURSIVE o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM documents),
f(source, nth, n_chars, loads, shard) AS (SELECT source, nth, n_chars, [n_chars, 0, 0, 0], CAST(0 AS INT) FROM o WHERE nth = 1 UNION ALL
  SELECT o.source, o.nth, o.n_chars, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.n_chars ELSE x END), CAST(list_position(loads, list_min(loads)) - 1 AS INT) FROM f JOIN o ON o.source = f.source AND o.nth = f.nth + 1)
SELECT source, shard, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM f GROUP BY ALL
""")
def lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's batch is a source; the longest documents first, to the least loaded of four shards."""
    out = s.longest_first(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 4)
    return out.groupBy("source", "shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH RECURSIVE o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS nth FROM documents),
f(source, nth, n_chars, used, pack) AS (SELECT source, nth, n_chars, n_chars, CAST(0 AS INT) FROM o WHERE nth = 1 UNION ALL
  SELECT o.source, o.nth, o.n_chars, CASE WHEN used > 0 AND used + o.n_chars > 40000 THEN o.n_chars ELSE used + o.n_chars END, CAST(pack + CASE WHEN used > 0 AND used + o.n_chars > 40000 THEN 1 ELSE 0 END AS INT) FROM f JOIN o ON o.source = f.source AND o.nth = f.nth + 1)
SELECT source, pack, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM f GROUP BY ALL
""")
def next_fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.next_fit(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 40_000)
    return out.groupBy("source", "pack").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query()
def grouped_split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are groups, their most frequent language is the cell; 3000 trials."""
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy(F.col("source").alias("group_id")).agg(F.count("*").alias("size"), F.mode("lang", True).alias("cell"))
    size = {r.cell: r.n for r in groups.groupBy("cell").agg(F.sum("size").alias("n")).collect()}
    quotas = {(c,): {"val": round(n * 0.1), "test": round(n * 0.15)} for c, n in size.items()}
    return s.search_split(groups, ["cell"], quotas, 3000, 20)


@query("SELECT CAST(range AS BIGINT) AS step, round(CASE WHEN range < 10 THEN 5e-5 * (range + 1) / 10 ELSE 5e-5 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (range - 10) / 90.0))) END * 1e6, 6) AS lr_millionths FROM range(100)")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(100).select(F.col("id").alias("step"), F.round(nf.learning_rate(F.col("id"), 5e-5, 10, 100) * 1e6, 6).alias("lr_millionths"))
