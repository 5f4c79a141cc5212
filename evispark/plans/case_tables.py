"""Cases out of conversations, as SQL and as DataFrames: turns are evidence items, an assistant's turns the rounds of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.sources.readers import table

CASES = """
WITH items AS (SELECT 'c' || conv_id AS case_id, CAST(turn AS INT) AS pos, 'E' || (turn // 2 + 1) || '.' || (turn % 2 + 1) AS evidence_id, role || ' turn ' || turn AS neutral_title, text, CASE role WHEN 'user' THEN 'S1' ELSE 'S2' END AS source_id FROM conversations),
r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, conv_id + turn AS k FROM conversations WHERE role = 'assistant'),
rounds AS (SELECT 'c' || conv_id AS case_id, CAST(nth AS INT) AS round, CASE WHEN nth = 1 THEN CASE WHEN conv_id % 4 = 0 THEN 'H1 alone' ELSE 'H1 and H2' END WHEN k % 5 = 0 THEN 'H3 Appears' ELSE 'H1, see E' || (turn // 2 + 1) || '.1' END AS note,
  CASE k % 6 WHEN 0 THEN ['E1.1', 'E1.1'] WHEN 1 THEN ['E99.9'] ELSE ['E' || (turn // 2 + 1) || '.1', 'E' || (turn // 2 + 1) || '.2'] END AS fetch_ids, CASE WHEN k % 7 = 0 THEN 'short' ELSE 'reason of turn ' || turn END AS reason FROM r0),
finals AS (SELECT DISTINCT 'c' || conv_id AS case_id, conv_id, CASE conv_id % 3 WHEN 0 THEN 'CASE CLOSED by E1.1' WHEN 1 THEN 'CASE NOT CLOSED, as E2.1 is open' ELSE 'no decision' END AS final, CASE conv_id % 2 WHEN 0 THEN 'determined' ELSE 'undetermined' END AS expected FROM conversations),
known AS (SELECT case_id, list(DISTINCT evidence_id) AS known, list(DISTINCT evidence_id) FILTER (evidence_id LIKE 'E1.%') AS opening FROM items GROUP BY case_id),
d0 AS (SELECT rounds.*, coalesce(known, []) AS known, coalesce(opening, []) AS opening, list_filter(list_distinct(fetch_ids), lambda x: NOT list_contains(coalesce(known, []), x)) AS unknown FROM rounds LEFT JOIN known USING (case_id)),
d1 AS (SELECT *, list_distinct(list_concat(opening, flatten(coalesce(list(CASE WHEN len(unknown) = 0 THEN fetch_ids ELSE [] END) OVER (PARTITION BY case_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])))) AS seen FROM d0),
folded AS (SELECT *, CASE WHEN len(unknown) = 0 THEN list_filter(CASE WHEN fetch_ids[1] = fetch_ids[2] THEN fetch_ids[1:1] ELSE fetch_ids END, lambda x: NOT list_contains(seen, x)) ELSE [] END AS fresh, list_filter(fetch_ids, lambda x: list_contains(seen, x)) AS again FROM d1)
"""


def case_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = table(spark, sf_dir, "conversations").withColumn("case_id", F.concat(F.lit("c"), F.col("conv_id")))
    t, conv = F.col("turn"), F.col("conv_id")
    group = F.concat(F.lit("E"), (F.floor(t / 2) + 1).cast("string"))
    item = F.concat(group, F.lit("."), (t % 2 + 1).cast("string"))
    items = c.select("case_id", t.cast("int").alias("pos"), item.alias("evidence_id"), F.concat_ws(" turn ", "role", t.cast("string")).alias("neutral_title"), "text", F.when(F.col("role") == "user", "S1").otherwise("S2").alias("source_id"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    own = c.where("role = 'assistant'").withColumn("round", nth)
    k = conv + t
    note = F.when(F.col("round") == 1, F.when(conv % 4 == 0, "H1 alone").otherwise("H1 and H2")).when(k % 5 == 0, "H3 Appears").otherwise(F.concat(F.lit("H1, see "), group, F.lit(".1")))
    ids = F.when(k % 6 == 0, F.array(F.lit("E1.1"), F.lit("E1.1"))).when(k % 6 == 1, F.array(F.lit("E99.9"))).otherwise(F.array(F.concat(group, F.lit(".1")), F.concat(group, F.lit(".2"))))
    rounds = own.select("case_id", "round", note.alias("note"), ids.alias("fetch_ids"), F.when(k % 7 == 0, "short").otherwise(F.concat(F.lit("reason of turn "), t)).alias("reason"))
    final = F.when(conv % 3 == 0, "CASE CLOSED by E1.1").when(conv % 3 == 1, "CASE NOT CLOSED, as E2.1 is open").otherwise("no decision")
    finals = c.select("case_id", "conv_id").distinct().select("case_id", "conv_id", final.alias("final"), F.when(conv % 2 == 0, "determined").otherwise("undetermined").alias("expected"))
    return {"items": items, "rounds": rounds, "finals": finals}
