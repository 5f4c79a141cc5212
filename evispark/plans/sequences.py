"""Token arrays and nested values: a turn's words stand for tokens, their lengths for ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import arrays as a
from evispark.functions import nested
from evispark.operators import sequences
from evispark.plans.registry import query
from evispark.sources.readers import table

TOKENS = "[CAST(length(w) AS INT) FOR w IN regexp_extract_all(text, '[A-Za-z]+')]"


def tokens() -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn's prompt is another one, every fifth turn's tokens are reversed, and some have no values."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("conv_id") + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens().alias("ids"))
    rows = rows.withColumn("prompt", F.flatten(F.coalesce(F.collect_list("ids").over(before), F.array().cast("array<array<int>>")))).where("role = 'assistant'")
    gen = F.when(k % 11 == 0, F.array().cast("array<int>")).when(k % 5 == 0, F.reverse("ids")).otherwise(F.col("ids"))
    return rows.select("conv_id", "turn", "prompt", F.size("prompt").alias("prompt_len"), F.when(k % 3 == 0, "other").otherwise(a.ids_digest(F.col("prompt"))).alias("prompt_sha"), gen.alias("gen_ids"), F.when(k % 7 != 0, F.transform(gen, lambda x: -x / F.lit(8.0))).alias("logprobs"))


@query(f"""
WITH c AS (SELECT conv_id, turn, role, {TOKENS} AS ids FROM conversations),
p AS (SELECT *, flatten(coalesce(list(ids) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS prompt, conv_id + turn AS k FROM c),
t AS (SELECT conv_id, turn, k, prompt, len(prompt) AS prompt_len, CASE WHEN k % 3 = 0 THEN 'other' ELSE sha256(array_to_string(prompt, ',')) END AS sha, CASE WHEN k % 11 = 0 THEN [] WHEN k % 5 = 0 THEN list_reverse(ids) ELSE ids END AS gen FROM p WHERE role = 'assistant'),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE len(gen) > 0 GROUP BY conv_id),
w AS (SELECT conv_id, last, list_concat(prompt, gen) AS seq, sha256(array_to_string(prompt, ',')) = sha AS good FROM t JOIN l USING (conv_id) WHERE turn = last),
s AS (SELECT conv_id, turn, good, seq, CASE WHEN len(gen) = 0 THEN 'no_tokens' WHEN turn < last AND (prompt_len + len(gen) > len(seq) OR sha256(array_to_string(seq[1:prompt_len], ',')) <> sha) THEN 'mismatch_prefix'
  WHEN turn < last AND seq[prompt_len + 1:prompt_len + len(gen)] <> gen THEN 'mismatch_tokens' WHEN k % 7 = 0 THEN 'no_logprobs' ELSE 'ok' END AS status, len(gen) AS n, list_sum(gen) / 8.0 AS value FROM t JOIN w USING (conv_id))
SELECT conv_id, CASE WHEN good THEN CAST(len(any_value(seq)) AS INT) END AS n_ids, CASE WHEN good THEN string_agg(status, ',' ORDER BY turn) END AS statuses,
  CASE WHEN good THEN CAST(coalesce(sum(n) FILTER (status = 'ok'), 0) AS INT) END AS targets, CASE WHEN good THEN 0.0 - coalesce(sum(value) FILTER (status = 'ok'), 0.0) END AS total FROM s GROUP BY conv_id, good
""")
def assembled_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = generated(spark, sf_dir)
    last = turns.where(F.size("gen_ids") > 0).groupBy("conv_id").agg(F.max_by("prompt", "turn").alias("prompt_ids"))
    out = sequences.assemble(turns, last, ["conv_id"])
    total = F.aggregate("behaviour_logprobs", F.lit(0.0), lambda s, x: s + x)
    return out.select("conv_id", F.when(F.col("error").isNull(), F.size("input_ids")).alias("n_ids"), F.array_join("turn_status", ",").alias("statuses"), F.col("target_tokens").alias("targets"), total.alias("total"))


@query(f"""
WITH c AS (SELECT conv_id, turn, [CASE WHEN x % 3 = 0 THEN -100 ELSE x END FOR x IN {TOKENS}] AS labels, {TOKENS} AS ids FROM conversations)
SELECT conv_id, turn, CAST(len(ids) + (64 - len(ids) % 64) % 64 AS INT) AS padded, CAST(len(list_filter(labels[2:], lambda x: x <> -100)) AS INT) AS targets,
  CAST(len(list_filter(labels, lambda x: x <> -100 AND x > 4)) = len(list_filter(labels, lambda x: x > 4)) AS BOOLEAN) AS inside, CASE WHEN len(ids) % 2 = 0 THEN CAST(len(ids) AS INT) END AS aligned FROM c
""")
def padded_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of 64; the mask of long words lies within that of all targets; log-probabilities of even length fit."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens().alias("ids"))
    rows = rows.withColumn("labels", F.transform("ids", lambda x: F.when(x % 3 == 0, a.IGNORED).otherwise(x)))
    long = F.transform("labels", lambda x: (x > 4).cast("int"))
    halves = F.concat(F.slice("ids", 1, (F.size("ids") / 2).cast("int")), F.slice("ids", 1, (F.size("ids") / 2).cast("int")))
    fits = a.aligned(F.size("ids"), F.lit(None).cast("array<int>"), halves)
    return rows.select("conv_id", "turn", F.size(a.padded(F.col("ids"), F.lit(0), 64)).alias("padded"), F.size(a.target_positions(F.col("labels"))).alias("targets"), a.within_mask(long, a.loss_mask(F.col("labels"))).alias("inside"), F.when(fits.isNotNull(), F.size(fits)).alias("aligned"))


@query("""
SELECT CAST(props->>'$.k' AS DOUBLE) AS value, 'props/k' AS key, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT CAST(kind = 'error' AS INT)::DOUBLE, 'props/of/error', count(*) FROM (SELECT event_type AS kind FROM events) GROUP BY 1
""")
def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    more = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct((F.col("event_type") == "error").alias("error"), F.lit("text").alias("text"), F.array(F.lit(1)).alias("list")).alias("of")))
    each = events.select(F.explode(nested.scalars(more, "props")).alias("s"))
    return each.groupBy("s.key", "s.value").agg(F.count("*").alias("n"))


@query("""
SELECT 'doc.lang' AS path, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'doc.of[0].source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'doc.of[1]', 'E1.' || doc_id % 7, count(*) FROM documents GROUP BY doc_id % 7
""")
def json_string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    value = F.format_string('{"lang":"%s","n":%d,"of":[{"source":"%s"},"E1.%d"]}', "lang", "doc_id", "source", F.col("doc_id") % 7)
    return docs.select(F.explode(nested.string_leaves(value, "doc")).alias("s")).groupBy("s.path", "s.value").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT doc_id % 9 + 1 AS a, doc_id % 4 + 1 AS b FROM documents), m AS (SELECT *, CASE WHEN a <= 5 THEN 'E2.' || a ELSE 'dropped:E1.' || a END AS na, CASE WHEN b <= 5 THEN 'E2.' || b ELSE 'dropped:E1.' || b END AS nb FROM d)
SELECT 'see (' || na || ', ' || nb || ').' AS text, '{"' || na || '":["' || nb || '\\nx"]}' AS json, count(*) AS n FROM m GROUP BY ALL
""")
def remapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    known = F.create_map(*[F.lit(x) for i in range(1, 6) for x in (f"E1.{i}", f"E2.{i}")])
    text, value = F.format_string("see (E1.%d, E1.%d).", k % 9 + 1, k % 4 + 1), F.format_string('{"E1.%d":["E1.%d\\nx"]}', k % 9 + 1, k % 4 + 1)
    out = table(spark, sf_dir, "documents").select(nested.remap_text(text, known).alias("text"), nested.remap_json(value, known).alias("json"))
    return out.groupBy("text", "json").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT event_id % 5 AS k, count(*) AS n FROM events GROUP BY 1)
SELECT k, 'a,a.b,a.c,a.c.d' AS paths, CASE WHEN k = 4 THEN NULL ELSE '{"a":{"b":' || k || ',"c":[{"d":"x"}]}}' END AS changed, n FROM k
""")
def json_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number put at a.b; one path in five isn't there."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 5).alias("k")).agg(F.count("*").alias("n")).withColumn("json", F.lit('{"a": {"b": 7, "c": [{"d": "x"}]}}'))
    paths = F.array_join(F.transform(nested.key_paths(F.col("json"), "$"), lambda p: F.replace(F.regexp_replace(p, r"\[\d+\]", ""), F.lit("$."), F.lit(""))), ",")
    value = F.col("k").cast("string")
    return rows.select("k", paths.alias("paths"), F.when(F.col("k") == 4, nested.override(F.col("json"), "a.x", value)).otherwise(nested.override(F.col("json"), "a.b", value)).alias("changed"), "n")
