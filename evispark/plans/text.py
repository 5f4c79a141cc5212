"""Text functions over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as t
from evispark.operators import windows
from evispark.plans.registry import query
from evispark.sources.readers import table

STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-.]*'), lambda w: length(w) > 1 AND NOT list_contains([{STOPS}], w))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INT) AS words FROM documents
WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) BETWEEN 20 AND 700 AND regexp_matches(text, '[0-9]') AND regexp_matches(text, '(?i)\\bthe\\b')
""")
def word_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return docs(spark, sf_dir).where(F.col("text").rlike("[0-9]") & F.col("text").rlike(r"(?i)\bthe\b")).select("doc_id", n.alias("words")).where(F.col("words").between(20, 700))


@query(f"""
WITH w AS (SELECT doc_id, source, {TOKENS} AS toks FROM documents), l AS (SELECT *, lag(toks) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM w)
SELECT doc_id, round(CASE WHEN len(toks) = 0 THEN 0.0 ELSE len(list_filter(toks, lambda x: list_contains(prev, x))) / len(toks) END, 6) AS overlap FROM l WHERE prev IS NOT NULL
""")
def token_overlap_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select("doc_id", "source", t.words(F.lower("text")).alias("toks"))
    rows = windows.before(rows, "source", "doc_id", ["toks"])
    return rows.select("doc_id", F.round(t.overlap(F.col("toks"), F.col("prev_toks")), 6).alias("overlap"))


@query(f"""
WITH e AS (SELECT source, doc_id, unnest(list_distinct({TOKENS})) AS token FROM documents)
SELECT source, token, count(*) AS df FROM e GROUP BY ALL HAVING count(*) <= 3
""")
def doc_frequency_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = docs(spark, sf_dir).select("source", F.explode(F.array_distinct(t.words(F.lower("text")))).alias("token"))
    return each.groupBy("source", "token").agg(F.count("*").alias("df")).where("df <= 3")


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS squashed FROM documents")
def squashed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", t.squash("text").alias("squashed"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g') AS clean FROM documents")
def control_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", t.strip_control("text").alias("clean"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])(stated|reported|recalled|said|described|told|advised|claimed|complained)($|[^\pL\pN_])') THEN 'statement'
  WHEN regexp_matches(text, '(?i)(^|[^\pL\pN_])(test|assay|culture|analysis|sample|laborator|specimen|scan|imaging|radiograph)') THEN 'test result' WHEN regexp_matches(text, '[0-9]') THEN 'measurement' ELSE 'observation' END AS kind FROM documents
""")
def normalised_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", t.normalise_kind(F.col("lang"), "text").alias("kind"))


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS INT) AS iso, CAST(ceil(length(text) / 2.5 * 1.2) AS BIGINT) AS tokens FROM documents
""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.size(F.regexp_extract_all("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0)))
    return docs(spark, sf_dir).select("doc_id", iso.alias("iso"), t.token_proxy(F.length("text")).cast("bigint").alias("tokens"))


@query("""
SELECT doc_id, CASE WHEN contains(text, 'CASE NOT CLOSED') THEN 'not_closed' WHEN contains(text, 'CASE CLOSED') THEN 'closed' END AS marker FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'CASE CLOSED ' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'CASE NOT CLOSED ' ELSE '' END || lang AS text FROM documents)
""")
def closure_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 0, "CASE CLOSED ").otherwise(""), F.when(k % 5 == 0, "CASE NOT CLOSED ").otherwise(""), "lang")
    return docs(spark, sf_dir).select("doc_id", t.closure_marker(text).alias("marker"))


@query("""
SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 12)) AS ws FROM documents
""".replace("list_distinct(", "CAST(len(list_distinct(").replace(">= 12))", ">= 12))) AS INT)").replace("AS ws", "AS long_words"))
def long_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 12)
    return docs(spark, sf_dir).select("doc_id", F.size(F.array_distinct(ws)).alias("long_words"))


@query(r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{2,}') AS found, length(regexp_replace(text, '[\x09\x0a\x0d\x20-\x7e£§°±–—’‘“”é]', '', 'g')) AS odd, string_split(text, chr(10)) AS lines FROM documents),
s AS (SELECT *, least(1.0, len(list_filter(found, lambda w: length(w) >= 4)) / greatest(len(found), 1)) AS long, len(list_filter(lines, lambda x: length(trim(x)) BETWEEN 1 AND 2)) / greatest(len(lines), 1) AS single FROM d)
SELECT doc_id, round(CAST(CASE WHEN trim(text) = '' OR NOT regexp_matches(text, '\pL') THEN 1.0 ELSE least(1.0, 0.5 * (odd / greatest(length(text), 1) * 20) + 0.3 * (1 - long) + 0.2 * least(1.0, single * 3)) END AS DOUBLE), 6) AS score FROM s
""")
def garbled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(t.garbled_score("text"), 6).alias("score"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: length(trim(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', ''))) >= 40)) AS INT) AS paragraphs FROM documents
""")
def paragraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line a paragraph; short ones belong to the one before, so the long ones count."""
    return docs(spark, sf_dir).select("doc_id", F.size(t.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("paragraphs"))


#: Letters beyond ASCII as a word character of RE2, whose word boundaries know ASCII alone.
ASCII_WORDS = "regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g')"


@query(rf"""
WITH d AS (SELECT doc_id, {ASCII_WORDS} AS text FROM documents)
SELECT doc_id, CAST(least(20, len(list_distinct(regexp_extract_all(text, '{t.DATES}')))) AS INT) AS dates, CAST(least(20, len(list_distinct(regexp_extract_all(text, '{t.REGISTRATIONS}')))) AS INT) AS registrations, CAST(len(regexp_extract_all(text, '{t.CONCLUSIONS}')) AS INT) AS conclusions FROM d
""")
def residual_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", t.residual_identifiers("text").alias("found"), t.conclusion_hits("text").alias("hits"))
    return found.select("doc_id", F.size("found.dates").alias("dates"), F.size("found.registration_like").alias("registrations"), F.size("hits").alias("conclusions"))
