"""Near-duplicates, leaks and verification over documents and test items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as t
from evispark.operators import counterfactual as cf
from evispark.operators import extraction as ex
from evispark.plans.registry import query
from evispark.plans.text import STOPS, TOKENS
from evispark.sources.readers import table

GRAMS = "list_distinct([array_to_string(toks[i:i+5], ' ') FOR i IN range(1, CAST(len(toks) AS BIGINT) - 4)])"


@query(f"""
WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), b AS (SELECT item_id, {TOKENS} AS toks FROM benchmark),
dg AS (SELECT doc_id, unnest({GRAMS}) AS gram FROM d WHERE len(toks) >= 6), bg AS (SELECT item_id, unnest({GRAMS}) AS gram FROM b WHERE len(toks) >= 6)
SELECT item_id, doc_id, count(*) AS n_shingles FROM dg JOIN bg USING (gram) GROUP BY ALL HAVING count(*) >= 2
""")
def benchmark_ngram_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = lambda df, key: df.select(key, t.words(F.lower("text")).alias("w")).select(key, F.explode(t.ngrams(F.col("w"), 6)).alias("gram"))
    left, right = grams(table(spark, sf_dir, "documents"), "doc_id"), grams(table(spark, sf_dir, "benchmark"), "item_id")
    return left.join(right, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("n_shingles")).where("n_shingles >= 2")


@query(f"""
WITH w AS (SELECT source, doc_id, list_distinct({TOKENS}) AS s FROM documents), p AS (
  SELECT a.source, a.doc_id AS a_id, b.doc_id AS b_id, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM w a JOIN w b ON a.source = b.source AND a.doc_id < b.doc_id WHERE len(a.s) > 0 AND len(b.s) > 0)
SELECT source, a_id, b_id, round(i / (n - i), 6) AS jaccard FROM p WHERE i / (n - i) >= 0.88
""")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ex.alike_pairs(table(spark, sf_dir, "documents"), "source", "doc_id", t.words(F.lower("text")))
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query()
def near_duplicate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is a source of one language, whatever its ids."""
    docs = table(spark, sf_dir, "documents").withColumn("case", F.concat_ws(":", "source", "lang"))
    return ex.near_duplicates(docs, "case", "doc_id", "text")


NORMED = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
CONTENT = f"list_filter(regexp_extract_all({{}}, '[a-z0-9][a-z0-9''\\-.]*'), lambda w: length(w) > 1 AND NOT list_contains([{STOPS}], w))"


@query(f"""
WITH d AS (SELECT doc_id, {NORMED.format("text")} AS hay, array_to_string(regexp_split_to_array(text, '\\s+')[3:12], '  ') AS item FROM documents),
q AS (SELECT *, {NORMED.format("replace(replace(upper(item), 'ẞ', 'SS'), 'ß', 'SS')")} AS quote, {CONTENT.format(NORMED.format("item"))} AS words, {CONTENT.format("hay")} AS pool FROM d), w AS (SELECT *, string_split(quote, ' ') AS toks FROM q),
f AS (SELECT *, quote <> '' AND (contains(hay, quote) OR (len(toks) >= 5 AND (contains(hay, array_to_string(toks[2:], ' ')) OR contains(hay, array_to_string(toks[:len(toks) - 1], ' ')) OR contains(hay, array_to_string(toks[2:len(toks) - 1], ' '))))) AS quote_found,
  CASE WHEN len(words) = 0 THEN 0.0 ELSE len(list_filter(words, lambda x: list_contains(pool, x))) / len(words) END AS overlap FROM w)
SELECT quote_found, quote_found OR overlap >= 0.6 AS accepted, count(*) AS n, round(avg(overlap), 4) AS overlap FROM f GROUP BY ALL
""")
def verified_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote is the words 3 to 12 of a document; the text to find it in is the document, in capitals and other spaces."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(0).alias("block_idx"), "text")
    quote = F.array_join(F.slice(F.split("text", r"\s+"), 3, 10), "  ")
    items = docs.select("case_id", "block_idx", F.upper(quote).alias("quote"), quote.alias("text"))
    out = ex.verify_items(items, docs, ["case_id", "block_idx"])
    return out.groupBy("quote_found", "accepted").agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 4).alias("overlap"))


@query()
def restated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that others of their case restate: a case is a source's documents of one language."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("case_id"), F.col("doc_id").cast("string").alias("evidence_id"), "text")
    return cf.leak_check(docs, None, docs).where("likely").select("case_id", "evidence_id", "target", "number", "token", "shingle")
