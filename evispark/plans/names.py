"""Names, sources, numbers and repairs of texts, over English documents and the cases that `case_tables` makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import numeric as nf
from evispark.functions import text as t
from evispark.operators import anonymise, contract, extraction
from evispark.operators import counterfactual as cf
from evispark.plans.case_tables import CASES, case_tables
from evispark.plans.registry import query
from evispark.sources.readers import table


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '\b[Aa]n?\s+(the|a|an)\b', '\1', 'g') AS x FROM documents WHERE lang = 'en'), b AS (SELECT doc_id, regexp_replace(x, '(?i)\b(the)\s+the\b', '\1', 'g') AS x FROM a)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(x, '\s+([,.;:])', '\1', 'g'), '\s{2,}', ' ', 'g'))) AS tidied FROM b
""")
def tidied_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return english(spark, sf_dir).select("doc_id", F.sha2(t.tidy("text"), 256).alias("tidied"))


@query(r"""
WITH l AS (SELECT doc_id, replace(replace(replace(text, '. ', '-' || chr(10)), chr(13) || chr(10), chr(10)), chr(12), chr(10)) AS x FROM documents WHERE lang = 'en')
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(x, '([\pL\pN_])-\n\s*([\pL\pN_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS cleaned FROM l
""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stop before a space stands for a hyphen at a line's end."""
    broken = F.replace("text", F.lit(". "), F.lit("-\n"))
    return english(spark, sf_dir).select("doc_id", F.sha2(t.clean_pdf_text(broken), 256).alias("cleaned"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)\bthat\b', 'this', 'g'), '(?i)\bthe\b', 'one', 'g')) AS replaced, sha256(regexp_replace(text, '(?i)\band\b', 'the report', 'g')) AS removed, regexp_matches(text, '(?i)\band\b') AS found FROM documents WHERE lang = 'en'
""")
def replaced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words replaced as names are, a third removed by force."""
    pairs = F.array(F.struct(F.lit("the").alias("old"), F.lit("one").alias("new")), F.struct(F.lit("that").alias("old"), F.lit("this").alias("new")))
    gone = anonymise.force_remove(F.col("text"), F.array(F.lit("and")), anonymise.neutral_for(F.lit("title")))
    rows = english(spark, sf_dir).select("doc_id", anonymise.substitute(F.col("text"), pairs, F.lit(True)).alias("s"), gone.alias("g"))
    return rows.select("doc_id", F.sha2("s", 256).alias("replaced"), F.sha2("g.text", 256).alias("removed"), (F.size("g.removed") > 0).alias("found"))


@query(CASES + """
, m AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS target FROM items), f AS (SELECT *, target IS NULL AS unmapped, coalesce(target, first(target IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS named FROM m),
o AS (SELECT *, min(pos) OVER (PARTITION BY case_id, named) AS first_pos FROM f)
SELECT case_id, pos, named AS target, unmapped, 'S' || dense_rank() OVER (PARTITION BY case_id ORDER BY first_pos) AS source_id FROM o
""")
def canonical_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed sources p0 to p2 are known, p3 isn't."""
    items = case_tables(spark, sf_dir)["items"].select("case_id", "pos", F.concat(F.lit("p"), F.col("pos") % 4).alias("proposed"))
    mapping = items.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.struct(F.lit(a).alias("proposed"), F.lit(b).alias("target")) for a, b in (("p0", "B"), ("p1", "A"), ("p2", "B"))])).alias("m")).select("case_id", "m.*")
    return extraction.canonical_sources(items, mapping).select("case_id", "pos", "target", "unmapped", "source_id")


@query("""
WITH c AS (SELECT 'n' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS native_id, doc_id FROM documents), b AS (SELECT native_id, 'X-' || lpad(CAST(doc_id // 3 + 1 AS VARCHAR), 4, '0') AS case_id FROM c WHERE doc_id % 3 = 0 AND doc_id < 600), top AS (SELECT max(CAST(substr(case_id, 3) AS INT)) AS n FROM b)
SELECT native_id, case_id, false AS new FROM c JOIN b USING (native_id) UNION ALL SELECT native_id, 'X-' || CASE WHEN n + nth > 9999 THEN CAST(n + nth AS VARCHAR) ELSE lpad(CAST(n + nth AS VARCHAR), 4, '0') END, true FROM (SELECT native_id, row_number() OVER (ORDER BY native_id) AS nth FROM c ANTI JOIN b USING (native_id)), top
""")
def planned_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.lpad(k.cast("string"), 9, "0")).alias("native_id"), k.alias("doc_id"))
    built = rows.where("doc_id % 3 = 0 AND doc_id < 600").select("native_id", F.concat(F.lit("X-"), F.lpad((F.floor(k / 3) + 1).cast("string"), 4, "0")).alias("case_id"))
    return extraction.plan_cases(rows.select("native_id"), built, "X-")


@query(CASES + """
, u AS (SELECT case_id, unnest(fetch_ids) AS evidence_id, CASE round % 3 WHEN 1 THEN 'G' WHEN 2 THEN 'N' ELSE 'A' END AS role FROM rounds), g AS (SELECT case_id, evidence_id FROM u GROUP BY ALL HAVING bool_or(role = 'G'))
SELECT g.case_id, g.evidence_id FROM g SEMI JOIN items USING (case_id, evidence_id) WHERE evidence_id NOT LIKE 'E1.%'
""")
def ground_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, k = case_tables(spark, sf_dir), F.col("round") % 3
    units = tables["rounds"].select("case_id", F.col("fetch_ids").alias("ids"), F.when(k == 1, "G").when(k == 2, "N").otherwise("A").alias("role"))
    return cf.key_sets(units, tables["items"], cf.protected(F.col("evidence_id"), F.lit("report"), F.lit("a title")))


@query(CASES + """
SELECT case_id, round, len(list_distinct(fetch_ids)) = len(fetch_ids) AND length(reason) >= 10 AS valid, CASE round % 5 WHEN 1 THEN 'malformed markup' WHEN 2 THEN 'multiple calls' WHEN 3 THEN 'unknown tool' WHEN 4 THEN 'trailing text' ELSE '' END AS errors FROM rounds
""")
def call_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("round") % 5
    one = "<tool_call><function=%s></function></tool_call>"
    said = F.when(k == 1, "<tool_call>").when(k == 2, one % "fetch_evidence" * 2).when(k == 3, one % "search").when(k == 4, one % "fetch_evidence" + " and more").otherwise(one % "fetch_evidence")
    said = F.when(k == 1, "<tool_call><function=fetch_evidence>").otherwise(said)
    errors = F.filter(contract.call_errors(said), lambda e: (k != 2) | (e == "multiple calls"))
    return case_tables(spark, sf_dir)["rounds"].select("case_id", "round", contract.tool_arguments_valid(F.col("fetch_ids"), F.col("reason")).alias("valid"), F.array_join(errors, ",").alias("errors"))


@query("""
SELECT l_orderkey, l_linenumber, round(-1 + least(40.0, greatest(10.0, l_quantity)) / 15.0 - 10 / 15.0, 6) AS scaled, CAST(floor(l_quantity / 4 + 0.5) AS BIGINT) AS up, CASE WHEN l_quantity % 4 = 2 THEN CAST(2 * round(floor(l_quantity / 4) / 2.0 + 0.25) AS DOUBLE) ELSE CAST(round(l_quantity / 4) AS DOUBLE) END AS even FROM lineitem
""")
def scaled_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities from 10 to 40 as -1 to 1; quarters of them, rounded half up and half to even."""
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(nf.rescale(q, 10, 40, -1, 1), 6).alias("scaled"), nf.round_half_up(q / 4).cast("bigint").alias("up"), nf.round_half_even(q / 4, 0).alias("even"))
