"""Packages, references and counterfactual variants of the cases that `case_tables` makes out of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import numeric
from evispark.functions import text as t
from evispark.operators import counterfactual as cf
from evispark.operators import packages as p
from evispark.plans.case_tables import CASES, case_tables
from evispark.plans.registry import query
from evispark.sources.readers import table

KINDS = CASES + """
, kinds AS (SELECT *, CAST(substr(case_id, 2) AS BIGINT) AS conv_id, CASE pos % 4 WHEN 0 THEN 'statement' WHEN 1 THEN 'observation' WHEN 2 THEN 'measurement' ELSE 'other' END AS kind FROM items)
"""


def kind_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pos") % 4
    items = case_tables(spark, sf_dir)["items"]
    return items.withColumn("conv_id", F.substring("case_id", 2, 20).cast("bigint")).withColumn("kind", F.when(k == 0, "statement").when(k == 1, "observation").when(k == 2, "measurement").otherwise("other"))


@query(CASES + """
SELECT case_id, CASE WHEN conv_id % 3 = 0 THEN 'From S1 alone.' WHEN conv_id % 7 = 0 THEN 'A b' ELSE 'A b. Sources: S1 = first; S2 = second.' END AS initial_context, true AS ok FROM finals
""")
def scenario_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, k = case_tables(spark, sf_dir)["finals"], F.col("conv_id")
    sources = cases.where(k % 7 != 0).select("case_id", F.explode(F.array(F.struct(F.lit("S2").alias("id"), F.lit("second").alias("description")), F.struct(F.lit("S1").alias("id"), F.lit("first").alias("description")))).alias("s")).select("case_id", "s.*")
    context = F.when(k % 3 == 0, " From  S1 alone. ").when(k % 7 == 0, "A b").otherwise("A  b..")
    return p.contexts(cases.select("case_id", context.alias("initial_context")), sources)


@query(CASES + """
, r AS (SELECT case_id, round AS pos, CASE WHEN round % 4 = 0 THEN ' ' ELSE 'mechanism  ' || round END AS mechanism, list_distinct(fetch_ids) AS ids, known FROM d0),
k AS (SELECT case_id, pos, len(list_filter(ids, lambda x: list_contains(known, x))) AS cited, len(list_filter(ids, lambda x: NOT list_contains(known, x))) AS invented FROM r WHERE trim(mechanism) <> '')
SELECT case_id, 'C' || row_number() OVER (PARTITION BY case_id ORDER BY pos) AS id, 'mechanism ' || pos AS mechanism, CAST(cited AS INT) AS cited, CAST(invented AS INT) AS invented, pos % 2 = 1 AS verbatim FROM k
""")
def reference_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = case_tables(spark, sf_dir)
    r = F.col("round")
    quote = F.when(r % 2 == 1, "The  board’s finding").otherwise("nothing of the kind")
    replies = tables["rounds"].select("case_id", r.alias("pos"), F.when(r % 4 == 0, " ").otherwise(F.concat(F.lit("mechanism  "), r)).alias("mechanism"), quote.alias("quote"), F.array_distinct("fetch_ids").alias("evidence_ids"))
    analyses = tables["finals"].select("case_id", F.lit("It was the board's\nfinding that counts").alias("analysis"))
    out = p.rejections(replies, tables["items"], analyses)
    return out.select("case_id", "id", "mechanism", F.size("evidence_ids").alias("cited"), F.size("invented").alias("invented"), "verbatim")


@query(CASES + """
, d AS (SELECT case_id, conv_id, CASE conv_id % 4 WHEN 0 THEN 'determined' WHEN 1 THEN 'undetermined' WHEN 2 THEN 'undetermined' ELSE 'determined' END AS first FROM finals)
SELECT case_id, CASE WHEN conv_id % 5 = 0 THEN 'undetermined' ELSE first END AS determination, CASE WHEN conv_id % 5 = 0 AND first <> 'undetermined' THEN first END AS overridden_from FROM d
""")
def determinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stated, else by the conclusion's words; a review overrules some."""
    cases, k = case_tables(spark, sf_dir)["finals"], F.col("conv_id")
    stated = F.when(k % 4 == 0, " Determined ").when(k % 4 == 1, "undetermined").otherwise("maybe")
    conclusion = F.when(k % 4 == 2, "The cause could not be established.").otherwise("It broke; more could not be asked of it.")
    first = cases.select("case_id", p.determination(stated, conclusion).alias("determination"))
    reviews = cases.select("case_id", (k % 5 != 0).alias("agrees"), F.lit("UNDETERMINED").alias("should_be"))
    return p.override(first, reviews).select("case_id", "determination", "overridden_from")


@query(KINDS + """
, f AS (SELECT *, first(source_id) OVER w AS primary_source FROM kinds WINDOW w AS (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, source_id = primary_source AND kind IN ('observation', 'measurement') AS wanted, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS nth FROM f),
n AS (SELECT *, sum(CAST(wanted AS INT)) OVER (PARTITION BY case_id ORDER BY pos) AS so_far, max(CAST(wanted AS INT)) OVER (PARTITION BY case_id) AS has FROM m),
r AS (SELECT *, (wanted AND so_far <= 2) OR (has = 0 AND nth = 1) AS record FROM n),
g AS (SELECT *, min(CASE WHEN NOT record THEN pos END) OVER (PARTITION BY case_id, source_id) AS first_use FROM r),
h AS (SELECT *, CASE WHEN record THEN 1 ELSE 1 + dense_rank() OVER (PARTITION BY case_id, record ORDER BY first_use) END AS grp FROM g)
SELECT case_id, evidence_id, 'E' || grp || '.' || row_number() OVER (PARTITION BY case_id, grp ORDER BY pos) AS new_id FROM h
""")
def regrouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.regroup(kind_items(spark, sf_dir), most=2).select("case_id", "evidence_id", "new_id")


@query("""
WITH i AS (SELECT conv_id, turn, conv_id % 3 AS source, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
c AS (SELECT source, conv_id, count(*) AS n, least(count(*), 4) AS record FROM i GROUP BY ALL)
SELECT source, count(*) AS packages, CAST(floor(quantile_cont(record, 0.5)) AS INT) AS record_median, min(n - record) AS requestable_min, CAST(floor(quantile_cont(n - record, 0.5)) AS INT) AS requestable_median, max(n - record) AS requestable_max, CAST(count(*) FILTER (n - record < 10) AS BIGINT) AS under_10 FROM c GROUP BY source
""")
def regroup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kind_items(spark, sf_dir).withColumn("source_id", F.lit("S1")).withColumn("kind", F.lit("observation")).withColumn("source", F.col("conv_id") % 3)
    return p.regroup_report(p.regroup(items), "source")


@query(KINDS + """
, ids AS (SELECT case_id, list(evidence_id) AS known FROM items GROUP BY case_id)
SELECT case_id, 'see ' || (CASE WHEN list_contains(known, 'E1.2') THEN 'E1.2' ELSE 'dropped:E1.2' END) || ' and dropped:E77.1' AS text FROM ids
""")
def rewritten_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items are of one source and wanted, so the record keeps its order: E1.2 is the second item before and after."""
    items = kind_items(spark, sf_dir).withColumn("source_id", F.lit("S1")).withColumn("kind", F.lit("observation"))
    references = items.select("case_id").distinct().withColumn("text", F.lit("see E1.2 and E77.1"))
    return p.rewrite(references, p.regroup(items))


@query(KINDS + """
, v AS (SELECT case_id, count(*) AS items, CAST(count(*) FILTER (pos % 3 = 0) AS BIGINT) AS quote_unverified, CAST(count(*) FILTER (pos % 5 = 0) AS BIGINT) AS low_overlap_items, CAST(count(*) FILTER (pos % 7 = 1) AS BIGINT) AS near_duplicates_dropped, round(avg(pos / 4.0), 3) AS mean_coverage FROM kinds GROUP BY case_id),
r AS (SELECT case_id, count(*) AS counterevidence, CAST(count(*) FILTER (round % 2 = 0) AS BIGINT) AS counterevidence_quote_unverified, CAST(count(*) FILTER (round % 3 = 0) AS BIGINT) AS counterevidence_without_evidence_ids FROM rounds GROUP BY case_id)
SELECT v.*, coalesce(counterevidence, 0) AS counterevidence, coalesce(counterevidence_quote_unverified, 0) AS counterevidence_quote_unverified, coalesce(counterevidence_without_evidence_ids, 0) AS counterevidence_without_evidence_ids,
  conv_id % 4 = 0 AS shown, conv_id % 6 = 0 AS concluded, conv_id % 3 = 0 AS dated FROM v LEFT JOIN r USING (case_id) JOIN finals USING (case_id)
""")
def package_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, pos = case_tables(spark, sf_dir), F.col("pos")
    items = tables["items"].withColumn("text", F.lit("a plain text")).withColumn("neutral_title", F.lit("a title"))
    k = F.col("conv_id")
    context = F.concat_ws(" ", F.when(k % 4 == 0, F.lit("at Mill-Lane  Road")), F.when(k % 6 == 0, F.lit("the probable cause")), F.when(k % 3 == 0, F.lit("on May 12, 2020")))
    cases = tables["finals"].select("case_id", context.alias("initial_context"), F.lit("what happened").alias("task_question"))
    checked = items.select("case_id", (pos % 3 != 0).alias("quote_verified"), F.when(pos % 5 == 0, 0.2).otherwise(0.9).alias("overlap"))
    rejected = tables["rounds"].select("case_id", (F.col("round") % 2 != 0).alias("verbatim"), F.when(F.col("round") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("E1.1"))).alias("evidence_ids"))
    withheld = tables["finals"].select("case_id", F.array(F.lit("Mill Lane Road")).alias("values"))
    names = tables["finals"].select("case_id", F.lit("Mill").alias("name"), F.lit(1).alias("place"))
    out = p.checks(p.visible_text(cases, items), checked, rejected, withheld, items.select("case_id", (pos % 7 == 1).alias("dropped")), items.select("case_id", (pos / 4.0).alias("coverage")), names)
    flags = [(F.size("withheld_still_present") > 0).alias("shown"), (F.size("conclusion_words_in_package") > 0).alias("concluded"), (F.size("residual_identifiers.dates") > 0).alias("dated")]
    counts = ["items", "quote_unverified", "low_overlap_items", "near_duplicates_dropped", "mean_coverage", "counterevidence", "counterevidence_quote_unverified", "counterevidence_without_evidence_ids"]
    return out.select("case_id", *counts, *flags)


@query(KINDS + r"""
, lines AS (SELECT case_id, pos, evidence_id, '- ' || evidence_id || ' | ' || neutral_title || ' | ' || CASE WHEN pos % 4 = 3 THEN 'end' ELSE kind END || ' | source ' || source_id AS head, 'x' || pos AS body FROM kinds)
SELECT case_id, sha256('# Case brief — ' || case_id || chr(10) || chr(10) || '## Task question' || chr(10) || 'q' || chr(10) || chr(10) || '## Initial context' || chr(10) || 'i' || chr(10) || chr(10) || '## Case record E1 (' || count(*) FILTER (evidence_id LIKE 'E1.%') || ' items, full text)' || chr(10) ||
  coalesce(string_agg(head || chr(10) || '  ' || body, chr(10) ORDER BY pos) FILTER (evidence_id LIKE 'E1.%'), '') || chr(10) || chr(10) || '## Index of the remaining ' || count(*) FILTER (evidence_id NOT LIKE 'E1.%') || ' evidence items (titles only)' || chr(10) || coalesce(string_agg(head, chr(10) ORDER BY pos) FILTER (evidence_id NOT LIKE 'E1.%'), '') ||
  chr(10) || chr(10) || 'Fetch exact text with request_evidence when needed. Finish with a direct answer that separates the supported mechanism, discounted alternatives, and unresolved details.') AS digest FROM lines GROUP BY case_id
""")
def case_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kind_items(spark, sf_dir).withColumn("text", F.concat(F.lit("x"), "pos")).withColumn("kind", F.when(F.col("pos") % 4 == 3, "").otherwise(F.col("kind"))).withColumn("locator", F.lit("page 3 | end"))
    cases = items.select("case_id").distinct().select("case_id", F.lit("q").alias("task_question"), F.lit("i").alias("initial_context"))
    return p.case_brief(cases, items).select("case_id", F.sha2("brief", 256).alias("digest"))


@query(KINDS + """
, v AS (SELECT case_id, 'level_000' AS level, count(*) AS kept, 0 AS changes FROM kinds GROUP BY case_id UNION ALL SELECT case_id, 'level_100', CAST(count(*) FILTER (pos % 3 <> 2) AS BIGINT), CASE WHEN count(*) FILTER (pos > 2 AND pos % 3 <> 2) = 0 THEN 1 ELSE 0 END FROM kinds GROUP BY case_id HAVING count(*) FILTER (pos % 3 = 2) > 0)
SELECT level, count(*) AS n, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(changes) AS BIGINT) AS changes FROM v GROUP BY level
""")
def variant_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third item is taken out; the briefs change by these alone, but for an empty line where an index is emptied."""
    items = kind_items(spark, sf_dir).withColumn("locator", F.lit(None).cast("string"))
    cases = items.select("case_id").distinct().select("case_id", *[F.lit(c).alias(c) for c in ("domain", "task_question", "initial_context")])
    removed = items.where("pos % 3 = 2").select("case_id", F.lit("level_100").alias("level"), "evidence_id")
    rows = removed.unionByName(cases.select("case_id", F.lit("level_000").alias("level"), F.lit(None).cast("string").alias("evidence_id")))
    packages, briefs = p.variants(cases, items, rows)
    gone = removed.join(items.select("case_id", "evidence_id", "text"), ["case_id", "evidence_id"])
    changes = p.brief_changes(p.case_brief(cases, items), briefs, gone).groupBy("case_id", "level").agg(F.count("*").alias("changes"))
    kept = F.size(F.from_json("package", "evidence_items array<struct<evidence_id:string>>")["evidence_items"])
    return packages.join(changes, ["case_id", "level"], "left").groupBy("level").agg(F.count("*").alias("n"), F.sum(kept.cast("bigint")).alias("kept"), F.coalesce(F.sum("changes"), F.lit(0).cast("bigint")).alias("changes"))


UNITS = CASES + """
, texts AS (SELECT case_id, conv_id, 'CASE CLOSED. The pump failed (E1.1, E1.2) as the ' || CASE WHEN conv_id % 2 = 0 THEN 'seal leaked [E2.1-E2.3] ' ELSE '' END || 'end.' || chr(10) || chr(10) || 'No other cause [E3.1].' AS final FROM finals),
u AS (SELECT case_id, conv_id, 0 AS unit, 0 AS paragraph, '. The pump failed' AS text, ['E1.1', 'E1.2'] AS ids FROM texts UNION ALL SELECT case_id, conv_id, 1, 0, 'as the seal leaked', ['E2.1', 'E2.2', 'E2.3'] FROM texts WHERE conv_id % 2 = 0
  UNION ALL SELECT case_id, conv_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 1 END, 1, 'No other cause', ['E3.1'] FROM texts)
"""


def unit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases, k = case_tables(spark, sf_dir)["finals"], F.col("conv_id")
    final = F.concat(F.lit("CASE CLOSED. The pump failed (E1.1, E1.2) as the "), F.when(k % 2 == 0, "seal leaked [E2.1-E2.3] ").otherwise(""), F.lit("end.\n\nNo other cause [E3.1]."))
    labels = cases.where(k % 5 != 0).select("case_id", F.when(k % 7 == 0, "GX").when(k % 2 == 0, "GNA").otherwise("GN").alias("roles"))
    return cf.citation_units(cases.select("case_id", final.alias("final"))), labels


@query(UNITS + "SELECT case_id, unit, paragraph, text, array_to_string(ids, ',') AS ids FROM u")
def citation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, _ = unit_tables(spark, sf_dir)
    return units.select("case_id", "unit", "paragraph", "text", F.array_join("ids", ",").alias("ids"))


@query(UNITS + """
, l AS (SELECT case_id, conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 7 = 0 THEN 'GX' WHEN conv_id % 2 = 0 THEN 'GNA' ELSE 'GN' END AS roles, CASE WHEN conv_id % 2 = 0 THEN 3 ELSE 2 END AS n FROM texts),
b AS (SELECT *, CASE WHEN roles IS NULL THEN 'no labels' WHEN length(roles) <> n THEN 'another number of labels' WHEN roles = 'GX' THEN 'unknown label' END AS problem FROM l)
SELECT coalesce(problem, 'role ' || substr(roles, CAST(u.unit + 1 AS BIGINT), 1)) AS what, count(*) AS n FROM b LEFT JOIN u ON u.case_id = b.case_id AND b.problem IS NULL GROUP BY 1
""")
def unit_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_roles, problems = cf.unit_roles(*unit_tables(spark, sf_dir))
    what = with_roles.select(F.concat(F.lit("role "), "role").alias("what")).unionByName(problems.select(F.col("problem").alias("what")))
    return what.groupBy("what").agg(F.count("*").alias("n"))


@query(CASES + """
, e AS (SELECT conv_id, final LIKE 'CASE CLOSED%' AS closed, CASE WHEN conv_id % 4 = 0 THEN 'host' ELSE 'report' END AS source, CASE conv_id % 2 WHEN 0 THEN 'closed' ELSE 'not_closed' END AS closure, CASE conv_id % 8 WHEN 0 THEN 'teacher_closed' ELSE 'teacher_open' END AS host_label FROM finals)
SELECT closed AS eligible, CASE WHEN source = 'host' AND (host_label = 'teacher_closed') <> closed THEN 'host label disagrees' WHEN (closure = 'closed') <> closed THEN 'metadata disagrees' END AS problem, count(*) AS n FROM e GROUP BY ALL
""")
def variant_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, k = case_tables(spark, sf_dir)["finals"], F.col("conv_id")
    rows = cases.select("case_id", "final", F.when(k % 4 == 0, "host").otherwise("report").alias("source"), F.when(k % 2 == 0, "closed").otherwise("not_closed").alias("closure"), F.when(k % 8 == 0, "teacher_closed").otherwise("teacher_open").alias("host_label"))
    return cf.eligibility(rows).groupBy("eligible", "problem").agg(F.count("*").alias("n"))


@query(CASES + """
, k AS (SELECT case_id, evidence_id FROM items WHERE pos % 2 = 0 AND evidence_id NOT LIKE 'E1.%'), p AS (SELECT case_id, evidence_id FROM items WHERE evidence_id NOT LIKE 'E1.%'),
n AS (SELECT k.case_id, count(*) AS k, (SELECT count(*) FROM p WHERE p.case_id = k.case_id) - count(*) AS rest FROM k GROUP BY k.case_id),
c AS (SELECT *, CASE WHEN k >= 3 THEN least(greatest(1, floor(k * 0.75 + 0.5)), k - 1) ELSE greatest(1, floor(k * 0.75 + 0.5)) END AS n75 FROM n),
d AS (SELECT *, CASE WHEN k >= 3 THEN least(greatest(1, floor(k * 0.40 + 0.5)), n75 - 1) ELSE greatest(1, floor(k * 0.40 + 0.5)) END AS n40 FROM c)
SELECT case_id, level, CAST(n AS BIGINT) AS n_removed FROM (SELECT case_id, 'level_000' AS level, 0 AS n FROM d UNION ALL SELECT case_id, 'level_040', n40 FROM d UNION ALL SELECT case_id, 'level_075', n75 FROM d UNION ALL SELECT case_id, 'level_100', k FROM d UNION ALL SELECT case_id, 'control', least(k, rest) FROM d WHERE rest > 0)
""")
def variant_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = case_tables(spark, sf_dir)["items"].where("evidence_id NOT LIKE 'E1.%'").select("case_id", "evidence_id", "pos")
    keys = items.where("pos % 2 = 0").select("case_id", "evidence_id")
    eligible = items.select("case_id").distinct().select("case_id", F.lit(True).alias("eligible"), F.lit(None).cast("string").alias("problem"))
    return cf.manifest(cf.variants(keys, items.select("case_id", "evidence_id"), 3), eligible).select("case_id", "level", "n_removed")


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '12 psi and 7 mm' WHEN 1 THEN '5% of 3 km' WHEN 2 THEN 'in 1999 and 20456 more' WHEN 3 THEN '1,234.5 at 14:05' WHEN 4 THEN '"the pump was loose" they said' ELSE '12.50 V' END AS text FROM documents)
SELECT text, CASE doc_id % 6 WHEN 0 THEN '12' WHEN 1 THEN '5' WHEN 2 THEN '20456' WHEN 3 THEN '1234.5' WHEN 4 THEN '' ELSE '12.50' END AS numbers, CASE WHEN doc_id % 6 = 4 THEN 'the pump was loose' ELSE '' END AS quotes, count(*) AS n FROM t GROUP BY ALL
""")
def telling_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    text = F.when(k == 0, "12 psi and 7 mm").when(k == 1, "5% of 3 km").when(k == 2, "in 1999 and 20456 more").when(k == 3, "1,234.5 at 14:05").when(k == 4, '"the pump was loose" they said').otherwise("12.50 V")
    out = table(spark, sf_dir, "documents").select(text.alias("text")).select("text", F.array_join(cf.numbers(F.col("text")), ",").alias("numbers"), F.array_join(cf.quotes(F.col("text")), ",").alias("quotes"))
    return out.groupBy("text", "numbers", "quotes").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'factual' ELSE 'unknown' END AS role, 'doc ' || doc_id || ' in ' || lang || ' {x}' AS filled, CASE doc_id % 4 WHEN 0 THEN '## B' || chr(10) || 'two' WHEN 1 THEN 'no head' WHEN 2 THEN '(empty)' ELSE '## A' || chr(10) || 'one' || chr(10) || chr(10) || '## B' || chr(10) || 'two' END AS picked,
  CASE doc_id % 4 WHEN 0 THEN 'two' END AS strict, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 'missing C' ELSE 'missing B' END AS problem, source || ':' || substr(sha256(source || ':' || doc_id), 1, 20) AS grp FROM documents
""")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "## B\n two \n## C\nx").when(k == 1, " no head ").when(k == 2, " ").otherwise("## A\none\n## B\ntwo\n")
    rows = docs.select("doc_id", "lang", "source", text.alias("x"))
    strict = t.strict_section("x", "B", "C")
    return rows.select(
        "doc_id", t.role_hint(F.when(k == 0, "Field reports").otherwise("Summary")).alias("role"), t.fill("doc {id} in {lang} {x}", {"id": F.col("doc_id"), "lang": F.col("lang")}).alias("filled"), t.pick_sections("x", ["A", "B"]).alias("picked"),
        strict["text"].alias("strict"), strict["problem"].alias("problem"), numeric.group_id(F.col("source"), F.col("doc_id").cast("string")).alias("grp"),
    )


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'The seal [E1.1, E1.2] leaked and the pump [E2.1] stopped.' END AS text, CASE doc_id % 4 WHEN 1 THEN 'an anchor is not there exactly once' WHEN 2 THEN 'unread or malformed ids' WHEN 3 THEN 'two citations at one place' END AS problem FROM documents
""")
def inserted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    one = lambda anchor, *ids: F.struct(F.lit(anchor).alias("anchor"), F.array(*[F.lit(i) for i in ids]).alias("ids"))
    wanted = F.when(k == 0, F.array(one("SEAL", "E1.1", "E1.2"), one("the pump", "E2.1"))).when(k == 1, F.array(one("the", "E1.1"))).when(k == 2, F.array(one("seal", "E9.9"))).otherwise(F.array(one("seal", "E1.1"), one("The seal", "E2.1")))
    done = t.insert_citations(F.lit("The seal leaked and the pump stopped."), wanted, F.array(*[F.lit(i) for i in ("E1.1", "E1.2", "E2.1")]))
    return table(spark, sf_dir, "documents").select("doc_id", done.alias("d")).select("doc_id", "d.text", "d.problem")
