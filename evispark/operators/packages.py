"""Packages put together: context, reference, checks, regrouped records and variants with items taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as t
from evispark.functions.nested import remap_text
from evispark.functions.numeric import canonical_digest

#: Items of the opening record at most, and what kinds it prefers.
RECORD_MOST = 4
RECORD_KINDS = ("observation", "measurement")
#: An item whose words overlap less with its source counts as low.
LOW_OVERLAP = 0.6
#: Names that a check lists, at most.
NAMES = 25
NONE = "array<string>"


def contexts(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, initial_context, ok): a context that doesn't name S1 gets the table of sources after it. sources: case_id,
    id, description, in the order of id."""
    line = F.concat_ws(" = ", "id", "description")
    listed = sources.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"]), "; ").alias("_table"))
    squashed = t.squash("initial_context")
    out = cases.join(listed, "case_id", "left")
    whole = F.when(squashed.contains("S1") | F.col("_table").isNull(), squashed).otherwise(F.concat(F.regexp_replace(squashed, r"\.+$", ""), F.lit(". Sources: "), F.col("_table"), F.lit(".")))
    return out.select("case_id", whole.alias("initial_context"), (whole != "").alias("ok"))


def rejections(replies: DataFrame, items: DataFrame, analyses: DataFrame) -> DataFrame:
    """(case_id, id, mechanism, text, evidence_ids, invented, verbatim): the explanations that a reply rejects, C1 on;
    those without a mechanism are left out, ids of no item told apart. replies: case_id, pos, mechanism, quote,
    evidence_ids; analyses: case_id, analysis."""
    known = items.groupBy("case_id").agg(F.collect_set("evidence_id").alias("_known"))
    rows = replies.withColumn("mechanism", t.squash("mechanism")).where("mechanism <> ''").join(known, "case_id", "left").join(analyses, "case_id", "left")
    ids, have = F.coalesce("evidence_ids", F.array().cast(NONE)), F.coalesce("_known", F.array().cast(NONE))
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("pos"))
    verbatim = F.coalesce(t.contains_quote(t.norm("analysis"), t.norm("quote")), F.lit(False))
    return rows.select(
        "case_id", F.concat(F.lit("C"), nth).alias("id"), "mechanism", t.squash("quote").alias("text"), F.filter(ids, lambda i: F.array_contains(have, i)).alias("evidence_ids"),
        F.filter(ids, lambda i: ~F.array_contains(have, i)).alias("invented"), verbatim.alias("verbatim"),
    )


def determination(stated: Column, conclusion: Column) -> Column:
    """`determined` or `undetermined`: as a reply states it, else by what its conclusion says. Words that deny a finding have
    to stand there as such; a mere `could not` elsewhere decides nothing."""
    said = F.lower(t.squash(stated))
    denied = conclusion.rlike(r"(?i)not (?:be )?(?:determined|established)|could not (?:be )?(?:determin|establish)|undetermined|no defect")
    return F.when(said.isin("determined", "undetermined"), said).otherwise(F.when(F.coalesce(denied, F.lit(False)), "undetermined").otherwise("determined"))


def override(references: DataFrame, reviews: DataFrame) -> DataFrame:
    """references with determination as a review wants it, and `overridden_from` where that changed it. reviews: case_id,
    agrees, should_be."""
    joined = references.join(reviews.select("case_id", "agrees", F.lower(t.squash("should_be")).alias("_to")), "case_id", "left")
    changed = F.coalesce(~F.col("agrees") & F.col("_to").isin("determined", "undetermined") & (F.col("_to") != F.col("determination")), F.lit(False))
    return joined.withColumn("overridden_from", F.when(changed, F.col("determination"))).withColumn("determination", F.when(changed, F.col("_to")).otherwise(F.col("determination"))).drop("agrees", "_to")


def renumber(items: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items E<group>.<n> by their label's first use, and rejections that cite them under the new ids, others dropped."""
    from evispark.operators.extraction import number_items

    numbered = number_items(items.withColumnRenamed("evidence_id", "_old")).drop("group_no", "item_no")
    ids = numbered.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("_old", "evidence_id"))).alias("_ids"))
    cited = F.array_compact(F.transform("evidence_ids", lambda i: F.try_element_at(F.coalesce("_ids", F.create_map().cast("map<string,string>")), i)))
    return numbered.drop("_old"), rejected.join(ids, "case_id", "left").withColumn("evidence_ids", cited).drop("_ids")


def packages(cases: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, package, package_hash): one JSON object a case, its texts tidied and its kinds normalised. cases: case_id,
    domain, task_question, initial_context; items: case_id, pos, evidence_id, neutral_title, text, source_id, kind."""
    clean = lambda c: t.tidy(t.squash(t.strip_control(c)))
    item = F.struct("evidence_id", clean("neutral_title").alias("neutral_title"), clean("text").alias("text"), "source_id", t.normalise_kind("kind", "text").alias("kind"))
    listed = items.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))), lambda s: s["item"]).alias("evidence_items"))
    whole = cases.join(listed, "case_id").select("case_id", F.to_json(F.struct("case_id", "domain", "task_question", clean("initial_context").alias("initial_context"), "evidence_items", F.lit("1.0.0-auto").alias("version"))).alias("package"))
    return whole.withColumn("package_hash", canonical_digest("package"))


def visible_text(cases: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, visible): all that a model sees of a package."""
    listed = items.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("\n", "neutral_title", "text").alias("x")))), lambda s: s["x"]).alias("_x"))
    return cases.join(listed, "case_id", "left").select("case_id", F.concat_ws("\n", "initial_context", "task_question", F.array_join("_x", "\n")).alias("visible"))


def checks(visible: DataFrame, items: DataFrame, rejected: DataFrame, withheld: DataFrame, duplicates: DataFrame, coverage: DataFrame, names: DataFrame) -> DataFrame:
    """The thirteen checks of a package, one row a case. items: case_id, quote_verified, overlap; rejected as of
    `rejections`; withheld: case_id, values; duplicates: case_id, dropped; coverage: case_id, coverage, a row a block;
    names: case_id, name, place."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    by_item = items.groupBy("case_id").agg(F.count("*").alias("items"), count(~F.col("quote_verified")).alias("quote_unverified"), count(F.col("overlap") < LOW_OVERLAP).alias("low_overlap_items"))
    by_rejection = rejected.groupBy("case_id").agg(F.count("*").alias("counterevidence"), count(~F.col("verbatim")).alias("counterevidence_quote_unverified"), count(F.size("evidence_ids") == 0).alias("counterevidence_without_evidence_ids"))
    dropped = duplicates.groupBy("case_id").agg(count(F.col("dropped")).alias("near_duplicates_dropped"))
    covered = coverage.groupBy("case_id").agg(F.round(F.avg("coverage"), 3).alias("mean_coverage"))
    left = names.where(F.col("place") <= NAMES).groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("proper_nouns_remaining"))
    seen = visible.join(withheld, "case_id", "left").withColumn("_n", t.norm("visible"))
    values = F.coalesce("values", F.array().cast(NONE))
    normed = withheld.select("case_id", F.explode("values").alias("value")).withColumn("_v", t.norm("value"))
    shown = visible.withColumn("_n", t.norm("visible")).join(normed, "case_id").where(t.leaks(F.col("visible"), F.col("_n"), F.col("value"), F.col("_v")))
    shown = shown.groupBy("case_id").agg(F.sort_array(F.collect_set("value")).alias("withheld_still_present"))
    from evispark.operators.anonymise import residual_acronyms

    told = seen.select("case_id", t.conclusion_hits("visible").alias("conclusion_words_in_package"), residual_acronyms(F.col("visible"), values).alias("residual_withheld_tokens"), t.residual_identifiers("visible").alias("residual_identifiers"))
    out = by_item
    for other in (told, shown, left, dropped, by_rejection, covered):
        out = out.join(other, "case_id", "left")
    empty = [F.coalesce(c, F.array().cast(NONE)).alias(c) for c in ("withheld_still_present", "proper_nouns_remaining")]
    numbers = ["near_duplicates_dropped", "counterevidence", "counterevidence_quote_unverified", "counterevidence_without_evidence_ids"]
    same = [c for c in out.columns if c not in ("withheld_still_present", "proper_nouns_remaining")]
    return out.select(*same, *empty).fillna(0, numbers).fillna(0.0, ["mean_coverage"])


def regroup(items: DataFrame, most: int = RECORD_MOST) -> DataFrame:
    """items with new_id: the record E1 is the first `most` observations and measurements of the first item's source, or the
    first item if there is none; all others are grouped by source, by first use. items: case_id, pos, evidence_id,
    source_id, kind."""
    case = Window.partitionBy("case_id").orderBy("pos")
    whole = case.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = (F.col("source_id") == F.first("source_id").over(whole)) & F.col("kind").isin(*RECORD_KINDS)
    marked = items.withColumn("_w", F.coalesce(wanted, F.lit(False))).withColumn("_nth", F.sum(F.col("_w").cast("int")).over(case)).withColumn("_any", F.max(F.col("_w").cast("int")).over(Window.partitionBy("case_id"))).withColumn("_row", F.row_number().over(case))
    marked = marked.withColumn("_record", (F.col("_w") & (F.col("_nth") <= most)) | ((F.col("_any") == 0) & (F.col("_row") == 1)))
    first = F.min(F.when(~F.col("_record"), F.col("pos"))).over(Window.partitionBy("case_id", "source_id"))
    marked = marked.withColumn("_first", F.when(~F.col("_record"), first))
    group = F.when(F.col("_record"), 1).otherwise(F.dense_rank().over(Window.partitionBy("case_id", "_record").orderBy("_first")) + 1)
    marked = marked.withColumn("_group", group)
    place = F.row_number().over(Window.partitionBy("case_id", "_group").orderBy("pos"))
    return marked.withColumn("new_id", F.concat(F.lit("E"), F.col("_group"), F.lit("."), place)).drop("_w", "_nth", "_any", "_row", "_record", "_first", "_group")


def rewrite(references: DataFrame, regrouped: DataFrame, text: str = "text") -> DataFrame:
    """references with the ids in their text by a case's regrouping; others become `dropped:<id>`."""
    ids = regrouped.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", "new_id"))).alias("_ids"))
    return references.join(ids, "case_id", "left").withColumn(text, remap_text(F.col(text), F.coalesce("_ids", F.create_map().cast("map<string,string>")))).drop("_ids")


def regroup_report(regrouped: DataFrame, by: str) -> DataFrame:
    """By source of cases: packages, median record, requestable items least, median and most, cases with under ten."""
    each = regrouped.groupBy(by, "case_id").agg(F.sum(F.col("new_id").startswith("E1.").cast("int")).alias("_record"), F.count("*").alias("_n"))
    fetch = F.col("_n") - F.col("_record")
    return each.groupBy(by).agg(
        F.count("*").alias("packages"), F.percentile("_record", 0.5).cast("int").alias("record_median"), F.min(fetch).alias("requestable_min"), F.percentile(fetch, 0.5).cast("int").alias("requestable_median"),
        F.max(fetch).alias("requestable_max"), F.sum((fetch < 10).cast("bigint")).alias("under_10"),
    )


def case_brief(cases: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, brief): task, context, the record E1 in full and an index of all other items; an item without a kind shows
    the end of its locator. items: case_id, pos, evidence_id, neutral_title, kind, locator, source_id, text."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.element_at(F.split("locator", r" \| "), -1), F.lit(""))
    head = F.concat(F.lit("- "), F.concat_ws(" | ", "evidence_id", F.coalesce("neutral_title", F.lit("")), kind, F.concat(F.lit("source "), F.col("source_id"))))
    record = F.col("evidence_id").startswith("E1.")
    full = F.concat(head, F.lit("\n  "), F.coalesce("text", F.lit("")))
    lines = lambda c, x: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("pos", x.alias("x"))))), lambda s: s["x"])
    listed = items.groupBy("case_id").agg(lines(record, full).alias("_record"), lines(~record, head).alias("_index"))
    # The brief's headings and its last sentence.
    brief = F.concat(
        F.lit("# Case brief — "), F.col("case_id"), F.lit("\n\n## Task question\n"), F.col("task_question"), F.lit("\n\n## Initial context\n"), F.col("initial_context"),
        F.lit("\n\n## Case record E1 ("), F.size("_record").cast("string"), F.lit(" items, full text)\n"), F.array_join("_record", "\n"),
        F.lit("\n\n## Index of the remaining "), F.size("_index").cast("string"), F.lit(" evidence items (titles only)\n"), F.array_join("_index", "\n"),
        F.lit("\n\nFetch exact text with request_evidence when needed. Finish with a direct answer that separates the supported mechanism, discounted alternatives, and unresolved details."),
    )
    return cases.join(listed, "case_id").select("case_id", brief.alias("brief"))


def variants(cases: DataFrame, items: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packages and briefs of each (case_id, level) less its removed items. removed: case_id, level, evidence_id; a level
    whose only row has no id removes nothing."""
    levels = removed.select("case_id", "level").distinct()
    kept = items.join(levels, "case_id").join(removed.where("evidence_id IS NOT NULL"), ["case_id", "level", "evidence_id"], "left_anti")
    name = F.to_json(F.struct("case_id", "level"))
    split = lambda df: df.withColumn("_k", F.from_json("case_id", "case_id string, level string")).withColumn("level", F.col("_k.level")).withColumn("case_id", F.col("_k.case_id")).drop("_k")
    keyed = cases.join(levels, "case_id").withColumn("case_id", name).drop("level"), kept.withColumn("case_id", name).drop("level")
    plain = cases.join(levels, "case_id").join(listed_items(kept), ["case_id", "level"], "left")
    whole = plain.withColumn("package", F.to_json(F.struct("case_id", "domain", "task_question", "initial_context", "evidence_items", F.lit("1.0.0-auto").alias("version"))))
    return whole.select("case_id", "level", "package", canonical_digest("package").alias("package_hash")), split(case_brief(*keyed)).withColumn("brief", F.replace("brief", F.to_json(F.struct("case_id", "level")), F.col("case_id")))


def listed_items(items: DataFrame) -> DataFrame:
    """(case_id, level, evidence_items): the items of each variant, in order."""
    item = F.struct("evidence_id", "neutral_title", "text", "source_id", "kind")
    return items.groupBy("case_id", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))), lambda s: s["item"]).alias("evidence_items"))


def brief_changes(old: DataFrame, new: DataFrame, removed_items: DataFrame) -> DataFrame:
    """(case_id, level, line, change): lines of a variant's brief that its removals don't explain. old: case_id, brief; new:
    case_id, level, brief; removed_items: case_id, level, evidence_id, text. The two headings with counts may change, and
    removed items' own lines go, record texts among them; nothing may come."""
    header = r"^## (?:Case record E1 \(\d+ items|Index of the remaining \d+ evidence items)"
    lines = lambda df, *keys: df.select(*keys, F.explode(F.split("brief", "\n")).alias("line")).where(~F.col("line").rlike(header)).groupBy(*keys, "line").agg(F.count("*").alias("_n"))
    before, after = lines(old.join(new.select("case_id", "level"), "case_id"), "case_id", "level"), lines(new, "case_id", "level")
    both = before.withColumnRenamed("_n", "_old").join(after.withColumnRenamed("_n", "_new"), ["case_id", "level", "line"], "full").fillna(0, ["_old", "_new"]).where("_old <> _new")
    own = F.split(F.concat(F.lit("  "), F.coalesce("text", F.lit(""))), "\n")
    shown = F.when(F.col("evidence_id").startswith("E1."), own).otherwise(F.array().cast(NONE))
    gone = removed_items.groupBy("case_id", "level").agg(F.collect_set(F.concat(F.lit("- "), "evidence_id", F.lit(" |"))).alias("_heads"), F.flatten(F.collect_list(shown)).alias("_texts"))
    told = both.join(gone, ["case_id", "level"], "left")
    explained = (F.col("_new") < F.col("_old")) & (F.exists(F.coalesce("_heads", F.array().cast(NONE)), lambda h: F.col("line").startswith(h)) | F.array_contains(F.coalesce("_texts", F.array().cast(NONE)), F.col("line")))
    return told.where(~explained).select("case_id", "level", "line", F.when(F.col("_new") > F.col("_old"), "came").otherwise("went").alias("change"))
