"""Raw report texts to labelled blocks, and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions.text import page_furniture, paragraphs, squash

# The forms of a heading line, in the order in which they are tried.
HEADINGS = (
    r"^\s{0,12}((?:\d+|[A-Z])(?:\.\d+){0,3})\.?\s+([A-Z]\w[^\n]{2,80})$",
    r"^\s{0,20}([A-Z][A-Z0-9 &/,'()\-.]{7,70})$",
    r"^\s{0,20}((?:[A-Z][a-z'\-]+)(?: (?:of|the|and|for|to|in|on|a)| [A-Z][a-z'\-]+){1,7})$",
)
NUMBERED = r"^\s*\d+(?:\.\d+)*\.?\s"


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line)."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def heading(line: Column) -> Column:
    """The heading that a line is, or null: furniture, short lines and ends of sentences are none."""
    bare, right = F.trim(line), F.regexp_replace(line, r"\s+$", "")
    numbered = F.concat_ws(" ", F.regexp_extract(right, HEADINGS[0], 1), F.regexp_extract(right, HEADINGS[0], 2))
    found = F.when(right.rlike(HEADINGS[0]), numbered)
    for pattern in HEADINGS[1:]:
        found = found.when(right.rlike(pattern), F.regexp_extract(right, pattern, 1))
    out = squash(found)
    sentence = bare.rlike(r"[.;,]$") & ~line.rlike(NUMBERED)
    good = ~page_furniture(line) & (F.length(bare) >= 4) & ~sentence & F.length(out).between(4, 90) & ~out.rlike(r"^\p{Ll}")
    return F.when(good, out)


def blocks(docs: DataFrame, key: str, text: str = "text", least: int = 200, most: int = 9000) -> DataFrame:
    """(key, block_idx, label, text): what stands under each heading; a short body belongs to the block before it, and
    a long one is cut at blank lines. What stands before the first heading is `(front)`, a text without headings `body`."""
    each = lines(docs, key, text).withColumn("_h", heading(F.col("line")))
    section = F.sum(F.col("_h").isNotNull().cast("int")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("_s", section)
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("_h").isNull(), F.struct("line_no", "line")))), lambda s: s["line"])
    parts = each.groupBy(key, "_s").agg(F.max("_h").alias("_h"), F.trim(F.array_join(ordered, "\n"), F.lit("\n ")).alias("_body"))
    listed = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_s", "_h", "_body"))).alias("_parts"))
    none = F.array().cast("array<struct<label:string,text:string>>")

    def fold(acc: Column, p: Column) -> Column:
        label = F.coalesce(p["_h"], F.when(F.size("_parts") == 1, F.lit("body")).otherwise(F.lit("(front)")))
        one = F.array(F.struct(label.alias("label"), p["_body"].alias("text")))
        last = F.element_at(acc, -1)
        longer = F.struct(last["label"].alias("label"), F.concat(last["text"], F.lit("\n\n"), label, F.lit("\n"), p["_body"]).alias("text"))
        short = F.length(p["_body"]) < least
        return (
            F.when(~short | (F.size("_parts") == 1), F.concat(acc, one))
            .when((p["_s"] == 0) | ((F.size(acc) == 0) & (p["_body"] == "")), acc)
            .when(F.size(acc) == 0, F.concat(acc, one))
            .otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))
        )

    folded = listed.select(key, F.posexplode(F.aggregate("_parts", none, fold)).alias("_b", "_block"))
    cut = folded.select(key, "_b", F.col("_block.label").alias("label"), F.posexplode(chunks(F.col("_block.text"), most)).alias("_part", "text"))
    label = F.when(F.col("_part") == 0, F.col("label")).otherwise(F.concat(F.col("label"), F.lit(" (continued "), F.col("_part") + 1, F.lit(")")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_b", "_part")) - 1
    return cut.select(key, number.alias("block_idx"), label.alias("label"), "text")


def chunks(text: Column, most: int) -> Column:
    """Parts of a text, cut at blank lines where the next paragraph would make a part too long."""
    none = F.array().cast("array<string>")

    def fold(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.length(last) + F.length(p) + 2 <= most
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit("\n\n"), p)))
        return F.when(F.size(acc) == 0, F.array(p)).when(fits, joined).otherwise(F.concat(acc, F.array(p)))

    cut = F.aggregate(F.split(text, r"\n\s*\n"), none, fold)
    kept = F.filter(F.transform(cut, lambda c: F.trim(c, F.lit("\n "))), lambda c: c != "")
    return F.when(F.length(text) <= most, F.filter(F.array(text), lambda c: F.trim(c) != "")).otherwise(kept)


def named_sections(docs: DataFrame, key: str, names: list[str], text: str = "text") -> DataFrame:
    """(key, pos, label, text): a text cut at fixed headings; what stands before the first is `Narrative`."""
    pattern = "(?:" + "|".join(names) + ")"
    heads = F.concat(F.array(F.lit("Narrative")), F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda h: F.initcap(squash(h))))
    bodies = F.transform(F.split(F.col(text), pattern, -1), lambda b: F.trim(b, F.lit("\n ")))
    zipped = docs.select(key, F.posexplode(F.arrays_zip(heads.alias("label"), bodies.alias("text"))).alias("pos", "_z"))
    return zipped.select(key, "pos", "_z.label", "_z.text").where("text <> ''")


def header_fields(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, field, value) of `Name: value` lines; the first of each name counts."""
    found = lines(docs, key, text).withColumn("field", squash(F.regexp_extract("line", r"^\s*([A-Z][A-Za-z ]{1,30}):", 1))).withColumn("value", squash(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)))
    w = Window.partitionBy(key, "field").orderBy("line_no")
    return found.where("field <> '' AND value <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "field", "value")


def summary_paragraphs(text: Column) -> Column:
    return paragraphs(text, 80)


def both_kinds(files: DataFrame, key: str, kind: str, needed: list[str]) -> DataFrame:
    """Keys that have a file of every needed kind."""
    return files.where(F.col(kind).isin(needed)).groupBy(key).agg(F.countDistinct(kind).alias("_n")).where(F.col("_n") == len(set(needed))).select(key)


def answer_share(prompt: Column, answer: Column) -> Column:
    """Share of an answer's longer words that its prompt gives away; 1 if it has none."""
    said = F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit("[a-z]{5,}"), F.lit(0)))
    return F.when(F.size(said) == 0, 1.0).otherwise(F.size(F.filter(said, lambda w: F.lower(prompt).contains(w))) / F.size(said))
