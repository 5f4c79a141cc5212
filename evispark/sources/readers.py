"""Scans: one function for each kind of source. Every one keeps malformed input visible instead of dropping it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str) -> Callable:
    """Make a scan known by name, as the registry of adapters."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = f
        return f

    return add


def read_source(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    return SOURCES[name](spark, *args, **options)


@register_source("table")
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the driver's layout."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register_source("jsonl")
def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzip by extension; blank lines are skipped and a malformed line fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


@register_source("jsonl_needed")
def jsonl_needed(spark: SparkSession, path: str, schema: StructType | str, needed: DataFrame, key: str = "case_id") -> DataFrame:
    """Only the needed keys; a key that the scan doesn't hold is an error, raised when the rows are read."""
    rows = jsonl(spark, path, schema)
    wanted = needed.select(key).distinct()
    joined = wanted.withColumn("_wanted", F.lit(True)).join(rows.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return joined.where(checked).select(*rows.columns)


@register_source("json_files")
def json_files(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """One JSON object a file; files of failed runs are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    return rows.withColumn("file", F.col("_metadata.file_path")).where(~F.col("file").endswith(".failed.json"))


@register_source("text_tree")
def text_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, file, text): one folder for each id; a file's kind is its name up to the first underscore or dot."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("id"),
        F.regexp_extract(path, r"/([^/_.]+)[^/]*$", 1).alias("kind"),
        path.alias("file"),
        F.col("value").alias("text"),
    )


def index_with_texts(index: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Index rows with the text of the same id; rows without a text go."""
    return index.join(texts.select(key, "text"), key)


def manifest_or_listing(manifest: DataFrame | None, listing: DataFrame, key: str = "id") -> DataFrame:
    """The manifest less interim rows and rows without a file; without a manifest, the listing."""
    if manifest is None:
        return listing
    return manifest.where(~F.coalesce(F.col("interim"), F.lit(False))).join(listing.select(key), key, "left_semi")


@register_source("id_list")
def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; an id that comes twice is an error, raised when the rows are read."""
    counted = spark.read.text(path).where(F.trim("value") != "").groupBy(F.trim("value").alias("id")).count()
    twice = F.when(F.col("count") > 1, F.raise_error(F.concat(F.lit("duplicate id: "), F.col("id")))).otherwise(F.lit(True))
    return counted.where(twice).select("id")


@register_source("json_log")
def json_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log that are JSON, as `event`."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("event")).where(F.col("event").isNotNull())


@register_source("metric_text")
def metric_text(spark: SparkSession, path: str, counter: str) -> DataFrame:
    """The sum of one counter over all label sets of a metrics page."""
    line = F.col("value")
    mine = spark.read.text(path).where(line.startswith(counter) & ~line.startswith("#"))
    return mine.select(F.coalesce(F.sum(F.element_at(F.split(F.trim(line), r"\s+"), -1).cast("double")), F.lit(0.0)).alias("total"))


# The adapters of report sources, and what their case ids start with.
ADAPTERS = {"ntsb": "ANTSB", "boards": "ABRD", "nhtsa": "ANHTSA", "medical": "AMED", "ntsb_pipeline": "ANTP", "ntsb_highway": "ANTH", "tsb_pipeline": "ATSP"}


def adapter_of(case_id: Column) -> Column:
    """The adapter whose prefix a case id has; null for none."""
    out = F.lit(None).cast("string")
    for name, prefix in ADAPTERS.items():
        out = F.when(case_id.startswith(f"{prefix}-"), name).otherwise(out)
    return out


@register_source("key_values")
def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of `key=value` lines; blank lines, comments and keys without a value are left out, the first of a key
    counts. Such files hold settings, a few lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("_at", "line"))
    cut = F.split("line", "=", 2)
    rows = lines.where(F.col("line").contains("=") & ~F.ltrim("line").startswith("#")).select(F.trim(cut[0]).alias("key"), F.trim(cut[1]).alias("value"), "_at").where("value <> ''")
    return rows.groupBy("key").agg(F.min_by("value", "_at").alias("value"))


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"text": lambda content: content.decode("utf-8", "replace")}


def register_extractor(name: str, extract: Callable[[bytes], str]) -> None:
    """Make a tool known that turns a document's bytes, such as a PDF's, into text."""
    EXTRACTORS[name] = extract


@register_source("documents_with_cache")
def documents_with_cache(spark: SparkSession, glob: str, cache: str, extractor: str = "text") -> DataFrame:
    """(id, text) of document files; what was extracted before is read from the cache, what is new is added to it. A
    document that can't be extracted has null text and isn't kept, so that it is tried again."""
    from evispark.storage import staged

    extract = EXTRACTORS[extractor]

    @F.pandas_udf("string")
    def text_of(contents: pd.Series) -> pd.Series:
        def one(content: bytes) -> str | None:
            try:
                return extract(bytes(content))
            except Exception:  # whatever an outside tool throws at one document must not end the scan
                return None

        return contents.map(one)

    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = "id string, text string"
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "content")
    new = staged(files.join(known.select("id"), "id", "left_anti").select("id", text_of("content").alias("text")), "extracted")
    new.where("text IS NOT NULL").write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache).join(files.select("id"), "id", "left_semi").unionByName(new.where("text IS NULL"))


def refuse_test_data(path: str, forbidden: tuple[str, ...] = ("test", "heldout", "held_out")) -> str:
    """The path, unless one of its parts starts as test data's do."""
    if any(part.lower().startswith(forbidden) for part in path.replace("\\", "/").split("/") if part):
        raise PermissionError(f"test data must not be read here: {path}")
    return path


def parsed(column: str) -> Column:
    """JSON text as VARIANT; null where it isn't JSON."""
    return F.try_parse_json(F.col(column))
