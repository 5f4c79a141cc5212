"""Sinks. Writers commit as a whole: readers see all of a write or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, gzip: bool = False, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "gzip" if gzip else "none")
    (writer.partitionBy(by) if by else writer).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a step has still to do: rows whose key and input it hasn't finished. Failed results aren't reused."""
    return rows.join(done.where("status = 'ok'").select(*keys), keys, "left_anti")


def write_splits(df: DataFrame, path: str, raw: str = "raw", split: str = "split") -> None:
    """The original lines, a folder for each split."""
    df.select(F.col(raw).alias("value"), split).write.mode("overwrite").partitionBy(split).text(path)


def markdown_report(items: DataFrame, case: str = "case_id", position: str = "pos") -> DataFrame:
    """(case, report): a heading for each case and a section for each item, in order."""
    section = F.concat(F.lit("### "), F.col("evidence_id"), F.lit(" "), F.col("neutral_title"), F.lit("\n\n"), F.col("text"))
    listed = items.groupBy(case).agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), section.alias("section")))).alias("sections"))
    body = F.array_join(F.transform("sections", lambda s: s["section"]), "\n\n")
    return listed.select(case, F.concat(F.lit("## "), F.col(case), F.lit("\n\n"), body).alias("report"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins; values outside count in none."""
    return df.select(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).where(F.col("bin").between(1, bins)).groupBy("bin").agg(F.count("*").alias("n"))


def long_metrics(df: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """(step, path, value) of wide metrics; values that aren't finite go."""
    pairs = ", ".join(f"'{m}', cast(`{m}` AS double)" for m in metrics)
    return df.selectExpr(step, f"stack({len(metrics)}, {pairs}) AS (path, value)").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def sampled_dump(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows chosen by a seeded hash, the same at every run."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def expired(versions: DataFrame, keep: int, live: Column, pinned: Column) -> DataFrame:
    """Versions to delete: older than the newest `keep`, neither live nor pinned."""
    newest = versions.agg(F.max("version").alias("newest"))
    return versions.join(F.broadcast(newest)).where((F.col("version") <= F.col("newest") - keep) & ~live & ~pinned).drop("newest")  # one row


def manifest(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows and distinct keys there are, and the sum of the rows' hashes."""
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), digest.alias("digest"))


def with_views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
