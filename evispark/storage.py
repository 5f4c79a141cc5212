"""The shared folder, staged tables and sizing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Texts that go to a Python worker at a time, at most.
TEXTS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local master gets a folder of its own, as in
    tests; on a cluster that is an error, as executors don't see each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = checkpoint.get() if checkpoint.isDefined() else None
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="evispark-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evispark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, so lost executors cost nothing before it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; others stay as they are."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path is not None:
            drop_staged(table.sparkSession, path)


def drop_staged(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), at_least)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python TEXTS at a time, so that a worker's memory doesn't grow with the rows of a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS:
        spark.conf.set(name, TEXTS)
