"""Documents to packed training sequences: toxic, repeated and contaminated documents go, personal data is replaced.

Each stage keeps all columns of its documents, extra ones too, but the last, which returns pieces. Null texts are empty
texts: they are scored by the machine's bias, are near duplicates of nothing, hold no test item and no personal data, and
are packed as the end id alone. Rows without doc_id come before all others where the smallest doc_id decides; rows that
repeat a doc_id with another text are documents of their own, and of wholly equal rows one stays. Without labels nothing
is rejected as toxic, without test items nothing as contaminated. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import decontaminate, jaccard_join, packing, pii, toxicity
from evispark.llm.common import release, staged
from evispark.llm.tokens import default_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a machine fitted on the labelled ones among them doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of smallest doc_id."""
    return jaccard_join.keep_one_each(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no test item, copied or edited."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with spans of personal data replaced by their kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", reject_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Its models and its tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return docs
