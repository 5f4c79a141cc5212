"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is reduced to one signed row for each group and written below its batch id; totals are the sums of
all committed batches. A batch id that is committed is never written again, so a batch that is delivered twice, or
retried after a lost driver, counts once; a half-written batch has no commit marker and is written anew. `compact`
folds committed batches into one that remembers their ids.

Changes are rows (kind, source, lang, version, n_tokens, old_n_tokens) with kind `insert`, `delete` or `revise`; null
counts are 0, and null source or lang is a group of its own. Other kinds are an error. Groups without documents and
tokens left aren't in the totals. Null and empty texts have no tokens; repeated rows count each. An empty batch commits
and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_staged, fresh_path, staged
from .tokens import default_path, encoder

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint, folded array<string>"


def changes(rows: DataFrame, kind: str, version: str | None = None, n_tokens: str = "n_tokens", old: str | None = None) -> DataFrame:
    """rows as changes of one kind; their tokenizer version is that given, or their own."""
    named = F.col("version") if version is None else F.lit(version)
    return rows.select(F.lit(kind).alias("kind"), "source", "lang", named.alias("version"), F.col(n_tokens).cast("bigint").alias("n_tokens"), (F.col(old) if old else F.lit(None)).cast("bigint").alias("old_n_tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batch(self, batch_id: str) -> str:
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id is letters, digits, - and _: {batch_id!r}")
        return f"{self.path}/{batch_id}"

    def _folders(self) -> list[str]:
        if not self._fs.exists(self._jpath(self.path)):
            return []
        found = (str(s.getPath().getName()) for s in self._fs.listStatus(self._jpath(self.path)))
        return sorted(x for x in found if self._fs.exists(self._jpath(f"{self.path}/{x}/_SUCCESS")))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{x}" for x in folders])

    def committed(self) -> set[str]:
        folders = self._folders()
        folded = self._read([x for x in folders if x.startswith("compact-")]).select(F.explode("folded").alias("id")).distinct().collect()
        return {x for x in folders if not x.startswith("compact-")} | {r.id for r in folded}

    def _live(self) -> list[str]:
        """Folders that count: those that no compaction has folded."""
        folders = self._folders()
        folded = {r.id for r in self._read([x for x in folders if x.startswith("compact-")]).select(F.explode("folded").alias("id")).distinct().collect()}
        return [x for x in folders if x not in folded]

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Whether the batch was new. Hot groups are summed before the shuffle."""
        path = self._batch(batch_id)
        if batch_id in self.committed():
            return False
        kind, new, old = F.col("kind"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0))
        unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
        tokens = F.when(kind == "insert", new).when(kind == "delete", -new).when(kind == "revise", new - old)
        deltas = batch.groupBy("source", "lang", F.col("version").alias("tokenizer_version")).agg(F.sum(docs).cast("bigint").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens"))
        deltas.withColumn("folded", F.lit(None).cast("array<string>")).coalesce(1).write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        sums = self._read(self._live()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """One folder for all committed ones. It takes their place at the moment its marker is written."""
        live = self._live()
        if len(live) < 2:
            return
        ids = sorted(self.committed() | {x for x in live if x.startswith("compact-")})
        name = f"compact-{len(ids)}-{max(live)}"
        marker = self.spark.createDataFrame([(None, None, None, 0, 0, ids)], DELTA)
        self.totals().withColumn("folded", F.lit(None).cast("array<string>")).unionByName(marker).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")
        for x in live:
            drop_staged(self.spark, f"{self.path}/{x}")


def count_by_versions(docs: DataFrame, tokenizers: dict[str, str], end_ids: int = 0) -> DataFrame:
    """doc_id, source, lang, version and the tokens of every whole text by each tokenizer, from one reading of the texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = {version: encoder(path) for version, path in tokenizers.items()}
        for batch in batches:
            for version, coder in coders.items():
                yield batch[["doc_id", "source", "lang"]].assign(version=version, n_tokens=[len(coder.encode(t)) + end_ids for t in batch.text]).astype({"doc_id": "Int64"})

    return documents(docs, "doc_id", "source", "lang", "text").mapInPandas(count, "doc_id bigint, source string, lang string, version string, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, counted by two tokenizer versions, and that batch comes again. Then every count is
    revised to hold an end id, documents without tokens of their own are deleted, and the batches are compacted. Batches
    that were folded come once more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = {v: default_path(f"{v}.json") for v in ("byte_bpe_50k", "word_bpe_49k")}
    counted = staged(count_by_versions(docs, versions), "token-counts")
    revised = counted.withColumn("revised", F.col("n_tokens") + 1)
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    batches = {
        "insert-0": changes(counted, "insert"),
        "revise-0": changes(revised, "revise", n_tokens="revised", old="n_tokens"),
        "delete-0": changes(revised.where("n_tokens = 0"), "delete", n_tokens="revised"),
    }
    for batch_id in ("insert-0", "insert-0", "revise-0", "delete-0"):
        rollup.commit(batch_id, batches[batch_id])
    rollup.compact()
    for batch_id, batch in batches.items():
        rollup.commit(batch_id, batch)
    return rollup.totals()
