"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.storage import drop_staged, fresh_path, partitions, release, shared_dir, small_batches, staged

__all__ = ["crc_bucket", "documents", "drop_staged", "fresh_path", "partitions", "release", "shared_dir", "small_batches", "staged"]


def crc_bucket(column: str, modulus: int):
    """crc32 of a key as text, by its remainder; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def documents(df: DataFrame, *keep: str) -> DataFrame:
    """Only the columns an operator reads: extra columns, whatever their names, never reach a join."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in keep])
