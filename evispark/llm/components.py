"""Connected components of a link table, by alternating large-star and small-star rounds; nothing comes to the driver
but the sum of hashes that tells whether a round changed anything. Each round's table goes when the next one is written.

Links of a vertex to itself, links that are there twice and both directions of a link change nothing; links without u or
v are left out. An empty table gives no rows. A vertex that most links meet in is one row a task before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex hooks its neighbours (the larger ones, or the smaller ones and itself) to the smallest."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("low"))  # combined before the shuffle, so a hot vertex is a row a task
    low = low.select("u", F.least("u", "low").alias("low"))
    joined = both.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v), bigint. (u, root) for every vertex that isn't the smallest of its component."""
    edges = staged(links.where(F.col("u") != F.col("v")).distinct(), "links")
    state = None
    while True:
        before, edges = edges, staged(_star(_star(edges, True), False), "links")
        release(before)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now
