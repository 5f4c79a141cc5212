"""Aligned token arrays as column expressions: masks, padding, targets, log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the label of a token that takes no part in the loss.
IGNORED = -100


def loss_mask(labels: Column) -> Column:
    return F.transform(labels, lambda x: (x != IGNORED).cast("int"))


def within_mask(mask: Column, other: Column) -> Column:
    """Whether each place that a mask marks is marked by the other one too, which may be longer or shorter."""
    marked = F.transform(mask, lambda m, i: (m == 0) | (F.coalesce(F.get(other, i), F.lit(0)) == 1))
    return F.forall(marked, lambda m: m)


def only_in_first(mask: Column, other: Column) -> Column:
    """How many places a mask marks that the other one doesn't."""
    return F.size(F.filter(F.transform(mask, lambda m, i: (m == 1) & (F.coalesce(F.get(other, i), F.lit(0)) == 0)), lambda m: m))


def starts_with(array: Column, prefix: Column) -> Column:
    return F.slice(array, 1, F.size(prefix)) == prefix


def aligned(n: Column, *payloads: Column) -> Column:
    """The first of several payloads that is there, if it has a value for each of n tokens; else null."""
    first = F.coalesce(*payloads)
    return F.when(F.size(first) == n, first)


def padded(array: Column, fill: Column, bucket: int) -> Column:
    """Filled up at its end to a multiple of the bucket size; a bucket of 0 leaves it as it is."""
    return array if not bucket else F.concat(array, F.array_repeat(fill, F.pmod(-F.size(array), F.lit(bucket))))


def target_positions(labels: Column) -> Column:
    """Places, from 0, whose next label takes part in the loss."""
    places = F.when(F.size(labels) > 1, F.sequence(F.lit(0), F.size(labels) - 2)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.get(labels, i + 1) != IGNORED)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids, written out with commas between them."""
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)
