"""Numbers, quantiles, hashes and ids as column expressions."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def rescale(value: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear, clamped to the target range."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return to_low + (inside - low) / (high - low) * (to_high - to_low)


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def round_half_even(value: Column, digits: int = 3) -> Column:
    return F.bround(value, digits)


def lower_rank(values: Column, p: float) -> Column:
    """The value at place floor(p * (n - 1)) of the sorted values."""
    return F.element_at(F.sort_array(values), (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def seeded(seed: int | str, *keys: Column) -> Column:
    """A hash by which a seed orders rows."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), *[k.cast("string") for k in keys]), 256)


def unit_interval(digest: Column) -> Column:
    """A hex digest as a number from 0 to below 1."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def route(key: Column, n: int) -> Column:
    """One of n routes, the same for a key at every run; n is a power of two of sixteen bits at most."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 61, 4), 16, 10).cast("int"), F.lit(n))


def group_id(category: Column, native: Column) -> Column:
    """A category and twenty hex digits that stand for the native key."""
    return F.concat(category, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", category, native), 256), 1, 20))


def turn_seed(base: Column, case: Column, turn: Column) -> Column:
    """The first four bytes of the digest of base:case:turn."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", base.cast("string"), case, turn.cast("string")), 256), 1, 8), 16, 10).cast("bigint")


def learning_rate(step: Column, peak: float, warm: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to a share of the peak."""
    after = (step - warm) / max(1, total - warm)
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * after))))


def clipped_loss(new: Column, old: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> Column:
    """By token, from aligned arrays of log-probabilities: the clipped policy loss."""
    def loss(n: Column, o: Column) -> Column:
        ratio = F.exp(n - o)
        return -F.least(ratio * advantage, F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio)) * advantage)

    return F.zip_with(new, old, loss)


def k3_divergence(new: Column, reference: Column) -> Column:
    return F.zip_with(new, reference, lambda n, r: F.exp(r - n) - (r - n) - 1)


@F.pandas_udf(StringType())
def canonical_digest(packages: pd.Series) -> pd.Series:
    """SHA-256 of a package's JSON with sorted keys, nulls kept and package_hash left out; null for no JSON object."""
    def digest(text: str | None) -> str | None:
        try:
            package = json.loads(text, parse_constant=lambda name: float("nope"))
        except (TypeError, ValueError):
            return None
        if not isinstance(package, dict):
            return None
        package.pop("package_hash", None)
        return hashlib.sha256(json.dumps(package, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    return packages.map(digest)


def _close(text: str) -> str:
    """Brackets and strings that a cut-off text left open, closed."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
    return text + '"' * quoted + "".join(reversed(stack))


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("repaired", BooleanType())]))
def tolerant_json(texts: pd.Series) -> pd.DataFrame:
    """JSON out of a model's reply: fences cut off, trailing commas dropped, a cut-off end closed. Null where it fails."""
    import re

    def parse(text: str | None) -> tuple[str | None, bool | None]:
        if text is None:
            return None, None
        tries = [text]
        inner = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text)
        begin = min((i for i in (inner.find("{"), inner.find("[")) if i >= 0), default=-1)
        if begin >= 0:
            body = inner[begin:]
            end = max(body.rfind("}"), body.rfind("]"))
            for candidate in (body[: end + 1] if end >= 0 else body, body):
                tries += [candidate, re.sub(r"[,;]\s*(?=[}\]])", "", candidate), re.sub(r"[,;]\s*(?=[}\]])", "", _close(candidate.rstrip().rstrip(",;")))]
        for k, candidate in enumerate(tries):
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False), k > 0
            except ValueError:
                continue
        return None, None

    return pd.DataFrame([parse(t) for t in texts], columns=["json", "repaired"])
