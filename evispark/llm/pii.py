"""Personal data by weak supervision, in DataFrame expressions alone.

Base spans are the leftmost non-overlapping matches of four patterns, less those that fail their check. The method adds
spans of kind `secret`: candidates are long runs that mix letters and digits and lie outside base spans. Four labelers
vote on each one: a pattern, a gazetteer of names before it, its context and its mix of characters. Expectation-
maximisation estimates the labelers' reliabilities from the counts of vote patterns, at most 3 ** 4 rows whatever the
input; the posteriors are the labels on which a logistic classifier over span features is fitted, again from counts of
feature patterns, whose number is fixed by their buckets. The classifier, as an expression, decides on each candidate.

Positions count code points, ends exclusive. Null text is the empty text. Rows that repeat a doc_id, or have none, are
rows of their own; an empty table gives no rows and an undecided classifier, which accepts nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The four base patterns, written so that no text makes them backtrack or recurse: a run that fails is not tried again
#: from within, and what follows a repeated group never needs less of it. Matches are those of the plain forms.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be worth a search.
GUARDS = {"email": "@", "phone": "+"}
#: Leading zeros count for nothing; a part of zeros alone is 0.
BYTE = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
CANDIDATE = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{12,}+"
#: Code points before a candidate that labelers see.
CONTEXT = 24
#: Gazetteer of what names a secret.
NAMES = "password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|credential|auth|bearer"
ROUNDS = 40
SPANS = "array<struct<start:int,end:int,match:string>>"


def _matches(text: Column, pattern: str, guard: Column) -> Column:
    """Matches with what stands before each; the last has no match."""
    none = F.lit(None).cast("array<struct<found:string,before:string>>")
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("before"))
    return F.when(guard, found.cast("array<struct<found:string,before:string>>")).otherwise(none)


def _spans(pairs: Column) -> Column:
    """Positions of matches from the lengths of everything before them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("match")))
        return F.struct(end.alias("at"), F.when(x["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.coalesce(F.aggregate(pairs, start, step, lambda acc: acc["out"]), F.array().cast(SPANS))


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d.cast("int")) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return _digits(match).between(16, 19) & _luhn(match)
    if kind == "phone":
        return _digits(match).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _passes(kind, s["match"])


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def _placed(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def find_base(docs: DataFrame) -> DataFrame:
    """docs with the spans of each base kind and the candidates of the method, as columns named _pii_*."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumn("_pii_text", text).withColumn("_pii_digit", text.rlike("[0-9]"))
    for kind in KINDS:
        guard = F.col("_pii_text").contains(GUARDS[kind]) if kind in GUARDS else F.col("_pii_digit")
        if kind == "ip":
            guard = guard & F.col("_pii_text").rlike(r"[0-9]\.[0-9]")
        held = held.withColumn(f"_pii_pairs_{kind}", _matches(F.col("_pii_text"), PATTERNS[kind], guard))
    held = held.withColumn("_pii_pairs_secret", _matches(F.col("_pii_text"), CANDIDATE, F.col("_pii_digit")))
    for kind in (*KINDS, "secret"):
        held = held.withColumn(f"_pii_all_{kind}", _spans(F.col(f"_pii_pairs_{kind}"))).drop(f"_pii_pairs_{kind}")
    for kind in KINDS:
        held = held.withColumn(f"_pii_{kind}", F.filter(F.col(f"_pii_all_{kind}"), _check(kind))).drop(f"_pii_all_{kind}")
    base = F.concat(*[F.col(f"_pii_{k}") for k in KINDS])
    apart = F.filter(F.col("_pii_all_secret"), lambda s: ~F.exists(F.col("_pii_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return held.withColumn("_pii_base", base).withColumn("_pii_candidates", apart).drop("_pii_all_secret", "_pii_digit")


def _before(text: Column, span: Column) -> Column:
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return F.substring(text, begin + 1, span["start"] - begin)


def _votes(match: Column, before: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 abstains."""
    share = _digits(match) / F.length(match)
    return {
        "pattern": F.when(match.rlike("^(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,}|[0-9A-Z]{16,})$"), 1).when(F.length(match) < 14, -1).otherwise(0),
        "gazetteer": F.when(before.rlike(rf"(?i)(?:{NAMES})[^A-Za-z0-9]{{0,5}}$"), 1).otherwise(0),
        "context": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[/?&#.@-]$"), -1).otherwise(0),
        "mix": F.when(share.between(0.1, 0.9), 1).otherwise(-1),
    }


def _features(match: Column, before: Column) -> dict[str, Column]:
    return {
        "length": F.least(F.floor(F.log2(F.length(match))), F.lit(7)).cast("int"),
        "digits": F.floor(_digits(match) / F.length(match) * 4).cast("int"),
        "upper": match.rlike("[A-Z]").cast("int"),
        "lower": match.rlike("[a-z]").cast("int"),
        "hex": match.rlike("^[0-9a-f]+$").cast("int"),
        "named": before.rlike(rf"(?i)(?:{NAMES})[^A-Za-z0-9]{{0,5}}$").cast("int"),
        "joined": before.rlike(r"[=:/\"'-]\s*$").cast("int"),
    }


def reliabilities(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """By expectation-maximisation: the share of true spans, and for each labeler and vote its rates in both classes."""
    labelers = len(next(iter(patterns))) if patterns else 0
    prior = 0.5
    rates = [{1: (0.7, 0.2), 0: (0.2, 0.4), -1: (0.1, 0.4)} for _ in range(labelers)]
    total = sum(patterns.values())
    for _ in range(ROUNDS if total else 0):
        post = {p: posterior(p, prior, rates) for p in patterns}
        true = sum(n * post[p] for p, n in patterns.items())
        prior = min(max((true + 1) / (total + 2), 0.01), 0.99)
        rates = [
            {v: tuple((sum(n * (post[p] if c == 0 else 1 - post[p]) for p, n in patterns.items() if p[k] == v) + 0.5) / ((true if c == 0 else total - true) + 1.5) for c in (0, 1)) for v in (1, 0, -1)}
            for k in range(labelers)
        ]
    return prior, rates


def posterior(pattern: tuple[int, ...], prior: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    log_odds = math.log(prior / (1 - prior)) + sum(math.log(r[v][0] / r[v][1]) for r, v in zip(rates, pattern))
    return 1 / (1 + math.exp(-max(min(log_odds, 30), -30)))


def fit_classifier(rows: list[tuple[tuple, float, int]], rounds: int = 400, decay: float = 1e-3) -> dict[tuple[int, object], float]:
    """Logistic regression on one indicator for each feature value, from (values, mean posterior, count). Key (-1, 0): bias."""
    total = sum(n for _, _, n in rows)
    weights: dict[tuple[int, object], float] = {(-1, 0): 0.0}
    for values, _, _ in rows:
        weights |= {(k, v): 0.0 for k, v in enumerate(values)}
    for _ in range(rounds if total else 0):
        step = {k: -decay * w for k, w in weights.items()}
        for values, target, n in rows:
            keys = [(-1, 0), *enumerate(values)]
            miss = (target - 1 / (1 + math.exp(-sum(weights[k] for k in keys)))) * n / total
            for k in keys:
                step[k] += miss
        for k, s in step.items():
            weights[k] += 2.0 * s
    return weights


def learn(found: DataFrame) -> dict[tuple[int, object], float]:
    """The classifier's weights, from the candidates of the whole table. Only counts of patterns come to the driver."""
    each = found.select("_pii_text", F.explode("_pii_candidates").alias("span")).select(F.col("span.match").alias("match"), _before(F.col("_pii_text"), F.col("span")).alias("before"))
    votes, features = _votes(F.col("match"), F.col("before")), _features(F.col("match"), F.col("before"))
    named = each.select(*[v.alias(f"vote_{k}") for k, v in votes.items()], *[v.alias(f"feature_{k}") for k, v in features.items()])
    rows = named.groupBy(*named.columns).count().collect()  # at most 3 ** 4 votes by the buckets of seven features
    patterns: dict[tuple[int, ...], int] = {}
    for r in rows:
        p = tuple(r[f"vote_{k}"] for k in votes)
        patterns[p] = patterns.get(p, 0) + r["count"]
    prior, rates = reliabilities(patterns)
    data = [(tuple(r[f"feature_{k}"] for k in features), posterior(tuple(r[f"vote_{k}"] for k in votes), prior, rates), r["count"]) for r in rows]
    return fit_classifier(sorted(data))


def _accept(weights: dict[tuple[int, object], float], match: Column, before: Column) -> Column:
    if len(weights) == 1:
        return F.lit(False)
    score = F.lit(weights[(-1, 0)])
    for k, value in enumerate(_features(match, before).values()):
        choice = F.lit(0.0)
        for (at, v), w in weights.items():
            if at == k:
                choice = F.when(value == v, w).otherwise(choice)
        score = score + choice
    return score > 0


def find(docs: DataFrame) -> DataFrame:
    """docs with _pii_base kinds, _pii_secret and _pii_text; all of docs' own columns stay."""
    found = find_base(docs)
    weights = learn(find_base(docs.select("text")))
    accepted = F.filter(F.col("_pii_candidates"), lambda s: _accept(weights, s["match"], _before(F.col("_pii_text"), s)))
    return found.withColumn("_pii_secret", accepted).drop("_pii_candidates", "_pii_base")


def _digest(kinds: tuple[str, ...]) -> Column:
    parts = [F.transform(F.col(f"_pii_{k}"), _named(k)) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; the first of overlapping spans stands."""
    names = docs.columns
    found = find(docs)
    spans = F.concat(*[F.transform(F.col(f"_pii_{k}"), _placed(k)) for k in (*KINDS, "secret")])
    found = found.withColumn("_pii_spans", F.array_sort(spans))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("_pii_text"), acc["at"] + 1, s["start"] - acc["at"])
        taken = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(F.col("_pii_spans"), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("_pii_text"), acc["at"] + 1, F.length(F.col("_pii_text")))))
    return found.withColumn("_pii_done", F.when(F.size("_pii_spans") > 0, done).otherwise(F.col("text"))).select(*[F.col("_pii_done").alias("text") if c == "text" else F.col(f"`{c}`") for c in names])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(f"_pii_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_digest(KINDS), 256).alias("base_sha256"), _digest((*KINDS, "secret")).alias("spans"))
