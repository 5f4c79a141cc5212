"""Rewards as column expressions over per-sample values; decisions are `closed`, `not_closed` or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.numeric import rescale
from evispark.functions.text import ledger, status_rank

# Weights of a request's and of a conclusion's parts in the second reward.
REQUEST = {"K1": 0.3, "K2": 0.2, "F1": 0.2, "F2": 0.2, "F3": 0.1}
CONCLUSION = {"C1": 0.35, "C2": 0.25, "C3": 0.20, "C4": 0.20}
# Weights of the later reward.
WEIGHTS = {
    "gate_wrong": 0.3, "kcov": 0.5, "C1a": 0.2, "C1b": 0.2, "C1b_partial_credit": 0.5, "C2": 0.2, "C3": 0.2, "C4": 0.2,
    "G1": 0.3, "G2": 0.4, "G3": 0.3, "G1no_G3": 0.5, "H2": 0.4, "H3_not": 0.3, "H4_not": 0.15, "H5": 0.15, "H1no_H4_not": 0.7, "H1no_H5": 0.3,
}


def weights(**changes: float) -> dict[str, float]:
    """The weights with changes; an unknown name is an error."""
    if unknown := set(changes) - set(WEIGHTS):
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    return WEIGHTS | changes


def capped(step: float, count: Column, free: int, cap: float) -> Column:
    """step for each one beyond the free ones, not below the cap."""
    return F.greatest(F.lit(cap), step * F.greatest(F.lit(0), count - free))


def structure_penalty(marker: Column, final: Column, cited: Column, cited_all_seen: Column, turns: Column, rerequested: Column, invalid: Column) -> Column:
    missing = F.when(marker.isNull(), -2.0).otherwise(0.0)
    citation = F.when(marker.isNull() | final.isNull(), 0.0).when(F.size(cited) == 0, -0.25).when(~cited_all_seen, -0.5).otherwise(0.0)
    return missing + citation + capped(-0.1, turns, 6, -1.0) + capped(-0.1, rerequested, 10, -1.0) + F.greatest(F.lit(-1.0), -0.2 * invalid)


def key_hit(requests: DataFrame, keys: list[str], fresh: str, ids: str, key_ids: str) -> DataFrame:
    """Mean of two parts: how well each request hits key items, and all of them together; 0 without keys or ids."""
    hits = F.size(F.array_intersect(fresh, key_ids))
    each = F.when(F.size(ids) > 0, F.least(F.lit(1.0), 3.0 * hits / F.size(ids)))
    flat = F.array_distinct(F.flatten(F.collect_list(ids)))
    known = F.first(F.col(key_ids))
    whole = F.least(F.lit(1.0), 3.0 * F.size(F.array_intersect(flat, known)) / F.greatest(F.size(flat), F.lit(1)))
    value = F.when((F.size(known) == 0) | (F.size(flat) == 0), 0.0).otherwise((F.coalesce(F.avg(each), F.lit(0.0)) + whole) / 2)
    return requests.groupBy(*keys).agg(value.alias("key_hit"))


def decision_reward(decision: Column, label: Column) -> Column:
    return F.when(decision.isNotNull() & (decision == label), 1.0).otherwise(-1.0)


def gate(d: Column, wrong: float = WEIGHTS["gate_wrong"]) -> Column:
    return F.when(d > 0, 1.0).otherwise(wrong)


def first_total(decision: Column, label: Column, conclusion: Column, gap: Column, fetch_scores: Column, hypothesis_scores: Column, hits: Column, structure: Column, phase: int = 2, weights: dict[str, float] | None = None) -> Column:
    """The first reward: scores of 0 to 10 scaled, a closure bonus, key hits and the structure penalty, each dimension by
    its weight (1 if none is given). Phase 1 keeps only the program's parts."""
    if unknown := set(weights or {}) - {"fetch", "hypothesis", "closure", "structure"}:
        raise ValueError(f"unknown dimensions: {sorted(unknown)}")
    w = {"fetch": 1.0, "hypothesis": 1.0, "closure": 1.0, "structure": 1.0} | (weights or {})
    mean = lambda a, lo, hi: F.when(F.size(a) > 0, F.aggregate(F.transform(a, lambda x: rescale(x.cast("double"), 0, 10, lo, hi)), F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)
    total = F.aggregate(F.transform(hypothesis_scores, lambda x: rescale(x.cast("double"), 0, 10, -0.5, 0.5)), F.lit(0.0), lambda s, x: s + x)
    closed = F.when(decision.isNull(), 0.0).when(decision == label, 0.5).otherwise(-0.5)
    judged = F.when(decision == "closed", rescale(conclusion, 0, 10, -1, 1)).when(decision == "not_closed", rescale(conclusion, 0, 10, -0.5, 0.5) + rescale(gap, 0, 10, -0.5, 0.5)).otherwise(0.0)
    if phase < 2:
        return w["fetch"] * hits + w["closure"] * closed + w["structure"] * structure
    fetch, hypothesis = mean(fetch_scores, 0.0, 0.5) + hits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))
    return w["fetch"] * fetch + w["hypothesis"] * hypothesis + w["closure"] * (closed + judged) + w["structure"] * structure


def fetch_program(folded: DataFrame, keys: list[str], ids: str, key_ids: str, order: str = "turn") -> DataFrame:
    """A row for each valid request: how many ids it names, how many are new, new key items, whether there are any (K1),
    their share of the ids (K2), and key items unread before it. folded: with seen_before and fresh."""
    hits = F.size(F.array_intersect("fresh", key_ids))
    new = F.size(F.filter(ids, lambda i: ~F.array_contains("seen_before", i)))
    share = F.when(F.size(ids) > 0, hits / F.size(ids)).otherwise(0.0)
    return folded.select(*keys, order, F.size(ids).alias("n_ids"), new.alias("n_new"), hits.alias("key_new"), (hits > 0).cast("double").alias("K1"), share.alias("K2"), F.sort_array(F.array_except(key_ids, "seen_before")).alias("unread_key_before"))


def request_score(k1: Column, k2: Column, f1: Column, f2: Column, f3: Column) -> Column:
    """One request: the program's parts, and the judge's if it answered; F2 and F3 are faults."""
    program = REQUEST["K1"] * k1 + REQUEST["K2"] * k2
    yes = lambda c: F.when(c == "yes", 1.0).otherwise(0.0)
    judged = REQUEST["F1"] * yes(f1) + REQUEST["F2"] * (1 - yes(f2)) + REQUEST["F3"] * (1 - yes(f3))
    return program + F.when(f1.isNull(), 0.0).otherwise(judged)


def conclusion_quality(c1: Column, c2: Column, c3: Column, c4: Column) -> Column:
    """From yes and no, the first also partial; 0.5 if unjudged."""
    yes = lambda c: F.when(c == "yes", 1.0).otherwise(0.0)
    return F.when(c1.isNull(), 0.5).otherwise(CONCLUSION["C1"] * F.when(c1 == "yes", 1.0).when(c1 == "partial", 0.5).otherwise(0.0) + CONCLUSION["C2"] * yes(c2) + CONCLUSION["C3"] * yes(c3) + CONCLUSION["C4"] * yes(c4))


def gap_quality(g1: Column, g2: Column, g3: Column) -> Column:
    yes = lambda c: F.when(c == "yes", 1.0).otherwise(0.0)
    return F.when(g1.isNull(), 0.5).otherwise(0.3 * yes(g1) + 0.4 * yes(g2) + 0.3 * yes(g3))


def outcome(decision: Column, d: Column, q_conclusion: Column, q_gap: Column) -> Column:
    return F.when(decision.isNull(), d).when(decision == "closed", d + 2 * q_conclusion - 1).otherwise(d + 0.5 * (2 * q_conclusion - 1) + 0.5 * (2 * q_gap - 1))


def update_score(h1: Column, h2: Column, h3: Column, h4: Column, h5: Column, w: dict[str, float] = WEIGHTS) -> Column:
    """One hypothesis update, from booleans."""
    n = lambda c: c.cast("double")
    return F.when(h1, w["H2"] * n(h2) + w["H3_not"] * n(~h3) + w["H4_not"] * n(~h4) + w["H5"] * n(h5)).otherwise(w["H1no_H4_not"] * n(~h4) + w["H1no_H5"] * n(h5))


def key_coverage(fetched: Column, key_ids: Column) -> Column:
    return F.when(F.size(key_ids) > 0, F.size(F.array_intersect(fetched, key_ids)) / F.size(key_ids)).otherwise(0.0)


def claims_share(claims: Column, unsupported: Column) -> Column:
    return F.when(claims > 0, 1 - unsupported / claims).otherwise(0.0)


def later_conclusion_quality(c1a: Column, c1b: Column, c2: Column, c3: Column, c4: Column, w: dict[str, float] = WEIGHTS) -> Column:
    yes = lambda c: F.when(c == "yes", 1.0).otherwise(0.0)
    chain = F.when(c1b == "yes", 1.0).when(c1b == "partial", w["C1b_partial_credit"]).otherwise(0.0)
    return F.when(c1a.isNull(), 0.5).otherwise(w["C1a"] * yes(c1a) + w["C1b"] * chain + w["C2"] * yes(c2) + w["C3"] * c3 + w["C4"] * yes(c4))


def later_gap_quality(g1: Column, g2: Column, g3: Column, w: dict[str, float] = WEIGHTS) -> Column:
    yes = lambda c: F.when(c == "yes", 1.0).otherwise(0.0)
    return F.when(g1.isNull(), 0.5).when(g1 == "yes", w["G1"] + w["G2"] * yes(g2) + w["G3"] * yes(g3)).otherwise(w["G1no_G3"] * yes(g3))


def later_total(decision: Column, d: Column, q_conclusion: Column, q_gap: Column, fetch: Column, hypothesis: Column, structure: Column, variant: str = "full", quality_only_if_correct: bool = False) -> Column:
    """Variants: `full`, `outcome` without gated parts, `decision` without a judge."""
    if variant not in ("full", "outcome", "decision"):
        raise ValueError(f"unknown variant {variant!r}")
    out = d if variant == "decision" else outcome(decision, d, q_conclusion, q_gap)
    if quality_only_if_correct:
        out = F.when(d < 0, d).otherwise(out)
    return out + structure + (gate(d) * (fetch + hypothesis) if variant == "full" else F.lit(0.0))


def hypothesis_program(update: Column, judged: Column, grounded: Column | None = None) -> Column:
    """H1 to H5 of an update from its ledger, the judged (hypothesis, touched, direction, main) of each hypothesis and
    whether its stated reason is grounded, and whether anything changed. A move of unknown rank counts as a change without
    direction."""
    moves = ledger(update)

    def moved(name: Column) -> Column:
        mine = F.get(F.filter(moves, lambda m: m["hypothesis"] == name), F.lit(0))
        known = F.coalesce(F.signum(status_rank(mine["after"]) - status_rank(mine["before"])).cast("int"), F.lit(0))
        return F.struct(F.coalesce(mine["before"] != mine["after"], F.lit(False)).alias("changed"), F.coalesce(known, F.lit(0)).alias("direction"))

    wanted = lambda j: F.when(j["direction"] == "supports", 1).otherwise(-1)
    touched = F.filter(judged, lambda j: j["touched"])
    return F.struct(
        (F.size(touched) > 0).alias("h1"),
        F.exists(judged, lambda j: j["main"] & j["touched"] & moved(j["hypothesis"])["changed"] & (moved(j["hypothesis"])["direction"] == wanted(j))).alias("h2"),
        F.exists(touched, lambda j: ~moved(j["hypothesis"])["changed"]).alias("h3"),
        F.exists(judged, lambda j: ~j["touched"] & moved(j["hypothesis"])["changed"]).alias("h4"),
        F.coalesce(grounded if grounded is not None else F.lit(False), F.lit(False)).alias("h5"),
        F.exists(moves, lambda m: m["before"] != m["after"]).alias("changed"),
    )


REWARDS = {"v2": outcome, "v22": later_total}


def register_reward(version: str, total) -> None:
    """Make a reward known by version."""
    REWARDS[version] = total
