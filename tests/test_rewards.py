"""Closed-form expectations of rewards, penalties and program parts, as data rows."""

import pytest
from pyspark.sql import functions as F

from evispark.operators import rewards as r


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value


@pytest.mark.parametrize("decision,label,qc,qg,want", [
    ("closed", "closed", 1.0, 0.5, 2.0), ("not_closed", "not_closed", 0.75, 0.5, 1.25), ("closed", "not_closed", 1.0, 0.5, 0.0),
    ("closed", "not_closed", 0.0, 0.5, -2.0), (None, "closed", 1.0, 1.0, -1.0),
])
def test_outcome_corners(one, decision, label, qc, qg, want):
    d = F.lit(decision).cast("string")
    assert one(r.outcome(d, r.decision_reward(d, F.lit(label)), F.lit(qc), F.lit(qg))) == pytest.approx(want)


def test_gate_applies_to_wrong_decisions(one):
    args = lambda label: (F.lit("closed"), r.decision_reward(F.lit("closed"), F.lit(label)), F.lit(1.0), F.lit(0.5), F.lit(0.4), F.lit(0.6), F.lit(0.0))
    assert one(r.later_total(*args("closed"))) == pytest.approx(2.0 + 1.0)
    assert one(r.later_total(*args("not_closed"))) == pytest.approx(0.0 + 0.3)
    assert one(r.later_total(*args("not_closed"), variant="decision")) == -1.0
    assert one(r.later_total(*args("not_closed"), variant="outcome", quality_only_if_correct=True)) == -1.0
    with pytest.raises(ValueError):
        r.later_total(*args("closed"), variant="odd")
    with pytest.raises(ValueError):
        r.weights(odd=1.0)


@pytest.mark.parametrize("turns,again,invalid,want", [(8, 0, 0, -0.2), (6, 19, 0, -0.9), (30, 0, 0, -1.0), (6, 0, 3, -0.6), (7, 12, 1, -0.5)])
def test_structure(one, turns, again, invalid, want):
    ids = F.array(F.lit("E1.1"))
    got = r.structure_penalty(F.lit("closed"), F.lit("x"), ids, F.lit(True), F.lit(turns), F.lit(again), F.lit(invalid))
    assert one(got) == pytest.approx(want)


def test_citations_and_missing_markers(one):
    none = F.array().cast("array<string>")
    p = lambda marker, cited, seen: one(r.structure_penalty(F.lit(marker).cast("string"), F.lit("x"), cited, F.lit(seen), F.lit(1), F.lit(0), F.lit(0)))
    assert (p(None, none, True), p("closed", none, True), p("closed", F.array(F.lit("E1.1")), False)) == (-2.0, -0.25, -0.5)


def test_updates_and_qualities(one):
    b = F.lit
    assert one(r.update_score(b(True), b(True), b(False), b(False), b(False))) == pytest.approx(0.85)
    assert one(r.update_score(b(False), b(False), b(False), b(False), b(False))) == pytest.approx(0.7)
    assert one(r.update_score(b(False), b(False), b(False), b(True), b(True))) == pytest.approx(0.3)
    assert one(r.conclusion_quality(b("partial"), b("yes"), b("yes"), b("no"))) == pytest.approx(0.625)
    assert one(r.later_conclusion_quality(b("yes"), b("partial"), b("yes"), r.claims_share(b(4), b(1)), b("no"))) == pytest.approx(0.65)
    assert one(r.claims_share(b(0), b(0))) == 0.0
    assert one(r.later_gap_quality(b("no"), b("yes"), b("yes"))) == 0.5 and one(r.gap_quality(b(None).cast("string"), b("yes"), b("yes"))) == 0.5
    assert one(r.key_coverage(F.array(b("a"), b("b")), F.array(b("b"), b("c")))) == 0.5


def test_hypothesis_program(spark):
    judged = [("H1", True, "supports", True), ("H2", False, "unrelated", False)]
    rows = [("H1 [open -> favored] H2 [open -> open]", judged), ("H1 [open -> open] H2 [open -> weakened]", judged)]
    frame = spark.createDataFrame(rows, "u string, j array<struct<hypothesis:string,touched:boolean,direction:string,main:boolean>>")
    got = [tuple(x.p) for x in frame.select(r.hypothesis_program(F.col("u"), F.col("j")).alias("p")).collect()]
    assert got == [(True, True, False, False, False, True), (True, False, True, True, False, True)]


def test_key_hit(spark):
    rows = [("c", 1, ["E2.2", "E2.3"], ["E2.2", "E2.3"], ["E2.2", "E2.5"]), ("c", 2, ["E2.4"], ["E2.4"], ["E2.2", "E2.5"]), ("d", 1, ["E2.4"], ["E2.4"], [])]
    frame = spark.createDataFrame(rows, "case string, turn int, fresh array<string>, ids array<string>, keys array<string>")
    got = {x.case: x.key_hit for x in r.key_hit(frame, ["case"], "fresh", "ids", "keys").collect()}
    assert got == {"c": pytest.approx((0.5 + 1.0) / 2), "d": 0.0}
