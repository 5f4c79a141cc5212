"""Text functions against small hand-made cases."""

import pytest
from pyspark.sql import functions as F

from evispark.functions import numeric as nf
from evispark.functions import text as t


@pytest.fixture(scope="module")
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return value


def test_norm_and_words(one):
    assert one(t.norm(F.lit("  ﬁne “Quoted”—it’s ＡＢ  ok "))) == "fine \"quoted\"-it's ab ok"
    assert one(t.words(t.norm(F.lit("The Cat, a re-run of it's v2.1 x")))) == ["cat", "re-run", "it's", "v2.1"]


@pytest.mark.parametrize("hay,needle,want", [
    ("one two three four five six", "two three", True),
    ("one two three four five six", "zz two three four five", True),
    ("one two three four five six", "two three four five zz", True),
    ("one two three four five six", "zz two three four zz", True),
    ("one two three", "zz two three", False),
    ("anything", "", False),
])
def test_quotes(one, hay, needle, want):
    assert one(t.contains_quote(F.lit(hay), F.lit(needle))) is want


def test_overlap_and_coverage(one):
    a = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    assert one(t.overlap(a("x", "x", "y"), a("x"))) == pytest.approx(2 / 3)
    assert one(t.overlap(a(), a("x"))) == 0.0 and one(t.coverage(a("x"), a())) == 1.0


def test_repairs(one):
    assert one(t.tidy(F.lit("A the car , the the end  ."))) == "the car, the end."
    assert one(t.strip_control(F.lit("a\x00b\tc"))) == "a b\tc"
    assert one(t.clean_pdf_text(F.lit("hy-\n phen  \nx\r\n\n\n\ny\fz"))) == "hyphen\nx\n\ny\nz"
    assert one(t.paragraphs(F.lit("short\n\n" + "a" * 40 + "\n\ntail\n\n" + "b" * 41))) == ["a" * 40 + "\ntail", "b" * 41]


@pytest.mark.parametrize("kind,text,want", [("Observ", "x", "observation"), ("", "he said so", "statement"), ("?", "the sample", "test result"), (None, "5 m", "measurement"), ("", "", "observation")])
def test_kinds(one, kind, text, want):
    assert one(t.normalise_kind(F.lit(kind).cast("string"), F.lit(text))) == want


def test_ids(one):
    assert one(t.evidence_ids(F.lit("E1.2 E0.1 E1.20 xE1.3 E2.3"))) == ["E1.2", "E1.20", "E2.3"]
    assert one(t.expand_ids(F.lit("see E2.3–E2.6, E2.4, E3.1-E2.2"))) == ["E2.3", "E2.4", "E2.5", "E2.6", "E3.1", "E2.2"]
    assert one(t.id_order(F.array(*map(F.lit, ["E1.10", "E1.9", "E2.1", "E1.1"])))) == ["E1.1", "E1.9", "E1.10", "E2.1"]


def test_markers_and_ledger(one):
    assert one(t.closure_marker(F.lit("CASE CLOSED. no, CASE NOT CLOSED"))) == "not_closed"
    assert one(t.leading_marker(F.lit("  CASE CLOSED"))) == "closed" and one(t.first_line_marker(F.lit(" CASE CLOSED"))) is None
    moves = one(t.ledger(F.lit("H1 [Open -> Favored] H2 [open → Ruled out] H1 [x -> y]")))
    assert [(m.hypothesis, m.before, m.after) for m in moves] == [("H1", "open", "favored"), ("H2", "open", "ruled out")]
    assert [one(t.status_rank(F.lit(w))) for w in ("Ruled out", "weakened", "open", "favored", "confirmed", "odd")] == [-2, -1, 0, 1, 2, None]


def test_leaks_and_hygiene(one):
    norm = lambda s: F.lit(s.lower())
    assert one(t.leaks(F.lit("the Blue-Star boats"), norm("the blue-star boats"), F.lit("Blue Star"), norm("blue star"))) is True
    assert one(t.leaks(F.lit("blue5star"), norm("blue5star"), F.lit("Blue Star"), norm("blue star"))) is False
    values = F.array(*map(F.lit, ["Acme Ltd.", "the pilot", "Pilot Jones", "X1", "Ab", "Port of Call", "Big red house", " Acme Ltd"]))
    assert one(t.identifier_hygiene(values)) == ["Acme Ltd", "Port of Call", "X1"]


def test_json_and_digests(one):
    assert one(nf.tolerant_json(F.lit('```json\n{"a": [1, 2,],}\n```'))).json == '{"a": [1, 2]}'
    assert one(nf.tolerant_json(F.lit('{"a": "cut'))).json == '{"a": "cut"}' and one(nf.tolerant_json(F.lit("none"))).json is None
    a, b = (one(nf.canonical_digest(F.lit(x))) for x in ('{"b":null,"a":"é","package_hash":"x"}', '{"a":"é", "b":null}'))
    assert a == b and one(nf.canonical_digest(F.lit('{"a":NaN}'))) is None


def test_sections_and_edits(one):
    found = one(t.sections(F.lit("intro\n## A\nx\n## B \ny\nz\n## A\nlast")))
    assert found == {"B": "y\nz", "A": "last"}
    assert one(t.replace_once(F.lit("a b a"), F.lit("b"), F.lit("c"))) == "a c a" and one(t.replace_once(F.lit("a b a"), F.lit("a"), F.lit("c"))) is None
    assert one(nf.lower_rank(F.array(*map(F.lit, range(1, 11))), 0.95)) == 9
    assert one(nf.round_half_even(F.lit(0.0625))) == 0.062 and one(nf.round_half_up(F.lit(2.5))) == 3
