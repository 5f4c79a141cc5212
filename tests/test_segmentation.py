"""Segmentation, anonymisation and judging on small fixtures."""

from pyspark.sql import functions as F

from evispark.operators import anonymise, judging, segmentation


def test_headings(spark):
    rows = ["1.2 Engine Examination", "WRECKAGE AND IMPACT", "History of the Flight", "Page 3 of 9", "It rained.", "THE END OF IT.", "2. Findings.", "ab", "plain words here"]
    frame = spark.createDataFrame([(r,) for r in rows], "line string")
    got = [r.h for r in frame.select(segmentation.heading(F.col("line")).alias("h")).collect()]
    assert got == ["1.2 Engine Examination", "WRECKAGE AND IMPACT", "History of the Flight", None, None, None, "2 Findings.", None, None]


def test_blocks(spark):
    long = "word " * 50
    text = f"{long}\nFIRST HEADING\n{long}\nSECOND HEADING\nshort\nTHIRD HEADING\n{long}\n\n{long}"
    docs = spark.createDataFrame([("a", text), ("b", "no headings here"), ("c", "")], "doc string, text string")
    got = {}
    for r in segmentation.blocks(docs, "doc", most=300).orderBy("doc", "block_idx").collect():
        got.setdefault(r.doc, []).append((r.label, r.text))
    assert [x[0] for x in got["a"]] == ["(front)", "FIRST HEADING", "THIRD HEADING", "THIRD HEADING (continued 2)"]
    assert got["a"][1][1].endswith("SECOND HEADING\nshort") and got["b"] == [("body", "no headings here")] and "c" not in got


def test_fixed_sections_and_fields(spark):
    docs = spark.createDataFrame([("a", "before FIRE burnt TESTS found\nDate Opened: May\nDate Opened: June")], "doc string, text string")
    assert [(r.label, r.text.split("\n")[0]) for r in segmentation.named_sections(docs, "doc", ["FIRE", "TESTS?"]).orderBy("pos").collect()] == [("Narrative", "before"), ("Fire", "burnt"), ("Tests", "found")]
    assert [(r.field, r.value) for r in segmentation.header_fields(docs, "doc").collect()] == [("Date Opened", "May")]
    files = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), ("y", "A")], "id string, kind string")
    assert [r.id for r in segmentation.both_kinds(files, "id", "kind", ["A", "B"]).collect()] == ["x"]
    shares = spark.range(1).select(segmentation.answer_share(F.lit("The Compressor failed"), F.lit("compressor blade")).alias("a"), segmentation.answer_share(F.lit("x"), F.lit("no")).alias("b")).first()
    assert (shares.a, shares.b) == (0.5, 1.0)


def test_names(spark):
    texts = spark.createDataFrame([("c", "The NTSB met Blue Star Lines. Jones flew; Jones left. After Jones, NTSB.")], "case_id string, text string")
    got = [(r.name, r.n) for r in anonymise.proper_nouns(texts, "case_id", "text").orderBy("place").collect()]
    assert got[:3] == [("NTSB", 2), ("Blue Star Lines", 1), ("Jones", 2)]
    names = spark.createDataFrame([("c", "Jones", "the pilot", "operator"), ("c", "Blue Star", "the firm", "operator")], "case_id string, old string, new string, key string")
    items = spark.createDataFrame([("c", "JONES of blue-star lines, Jonesy and Blue Star")], "case_id string, text string")
    row = anonymise.anonymise(items, names).first()
    assert row.text == "the pilot of the subject lines, the subject and the firm" and row.forced == ["Blue Star", "Jones"]
    left = items.select(anonymise.residual_acronyms(F.lit("the ATSB said ATSBX"), F.array(F.lit("ATSB RAIB"))).alias("x")).first()["x"]
    assert left == ["ATSB"]


def test_judge_answers(spark):
    good = '{"items":[{"score":3,"justification":"a"},{"score":10,"justification":"b"}]}'
    rows = [(good,), ('{"items":[{"score":3,"justification":"a"}]}',), ('{"items":[{"score":11,"justification":"a"},{"score":1,"justification":"b"}]}',), ('{"items":[{"score":1.5,"justification":"a"},{"score":1,"justification":"b"}]}',), ("junk",)]
    frame = spark.createDataFrame(rows, "answer string")
    assert [r.problem for r in judging.scored_items(frame, "answer", F.lit(2)).collect()] == [None, "missing_items", "out_of_range", "schema", "schema"]
    rows = [('{"H1":{"answer":"no"},"H2":{"answer":"n/a"}}',), ('{"H1":{"answer":"no"},"H2":{"answer":"yes"}}',), ('{"H1":{"answer":"maybe"},"H2":{"answer":"yes"}}',), ('{"H1":{"answer":"yes"}}',)]
    out = judging.answered(spark.createDataFrame(rows, "answer string"), "answer", {"H1": ("yes", "no"), "H2": ("yes", "no", "n/a")}, {"H2": ("H1", "no", "n/a")})
    assert [r.problem for r in out.collect()] == [None, "inconsistent", "out_of_range", "missing_items"]
    rows = [("a", '{"case_id":"a","score":3,"action":"revise"}'), ("a", '{"case_id":"b","score":3,"action":"revise"}'), ("a", '{"case_id":"a","score":9,"action":"revise"}'), ("a", '{"case_id":"a","score":1,"action":"x"}'), ("a", "?")]
    assert [r.problem for r in judging.audit_replies(spark.createDataFrame(rows, "case_id string, reply string"), "reply").collect()] == [None, "case", "score", "action", "schema"]


def test_behaviour(spark):
    turns = [("c", 1, "H1 [open -> favored]"), ("c", 2, "H2 [open -> favored] H1 [favored -> weakened]"), ("c", 3, "H1 [weakened -> ruled out]")]
    got = judging.hypothesis_behaviour(spark.createDataFrame(turns, "case_id string, turn int, assistant string"), ["case_id"]).first()
    assert (got.hypotheses, got.new_later, got.ruled_out, got.switches) == (2, 1, 1, 1)
    folded = spark.createDataFrame([("c", ["a", "b"], ["o"], ["a", "b"]), ("c", ["b"], ["o", "a", "b"], [])], "case_id string, call_ids array<string>, seen_before array<string>, fresh array<string>")
    keys = spark.createDataFrame([("c", ["b", "z"])], "case_id string, key_ids array<string>")
    got = judging.fetch_behaviour(folded, ["case_id"], keys).first()
    assert (got.fetches, got.ids_per_fetch, got.rerequested, got.key_recall, got.key_precision) == (2, 1.5, 1, 0.5, 0.5)
