"""Trajectories, contracts, extraction, counterfactuals, sources, sinks and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from evispark.functions.numeric import canonical_digest
from evispark.operators import contract, counterfactual, extraction, groups, sampling, trajectory, windows
from evispark.sources import readers, sinks
from evispark.streaming import folds, modelcall

TURNS = "case_id string, sample int, turn int, assistant string, call_ids array<string>, reason string, call_errors array<string>, returned_ids array<string>, return_error string"


@pytest.fixture(scope="module")
def rollouts(spark):
    why = "to see what it says"
    turns = [
        ("A", 0, 1, "H1 [open -> favored]", ["E2.1", "E2.2"], why, [], ["E2.1", "E2.2"], None),
        ("A", 0, 2, "see E2.1", ["E2.2", "E2.3"], why, [], ["E2.3"], None),
        ("B", 0, 1, "see E2.9", ["E2.1"], "short", [], ["E2.1"], None),
        ("B", 0, 2, "x", ["E9.9"], why, [], [], "unknown id"),
    ]
    finals = [("A", 0, "CASE CLOSED by E2.1 and E1.1"), ("B", 0, "no idea, E2.7")]
    return (
        spark.createDataFrame(turns, TURNS),
        spark.createDataFrame([("A", ["E1.1"]), ("B", ["E1.1"])], "case_id string, opening array<string>"),
        spark.createDataFrame(finals, "case_id string, sample int, final_answer string"),
    )


def test_results(rollouts):
    got = {r.case_id: r for r in trajectory.results(*rollouts).collect()}
    assert got["A"].disclosed == ["E1.1", "E2.1", "E2.2", "E2.3"] and got["A"].citations_seen and got["A"].marker == "closed"
    assert got["B"].fetched == ["E2.1"] and not got["B"].citations_seen and got["B"].marker is None and "E9.9" in got["B"].requested


def test_format_violations(spark, rollouts):
    labels = spark.createDataFrame([("A", "not_closed"), ("B", "closed")], "case_id string, closure string")
    got = {(r.case_id, r.turn, r.rule) for r in trajectory.format_violations(*rollouts, labels).collect()}
    assert got == {
        ("A", None, "the marker is not the label"), ("B", None, "no marker"), ("B", None, "a cited item was never seen"),
        ("B", 1, "arguments are invalid"), ("B", 1, "an item is cited before it was seen"),
    }


def test_patches(spark):
    texts = spark.createDataFrame([("A", "final", "one two"), ("B", "final", "one one")], "case_id string, target string, text string")
    ops = spark.createDataFrame([("A", "final", 2, "1", "uno"), ("A", "final", 1, "one", "1"), ("B", "final", 1, "one", "1")], "case_id string, target string, op_no int, old string, new string")
    got = {r.case_id: (r.text, r.error is None) for r in trajectory.apply_patches(texts, ops).collect()}
    assert got == {"A": ("uno two", True), "B": ("one one", False)}


def test_contract(spark):
    package = {"case_id": "c-1", "domain": "d", "task_question": "q", "initial_context": "i", "version": "v", "sources": {"S1": "x"}}
    digest = spark.range(1).select(canonical_digest(F.lit(json.dumps(package))).alias("x")).first()["x"]
    packages = spark.createDataFrame([("c-1", "d", "q", "i", "v", digest, {"S1": "x"}), ("2c", "d", " ", "i", "v", "bad", {})], "case_id string, domain string, task_question string, initial_context string, version string, package_hash string, sources map<string,string>")
    items = [("c-1", 0, "E1.1", "t", "x", "S1"), ("c-1", 1, "E1.1", "t", "x\x01", "S2"), ("c-1", 2, "E1.3.2", "t", "x", "S1")]
    evidence = spark.createDataFrame(items, "case_id string, pos int, evidence_id string, neutral_title string, text string, source_id string")
    got = {(r.case_id, r.location, r.rule) for r in contract.violations(packages.withColumn("again", F.lit(digest)), evidence, "again").collect()}
    assert ("c-1", "evidence_items[1]", "evidence_id is there twice") in got and ("c-1", "evidence_items[1]", "text has control characters") in got
    assert ("c-1", "evidence_items[1]", "source_id is not declared") in got and ("2c", "case", "no evidence items") in got
    assert not any(case == "c-1" and where != "evidence_items[1]" for case, where, _ in got)
    assert {r for c, w, r in got if c == "2c"} >= {"case_id is not opaque", "task_question is empty", "package_hash is no digest", "sources is empty", "package_hash is stale"}


def test_greedy_near_duplicates_are_not_transitive(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [("c", 0, " ".join(base)), ("c", 1, " ".join(base[:9])), ("c", 2, " ".join(base[:8])), ("c", 3, "alpha beta"), ("c", 4, "alpha beta")]
    items = spark.createDataFrame(rows, "case_id string, pos int, text string")
    got = {r.pos for r in extraction.near_duplicates(items, "case_id", "pos", "text").where("dropped").collect()}
    assert got == {1}  # the second drops, so the third is only held against the first


def test_assembly(spark):
    items = spark.createDataFrame([("c", 0, "b", "p1"), ("c", 1, "a", "p2"), ("c", 2, "b", "zz"), ("c", 3, "c", "p1")], "case_id string, pos int, label string, proposed string")
    assert [r.evidence_id for r in extraction.number_items(items).orderBy("pos").collect()] == ["E1.1", "E2.1", "E1.2", "E3.1"]
    mapping = spark.createDataFrame([("c", "p1", "x"), ("c", "p2", "y")], "case_id string, proposed string, target string")
    got = [(r.source_id, r.unmapped) for r in extraction.canonical_sources(items, mapping).orderBy("pos").collect()]
    assert got == [("S1", False), ("S2", False), ("S1", True), ("S1", False)]
    built = spark.createDataFrame([("n1", "X-0007")], "native_id string, case_id string")
    planned = {r.native_id: (r.case_id, r.new) for r in extraction.plan_cases(spark.createDataFrame([("n1",), ("n3",), ("n2",)], "native_id string"), built, "X-").collect()}
    assert planned == {"n1": ("X-0007", False), "n2": ("X-0008", True), "n3": ("X-0009", True)}


def test_key_sets_and_variants(spark):
    units = spark.createDataFrame([("c", ["E1.1", "E2.1"], "G"), ("c", ["E2.2", "E2.9"], "N"), ("c", ["E2.3", "E2.2"], "G")], "case_id string, ids array<string>, role string")
    store = spark.createDataFrame([("c", f"E{a}.{b}") for a, b in ((1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6))], "case_id string, evidence_id string")
    keys = counterfactual.key_sets(units, store, F.col("evidence_id").startswith("E1."))
    assert {r.evidence_id for r in keys.collect()} == {"E2.1", "E2.2", "E2.3"}
    levels = {}
    for r in counterfactual.variants(keys, store.where("evidence_id NOT LIKE 'E1.%'"), 5).collect():
        levels.setdefault(r.level, set()).add(r.evidence_id)
    assert {k: len(v) for k, v in levels.items()} == {"level_000": 1, "level_040": 1, "level_075": 2, "level_100": 3, "control": 3} and levels["level_000"] == {None}
    assert levels["level_040"] < levels["level_075"] < levels["level_100"] and not levels["control"] & levels["level_100"]


def test_restatement(spark):
    rows = [("c", "E2.1", "Pressure fell to 4,512 units while 38 psi held \'the old inner seal\' near compressor housing"), ("c", "E2.2", "Later notes repeat 4512 and 38 psi plainly"), ("c", "E2.3", "nothing of the kind"), ("c", "E2.4", "It was the old inner seal."), ("c", "E2.5", "only 4512 there")]
    items = spark.createDataFrame(rows, "case_id string, evidence_id string, text string")
    targets = items.where("evidence_id <> 'E2.1'").select("case_id", F.col("evidence_id").alias("target"), F.lit(False).alias("in_brief"), "text")
    got = {r.target: r.likely for r in counterfactual.leak_check(items.where("evidence_id = 'E2.1'"), targets, items).collect()}
    assert got == {"E2.2": True, "E2.4": True, "E2.5": False}
    again = counterfactual.top_hits(counterfactual.leak_check(items.where("evidence_id = 'E2.1'"), targets, items))
    assert [(r.target, r.strength, r.place) for r in again.orderBy("place").collect()] == [("E2.2", 2, 1), ("E2.4", 2, 2)]


def test_refill_and_packs(spark):
    assert groups.refill(14, 18, 0.5) == 8 and groups.refill(20, 18, 0.5) == 0 and groups.refill(0, 1, 0.0) == 4
    rows = spark.createDataFrame([("b", k, n) for k, n in enumerate((9, 7, 5, 4, 3))], "b string, k int, n bigint")
    shards = {r.k: r.shard for r in sampling.longest_first(rows, "b", "k", "n", 2).collect()}
    assert shards == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}
    packs = {r.k: r.pack for r in sampling.next_fit(rows, "b", "k", "n", 12).collect()}
    assert packs == {4: 0, 3: 0, 2: 0, 1: 1, 0: 2}
    assert [r["_r"] for r in windows.global_rank(rows, ["n", "k"], "_r", 3).orderBy("n").collect()] == [1, 2, 3, 4, 5]


def test_sources_and_sinks(spark, tmp_path):
    base = str(tmp_path)
    sinks.write_jsonl(spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, x int"), f"{base}/log", gzip=True)
    needed = spark.createDataFrame([("b",)], "case_id string")
    assert [tuple(r) for r in readers.read_source(spark, "jsonl_needed", f"{base}/log", "case_id string, x int", needed).collect()] == [("b", 2)]
    with pytest.raises(Exception, match="missing key"):
        readers.jsonl_needed(spark, f"{base}/log", "case_id string, x int", spark.createDataFrame([("z",)], "case_id string")).collect()
    (tmp_path / "ids").write_text("a\nb\na\n")
    with pytest.raises(Exception, match="duplicate id"):
        readers.id_list(spark, f"{base}/ids").collect()
    (tmp_path / "page").write_text('# x\ntokens{a="1"} 2.5\ntokens{a="2"} 4\nother 9\n')
    assert readers.metric_text(spark, f"{base}/page", "tokens").first()["total"] == 6.5
    with pytest.raises(PermissionError):
        readers.refuse_test_data("/data/test_split/x")
    with pytest.raises(KeyError):
        readers.read_source(spark, "odd")


def test_model_calls_are_made_once(spark):
    prompts = spark.createDataFrame([("a", "the cause is known"), ("b", "nothing"), ("c", "the cause is known")], "case_id string, prompt string")
    none = spark.createDataFrame([], modelcall.CALLS)
    calls = modelcall.model_call(prompts, none, "label").collect()
    assert sorted(r.reply for r in calls) == ["CASE CLOSED", "CASE NOT CLOSED"]
    done = spark.createDataFrame(calls, modelcall.CALLS)
    assert modelcall.model_call(prompts, done, "label").count() == 0
    inflight = done.withColumn("state", F.lit("inflight"))
    assert {r.plan for r in modelcall.call_plan(prompts, inflight, "marker").collect()} == {"uncertain"}
    assert modelcall.usable(done.withColumn("finish_reason", F.lit("length"))).count() == 0
    assert modelcall.over_budget(done.withColumn("cost", F.lit(2.0)), 3.0)


def test_stages_stream_into_each_other(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([("a", 1), ("b", 3)], "case_id string, score int").write.parquet(f"{base}/cases")
    stages = [("double", lambda df: df.withColumn("score", F.col("score") * 2)), ("keep", lambda df: df.where("score > 3"))]
    for _ in range(2):  # a second run finds nothing new
        modelcall.run_stages(spark, f"{base}/cases", f"{base}/out", stages, f"{base}/check", "case_id string, score int")
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{base}/out/keep").collect()] == [("b", 6)]


def test_live_disclosure_is_the_batch_fold(spark, tmp_path):
    rows = [("a", 1, ["x", "y"], True), ("a", 2, ["y", "z"], True), ("a", 3, ["q"], False), ("b", 1, ["x"], True)]
    schema = "case_id string, turn int, ids array<string>, valid boolean"
    for k, part in enumerate((rows[:1] + rows[3:], rows[1:3])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = folds.live_disclosure(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.case_id, r.turn): len(r.fresh) for r in spark.table("live").collect()}
    assert sum(got.values()) == 4 and got[("b", 1)] == 1 and got[("a", 3)] == 0


def test_greedy_near_duplicates_over_the_whole_case(spark, tmp_path):
    import random

    from evispark.plans import extraction as plans

    rng = random.Random(3)
    bases = [[f"w{b}x{i}" for i in range(rng.choice([2, 9, 17, 30, 60]))] for b in range(8)]
    rows = []
    for k in range(240):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(4)}"
        rows.append((rng.randrange(10) * 50_000 + k, " ".join(rng.sample(w, len(w))), rng.choice(["en", "de"]), "src0"))
    rows += [(7, "", "en", "src0"), (49_999, "one two three four", "en", "src1"), (50_000, "four three two one", "en", "src1"), (50_001, "four three two one", "en", "src2")]
    rows += [(None, "one two three four", "en", "src1"), (9, None, "en", "src1"), (50_000, "four three two one", "en", "src1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept, expected = [], []
    for k, text, lang, source in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        bag = {w for w in (text or "").split()}
        hit = len(bag) >= 3 and any(c == (source, lang) and len(bag & b) >= 0.88 * len(bag | b) for c, b in kept)
        expected.append((f"{source}:{lang}", k, hit))
        if not hit:
            kept.append(((source, lang), bag))
    got = [tuple(r) for r in plans.near_duplicate_greedy(spark, str(tmp_path)).select("case", "doc_id", "dropped").collect()]
    by = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    assert sorted(got, key=by) == sorted(expected, key=by)
    assert ("src1:en", 50_000, True) in got and ("src2:en", 50_001, False) in got


@pytest.fixture()
def framed():
    """Replies as a frame; made anew, so that workers get it by value."""

    def frame(prompts, status, reply, finish, cost):
        import pandas as pd

        return pd.DataFrame({"reply": [reply(p) for p in prompts], "finish_reason": [finish(p) for p in prompts], "status": [status(p) for p in prompts], "cost": [cost] * len(prompts)})

    return frame


def test_calls_are_made_once_and_states_are_kept(spark, tmp_path, framed):
    kinds = {"fine": "ok", "refused": "http_400", "lost": "read_timeout_late", "cut": "ok"}
    modelcall.register_model("kinds", lambda prompts: framed(prompts, lambda p: kinds[p], lambda p: p.upper(), lambda p: "length" if p == "cut" else "stop", 1.5))
    prompts = spark.createDataFrame([(p,) for p in [*kinds, "fine"]], "prompt string")
    path = f"file://{tmp_path}/calls"
    first = {(r.prompt, r.plan, r.reply) for r in modelcall.call_once(spark, prompts, path, "s", "kinds").collect()}
    assert first == {("fine", "call", "FINE"), ("refused", "call", None), ("lost", "call", None), ("cut", "call", None)}
    second = {(r.prompt, r.plan) for r in modelcall.call_once(spark, prompts, path, "s", "kinds").collect()}
    assert second == {("fine", "cached"), ("refused", "call"), ("lost", "uncertain"), ("cut", "cached")}
    states = modelcall.known_calls(spark, path).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in states} == {"inflight": 5, "done": 2, "failed": 2, "uncertain": 1}
    with pytest.raises(modelcall.BudgetSpent):
        modelcall.call_once(spark, prompts, path, "s", "kinds", budget=7.0)


def test_passing_errors_are_tried_again_and_formats_are_asked_for_again(spark, framed):
    tried = {}

    def flaky(prompts):
        for p in prompts:
            tried[p] = tried.get(p, 0) + 1
        return framed(prompts, lambda p: "ok" if tried[p] > 2 or p == "sound" else "http_503", lambda p: p, lambda p: "stop", 1.0)

    modelcall.register_model("flaky", flaky)
    prompts = spark.createDataFrame([("sound",), ("shaky",)], "prompt string").coalesce(1)
    once = modelcall.model_call(prompts, spark.createDataFrame([], modelcall.CALLS), "s", "flaky", wait=(0.0, 0.0)).collect()
    assert {(r.reply, r.state, r.cost) for r in once} == {("sound", "done", 1.0), ("shaky", "done", 3.0)}
    answered = spark.createDataFrame([("p", "bad"), ("q", "good")], "prompt string, reply string")
    again = modelcall.format_retries(answered, F.when(F.col("reply") == "bad", "no JSON")).collect()
    assert [r.prompt for r in again] == ["p\n\nYour previous reply was rejected: no JSON. Answer again."]


def test_files_of_settings_documents_and_their_cache(spark, tmp_path):
    (tmp_path / "env").write_text("# KEY=no\nKEY=one=two\n\nEMPTY=\nKEY=later\n OTHER = x \n")
    assert {r.key: r.value for r in readers.key_values(spark, str(tmp_path / "env")).collect()} == {"KEY": "one=two", "OTHER": "x"}
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"first")
    (folder / "b.pdf").write_bytes(b"broken")

    def extract(content):
        if content == b"broken":
            raise ValueError("no such format")
        return content.decode() + "!"

    readers.register_extractor("shout", extract)
    read = lambda: {r.id: r.text for r in readers.documents_with_cache(spark, f"{folder}/*.pdf", f"file://{tmp_path}/cache", "shout").collect()}
    assert read() == {"a": "first!", "b": None}
    (folder / "a.pdf").write_bytes(b"changed")
    (folder / "c.pdf").write_bytes(b"third")
    assert read() == {"a": "first!", "b": None, "c": "third!"}


def test_trees_logs_indexes_and_manifests(spark, tmp_path):
    for case, name, text in (("c1", "final_report.txt", "one\ntwo"), ("c2", "prelim.txt", "three")):
        (tmp_path / "tree" / case).mkdir(parents=True)
        (tmp_path / "tree" / case / name).write_text(text)
    tree = readers.text_tree(spark, str(tmp_path / "tree"))
    assert {(r.id, r.kind, r.text) for r in tree.collect()} == {("c1", "final", "one\ntwo"), ("c2", "prelim", "three")}
    index = spark.createDataFrame([("c1", 1), ("c9", 2)], "id string, n int")
    assert [(r.id, r.n, r.text) for r in readers.index_with_texts(index, tree).collect()] == [("c1", 1, "one\ntwo")]
    manifest = spark.createDataFrame([("c1", False), ("c2", True), ("c3", None)], "id string, interim boolean")
    assert [r.id for r in readers.manifest_or_listing(manifest, tree.select("id")).collect()] == ["c1"]
    assert readers.manifest_or_listing(None, tree.select("id")).count() == 2
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"id":\n"a"}')
    (tmp_path / "json" / "b.failed.json").write_text('{"id": "b"}')
    assert [r.id for r in readers.json_files(spark, f"{tmp_path}/json/*.json", "id string").collect()] == ["a"]
    (tmp_path / "log").write_text('starting\n{"step": 1}\n{"step": 2}\nbye {}\n')
    assert readers.json_log(spark, str(tmp_path / "log")).count() == 2


def test_reports_dumps_logs_and_retention(spark, tmp_path):
    items = spark.createDataFrame([("c", 2, "E1.2", "b", "y"), ("c", 1, "E1.1", "a", "x")], "case_id string, pos int, evidence_id string, neutral_title string, text string")
    assert sinks.markdown_report(items).first().report == "## c\n\n### E1.1 a\n\nx\n\n### E1.2 b\n\ny"
    rows = spark.range(50)
    assert sinks.sampled_dump(rows, 5, 1, "id").collect() == sinks.sampled_dump(rows.repartition(7), 5, 1, "id").collect()
    versions = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False), (5, False)], "version int, pinned boolean")
    assert sorted(r.version for r in sinks.expired(versions, 2, F.col("version") == 3, F.col("pinned")).collect()) == [1]
    split = spark.createDataFrame([("x", "train"), ("y", "test"), ("z", "train")], "raw string, split string")
    sinks.write_splits(split, f"{tmp_path}/splits")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/splits/split=train").collect()) == ["x", "z"]
    for k in range(2):
        sinks.append_log(spark.createDataFrame([(k,)], "step int"), f"{tmp_path}/runs")
    assert sorted(r.step for r in spark.read.json(f"{tmp_path}/runs").collect()) == [0, 1]
    done = spark.createDataFrame([("a", "1", "ok"), ("b", "1", "failed")], "case string, input string, status string")
    todo = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "case string, input string")
    assert sorted(tuple(r) for r in sinks.pending(todo, done, ["case", "input"]).collect()) == [("a", "2"), ("b", "1")]


def test_forced_removal(spark):
    from evispark.operators import anonymise

    rows = [("The Mill-Lane works and MILL LANE", ["Mill Lane", "mill", None, " "], "the place"), ("a b", None, "x"), (None, ["a"], "x"), ("O'Neil's boat", ["O'Neil"], "cost $1\\2")]
    frame = spark.createDataFrame(rows, "text string, names array<string>, neutral string")
    got = [tuple(r.f) for r in frame.select(anonymise.force_remove(F.col("text"), F.col("names"), F.col("neutral")).alias("f")).collect()]
    assert got[0] == ("The the place works and the place", ["Mill Lane"])
    assert got[1] == ("a b", []) and got[2] == (None, [])
    assert got[3][1] == [] or got[3][0].startswith("cost $1\\2")


def test_items_are_their_own_targets(spark, monkeypatch):
    shared = "pressure valve compressor housing inspection engine number turbine seal"
    rows = [("c", "1", shared + " 4512.5 units"), ("c", "2", "later " + shared + " 4512.5 units"), ("d", "3", shared + " 4512.5 units")]
    rows += [("c", str(k), " ".join(f"w{k}o{i}" for i in range(9))) for k in range(4, 12)]
    items = spark.createDataFrame(rows, "case_id string, evidence_id string, text string")
    targets = items.select("case_id", F.col("evidence_id").alias("target"), F.lit(False).alias("in_brief"), "text")
    columns = ["case_id", "evidence_id", "target", "number", "token", "shingle", "time", "quote", "likely"]
    own, given = (sorted(map(tuple, counterfactual.leak_check(items, t, items).select(columns).collect())) for t in (None, targets))
    assert own == given == [("c", "1", "2", 1, 9, 6, 0, 0, True), ("c", "2", "1", 1, 9, 6, 0, 0, True)]


def test_common_clock_times_and_bare_numbers_are_restatements(spark):
    rows = [("c", str(k), f"item {k} at 10:15 and 11:40") for k in range(1, 6)]  # times of more than MOST_ITEMS items
    rows += [("c", "a", "burst at 38 psi and 007250 and 2.5e3 kg"), ("c", "b", "levels 38 then 7,250,001 seen"), ("c", "d", "38.1 or 1.38 or 138, 2.5e3 later"), ("c", "e", "380 and 72500 and 2.5e31")]
    items = spark.createDataFrame(rows, "case_id string, evidence_id string, text string")
    targets = items.select("case_id", F.col("evidence_id").alias("target"), F.lit(False).alias("in_brief"), "text")
    brief = spark.createDataFrame([("c", "brief", True, "From 10:15 to 11:40.")], "case_id string, target string, in_brief boolean, text string")
    checked = counterfactual.leak_check(items, targets.unionByName(brief), items).where("likely OR evidence_id = 'a'")
    got = sorted(tuple(r) for r in checked.select("evidence_id", "target", "number", "time", "likely").collect())
    assert got == [*[(str(k), "brief", 0, 2, True) for k in range(1, 6)], ("a", "b", 2, 0, True), ("a", "d", 2, 0, True)]
