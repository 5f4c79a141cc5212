from collections import Counter

import pytest

from evispark.llm import token_counts
from evispark.llm.common import fresh_path
from evispark.llm.tokens import default_path, encoder

PATH = default_path("byte_bpe_50k.json")


def _totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_totals_follow_inserts_deletes_and_revisions(spark, edge_docs):
    counted = token_counts.count_by_versions(edge_docs, {"v": PATH}).drop("version")
    rollup = token_counts.Rollup(spark, fresh_path(spark, "test-rollup"))
    assert rollup.commit("a-1", token_counts.changes(counted, "insert", "v"))
    want = Counter()
    docs = Counter()
    coder = encoder(PATH).tokenizer
    for r in edge_docs.collect():
        want[(r.source, r.lang)] += len(coder.encode(r.text or "", add_special_tokens=False).ids)
        docs[(r.source, r.lang)] += 1
    assert _totals(rollup) == {k: (docs[k], want[k]) for k in docs}
    assert not rollup.commit("a-1", token_counts.changes(counted, "insert", "v"))
    assert _totals(rollup) == {k: (docs[k], want[k]) for k in docs}
    gone = counted.where("source = 'src0'")
    rollup.commit("b-1", token_counts.changes(gone, "delete", "v"))
    rollup.commit("c-1", token_counts.changes(counted.where("source = 'src1'").selectExpr("*", "n_tokens * 2 AS new"), "revise", "v", "new", "n_tokens"))
    after = {k: (docs[k], want[k] * (2 if k[0] == "src1" else 1)) for k in docs if k[0] != "src0"}
    assert _totals(rollup) == after
    rollup.compact()
    assert _totals(rollup) == after
    assert rollup.committed() == {"a-1", "b-1", "c-1"} and not rollup.commit("b-1", token_counts.changes(gone, "delete", "v"))
    assert _totals(rollup) == after


def test_empty_batches_and_bad_input(spark, no_docs):
    rollup = token_counts.Rollup(spark, fresh_path(spark, "test-rollup"))
    assert rollup.commit("none", token_counts.changes(token_counts.count_by_versions(no_docs, {"v": PATH}), "insert"))
    assert rollup.totals().count() == 0 and rollup.committed() == {"none"}
    with pytest.raises(ValueError):
        rollup.commit("../x", None)
    odd = spark.createDataFrame([("upsert", "s", "en", "v", 1, 0)], "kind string, source string, lang string, version string, n_tokens bigint, old_n_tokens bigint")
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit("odd", odd)


def test_the_query_is_that_of_a_loop_over_documents(spark, edge_docs, tmp_path):
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in token_counts.op9_token_counts(spark, str(tmp_path)).collect()}
    want = Counter()
    for version in ("byte_bpe_50k", "word_bpe_49k"):
        tokenizer = encoder(default_path(f"{version}.json")).tokenizer
        for r in edge_docs.collect():
            if n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids):
                want[r.source, r.lang, version, "docs"] += 1
                want[r.source, r.lang, version, "tokens"] += n + 1
    assert got == {k[:3]: (n, want[*k[:3], "tokens"]) for k, n in want.items() if k[3] == "docs"}
