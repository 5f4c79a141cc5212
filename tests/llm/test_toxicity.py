import os
import zlib

import numpy as np

from evispark.llm import toxicity


def test_a_pair_of_terms_can_mean_more_than_both():
    rng = np.random.default_rng(1)
    a, b = (int(toxicity.terms(w)[0]) for w in ("rude", "group"))
    rows, labels = [], []
    for _ in range(1200):
        has = rng.random(2) < 0.5
        rows.append(np.array([t for t, h in zip((a, b), has) if h], np.int32))
        labels.append(int(has.all()))
    machine = toxicity.fit(rows, np.array(labels), epochs=40)
    both, one, other = machine.score([np.array([a, b], np.int32), np.array([a], np.int32), np.array([b], np.int32)])
    assert both > 0.5 > max(one, other)


def test_rare_terms_that_are_harmless_alone_are_learned_as_a_pair():
    rng = np.random.default_rng(3)
    a, b, rows, labels = 5, 9, [], []
    for _ in range(16_000):
        row = set((rng.zipf(1.3, 40) % 3000 + 100).tolist())
        row |= {t for t in (a, b) if rng.random() < 0.05}
        toxic = {a, b} <= row
        if rng.random() < 0.072:  # other toxic texts
            toxic = True
            row.add(50 + int(rng.integers(0, 8)))
        rows.append(np.array(sorted(row), np.int32))
        labels.append(int(toxic))
    machine = toxicity.fit(rows, np.array(labels))
    both, one, other, plain, plainly = machine.score([np.array(x, np.int32) for x in ([a, b], [a], [b], [], [52])])
    assert both > 0.9 and plainly > 0.8 and max(one, other, plain) < 0.1


def test_scores_are_those_of_a_loop_over_pairs():
    rng = np.random.default_rng(8)
    machine = toxicity.Machine(-0.4, rng.normal(size=40).astype(np.float32), rng.normal(size=(40, toxicity.FACTORS)).astype(np.float32), rng.random(40) < 0.7)
    rows = [np.sort(rng.choice(40, n, replace=False)).astype(np.int32) for n in (0, 1, 2, 5, 17, 40)]
    for row, got in zip(rows, machine.score(rows)):
        used = [t for t in row if machine.used[t]]
        z = machine.bias + sum(float(machine.weight[t]) for t in used)
        z += sum(float(machine.vector[s].astype(float) @ machine.vector[t]) for k, s in enumerate(used) for t in used[k + 1 :])
        assert abs(got - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5


def test_every_document_is_scored_and_held_out_rows_are_predicted(spark):
    rows = [(k, f"plain words {'stupid' if k % 3 == 0 else 'kind'} here {k}", int(k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    out = toxicity.score_documents(docs, toxicity.learn(docs, labels)).toPandas().sort_values("doc_id")
    assert out.toxic_predicted.tolist() == [r[2] for r in rows]


def _labelled(spark):
    rows = [(k, f"plain words {'stupid' if k % 3 == 0 else 'kind'} here {k}", int(k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return rows, docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_the_driver_holds_no_rows_to_learn_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: toxicity.Machine(float(os.getpid()), *[np.zeros(s, k) for s, k in ((9, np.float32), ((9, 8), np.float32), (9, bool))]))
    assert toxicity.learn(*_labelled(spark)[1:]).bias not in (0, os.getpid())


def test_what_is_learned_is_what_fit_gives(spark):
    rows, docs, labels = _labelled(spark)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    want, got = toxicity.fit([toxicity.terms(r[1]) for r in known], np.array([r[2] for r in known])), toxicity.learn(docs, labels)
    assert want.used.any() and want.bias == got.bias
    assert all((getattr(want, c) == getattr(got, c)).all() for c in ("weight", "vector", "used"))


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1)], "doc_id bigint, toxic int")
    machine = toxicity.learn(edge_docs, labels)
    out = toxicity.score_documents(edge_docs, machine, "source").collect()
    assert len(out) == edge_docs.count() and all(0 <= r.toxic_score <= 1 for r in out)
    assert toxicity.score_documents(no_docs, toxicity.learn(no_docs, labels)).count() == 0
