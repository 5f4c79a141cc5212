import random
from collections import defaultdict

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    rows, labels = [], []
    for k in range(400):
        t = text(60)
        if k % 4 == 1:
            t += " stupid moron"
        rows.append([k, t])
        if k < 300:
            labels.append((k, 1, int(k % 4 == 1)))
    rows[302][1] = rows[300][1]
    rows[304][1] = rows[300][1] + " more"
    rows[306][1] += " " + item
    rows[308][1] += " a.b@c.de +1 (216) 555-1810"
    rows[310][1] = None
    rows[312][1] = ""
    folder = str(tmp_path_factory.mktemp("world"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_every_stage_decides(spark, world):
    docs = spark.read.parquet(f"{world}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, world)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id for r in docs.collect()})
    clean = {k for k in range(400) if k % 4 != 1}
    assert kept[0] == clean
    assert kept[1] == clean - {302, 304}
    assert kept[2] == clean - {302, 304, 306} == kept[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[308].endswith("<email> <phone>") and texts[310] is None and texts[312] == ""


def test_run_packs_what_is_kept(spark, world):
    out = corpus_pipeline.run(spark, world).collect()
    assert {r.doc_id for r in out} == {k for k in range(400) if k % 4 != 1} - {302, 304, 306}
    by = defaultdict(int)
    for r in out:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096 and len(by) <= sum(by.values()) // 4096 + 2


def _world(spark, folder, rows, labels=(), items=()):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, _world(spark, tmp_path, [])).count() == 0


def test_nulls_repeats_and_long_texts_without_labels_or_items(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(9000))
    rows = [(None, None, None, None, None), (None, "of no number", "en", "s", 12), (1, "", "en", "s", 0), (2, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, long, None, "s", 1), (4, "x", "en", "s", 1), (4, "y", "en", "s", 1)]
    out = corpus_pipeline.run(spark, _world(spark, tmp_path, rows, [(None, 1, 1), (2, 1, None)], [(1, None), (None, "")])).collect()
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r.length)
    assert sorted(pieces, key=str) == [1, 2, 4, None] and pieces[1] == [1] and len(pieces[4]) == len(pieces[None]) == 2
    assert len(pieces[2]) > 1  # of the three equal texts one is left, in pieces


def test_extra_columns_stay(spark, tmp_path):
    folder = _world(spark, tmp_path, [(k, f"some words of number {k} here", "en", "s", 9) for k in range(6)])
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS toxic", "'c' AS root", "2 AS score", "'v' AS v", "3 AS k", "'i' AS item_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 6
        docs = out
