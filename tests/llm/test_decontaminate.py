import random

import numpy as np

from evispark.llm import decontaminate as d


def _slow(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
    return max(map(max, h))


def test_alignment_score_is_that_of_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        assert d.align(a, b)[0] == _slow(a, b)


def _corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)]
    docs = []
    for k in range(60):
        body = [word() for _ in range(80)]
        if k % 10 == 1:  # a copy of an item
            body[20:20] = items[0][1].split()
        if k % 10 == 2:  # an edited one
            w = items[1][1].split()
            for i in range(4, 30, 6):
                w[i] = word()
            del w[11]
            body[40:40] = w
        if k % 10 == 3:  # a third of another, as for all documents
            body[0:0] = items[2][1].upper().split()[:10]
        docs.append((k, " ".join(body)))
    return items, docs


def test_copies_and_edits_are_found_and_clean_documents_left_alone(spark):
    items, docs = _corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_contaminated(frame, bench).collect()}
    want = {(k, k % 10 - 1) for k in range(60) if k % 10 in (1, 2, 3)}
    assert got == want
    kept = {r.doc_id for r in d.drop_contaminated(frame, bench).collect()}
    assert kept == {k for k in range(60)} - {k for k, _ in want}


def test_items_may_come_in_blocks(spark, monkeypatch):
    items, docs = _corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, d.find_contaminated(frame, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_WORDS", 60)
    assert sorted(map(tuple, d.find_contaminated(frame, bench).collect())) == whole


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "The QUICK brown fox, jumps over the lazy dog!"), (2, None), (3, ""), (4, "a word"), (None, "word word word word word word word word word")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_contaminated(edge_docs, bench).collect()}
    assert got == {(1, 1), (6, 1), (4, None)}
    kept = d.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, None, 5}
    assert d.find_contaminated(no_docs, bench).count() == 0 and d.find_contaminated(edge_docs, bench.where("false")).count() == 0


def test_one_common_seed_is_enough(spark):
    edited = "aa bb cc d1 e1 ff gg x2 hh ii y3 jj kk".replace("x2", "x9").replace("y3", "y9")
    rows = [(k, "filler words before red green blue and after") for k in range(60)] + [(100 + k, f"n{k} aa bb cc n{k}") for k in range(60)] + [(500, edited)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "red green blue"), (2, "aa bb cc d1 x2 ff gg y3 hh ii z4 jj kk")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_contaminated(docs, bench).collect()}
    assert got == {(k, 1) for k in range(60)} | {(500, 2)}
    assert {r.doc_id for r in d.drop_contaminated(docs, bench).collect()} == {100 + k for k in range(60)}


def test_pairs_are_those_of_aligning_every_document_to_every_item(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 6, 12, 25])))) for k in range(12)]
    docs = []
    for k in range(80):
        w = [word() for _ in range(rng.randint(5, 90))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(1 + len(part) // 8)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(w))
            w[at:at] = part
        docs.append((k, " ".join(w)))
    want = set()
    for doc_id, text in docs:
        for item_id, item in items:
            own, whole = item.split(), text.split()
            code = {x: n + 1 for n, x in enumerate(dict.fromkeys(own))}
            coded, passage = np.array([code[x] for x in own]), np.array([code.get(x, 0) for x in whole])
            _, matched, columns = d.align(coded, passage)
            if d.contaminates(len(own), matched, columns):
                want.add((doc_id, item_id))
    found = d.find_contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 20


def test_passages_that_no_alignment_can_save_are_not_aligned(spark, monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(300):
        item, passage = rng.integers(1, 9, rng.integers(3, 30)), rng.integers(0, 9, rng.integers(0, 50))
        table = [0] * (len(passage) + 1)
        for a in item:
            before = table
            table = [0]
            for k, b in enumerate(passage):
                table.append(before[k] + 1 if a == b else max(before[k + 1], table[k]))
        assert d.longest_common(item.tolist(), passage.tolist()) == table[-1] >= d.align(item, passage)[1]
    item, out_of_order = np.arange(1, 31), np.concatenate([np.arange(26, 31), np.arange(1, 6)])
    assert not d.worth_aligning([0, 1], np.array([True, True]), item, out_of_order)
    assert d.worth_aligning([0, 1], np.array([True, True]), item, np.arange(4, 12))
