import hashlib
import random

import pytest

from evispark.llm import suffix_dedup


def _slow(rows):
    """rows: doc_id, text in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def _texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    passage, base = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(120))
    rows = []
    for k in range(40):
        kind = rng.randrange(8)
        w = base.split()
        if kind == 0:
            text = base
        elif kind == 1:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 2:
            text = " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20))
        elif kind == 3:
            text = ("ab" * rng.randint(30, 200)) + passage[5:]
        elif kind == 4:
            text = "a" * rng.randint(90, 300) + rng.choice("xy") + "a" * 150
        elif kind == 5:
            text = base[rng.randrange(300) :] + base[: rng.randrange(400)]
        elif kind == 6:
            text = word() * rng.randint(10, 60)
        else:
            text = " ".join(word() for _ in range(rng.randint(1, 100)))
        rows.append((k, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_result_is_that_of_a_set_of_all_strings(spark, seed, monkeypatch):
    if seed == 3:  # every anchor of several segments is hot
        monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
        monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rows = _texts(seed)
    docs = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    assert got == _slow(rows)


def test_segments_hold_every_string_once():
    for _, text in _texts(9):
        data = text.encode()
        f, s, at, n, near = suffix_dedup.segments(data)
        covered = sorted(x for a, m in zip(at, n) for x in range(a, a + m))
        assert covered == list(range(max(0, len(data) - 99)))


def test_edges(spark, edge_docs, no_docs):
    long = "no other row has this text, which is a little longer than a hundred bytes, so that it can be found again. "
    extra = spark.createDataFrame([(None, long, *[None] * 3, *["c"] * 10), (7, long, *[None] * 3, *["c"] * 10), (7, long, *[None] * 3, *["c"] * 10), (7, "x" + long, *[None] * 3, *["c"] * 10)], edge_docs.schema)
    got = suffix_dedup.remove_repeats(edge_docs.unionByName(extra)).collect()
    assert len(got) == edge_docs.count() + 4
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id == 7) == [(106, 106), (106, 106), (107, 106)]
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot", [64, 2])
def test_a_repeated_row_keeps_its_first_copy(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    base = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(80))
    rows = [(7, base), (7, base), (8, base[:300] + "x" + base[300:]), (9, "y" + base[100:350])]
    expected = sorted(_slow(rows))
    assert [r[2] for r in expected if r[0] == 7] == [0, len(base)]
    one = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(one).collect())) == expected
    parts = [spark.createDataFrame([r], "doc_id bigint, text string").coalesce(1) for r in rows]
    apart = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert sorted(map(tuple, suffix_dedup.remove_repeats(apart).collect())) == expected
