import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evispark.llm import packing
from evispark.llm.tokens import default_path

PATH = default_path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=40))
def test_plan_uses_every_length_once_and_fits(counts):
    plan = packing.plan_sequences(counts, 40)
    used = Counter()
    for contents, times in plan:
        assert times > 0 and sum(x * k for x, k in contents) <= 40
        for x, k in contents:
            used[x] += k * times
    assert used == Counter(counts)
    total = sum(x * n for x, n in counts.items())
    sequences = sum(t for _, t in plan)
    assert sequences >= -(-total // 40)
    assert sequences <= -(-total * 2 // 40) + 1


def _filled(counts, length, capacity):
    """Whether up to three of the other lengths fill the gap beside one of `length`, by trying all."""
    left = Counter(counts) - Counter([length])
    gap = capacity - length
    for n in range(4):
        for more in combinations_with_replacement(sorted(left), n):
            if sum(more) == gap and not Counter(more) - left:
                return True
    return False


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 4), min_size=1, max_size=14), st.lists(st.integers(0, 1000), max_size=25))
def test_complements_are_found_while_counts_fall(counts, steps):
    left = np.zeros(25, np.int64)
    for x, n in counts.items():
        left[x] = n
    index = packing._Complements(left)
    for step in [0, *steps]:
        have = np.flatnonzero(left)
        if not len(have):
            break
        for length in have.tolist():
            found = index.fill(length)
            assert (found is not None) == _filled({int(x): int(left[x]) for x in have}, length, 24)
            assert found is None or (length + sum(found) == 24 and not Counter(found) - (Counter({int(x): int(left[x]) for x in have}) - Counter([length])))
        left[have[step % len(have)]] -= 1


def test_exact_complements_leave_no_gap():
    plan = packing.plan_sequences({30: 4, 10: 1, 6: 3, 4: 3, 5: 1, 3: 1, 2: 1}, 40)
    assert sum(t for _, t in plan if sum(x * k for x, k in _) == 40) >= 4


def test_documents_are_packed_whole(spark, edge_docs):
    out = packing.pack_documents(edge_docs, PATH).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in edge_docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want[(r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = Counter((None if r.doc_id is np.nan or r.doc_id != r.doc_id else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.astype(object).where(out.notna(), None).itertuples())
    assert got == want
    by = defaultdict(list)
    for r in out.itertuples():
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_no_documents(spark, no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_ranks_of_a_hot_length_are_distinct(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 50)
    docs = spark.range(400).selectExpr("id AS doc_id", "'same text' AS text")
    out = packing.pack_documents(docs, PATH, capacity=16).toPandas()
    assert len(out) == 400 and not out.duplicated(["sequence_id", "offset"]).any()


