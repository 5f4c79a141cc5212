import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evispark.llm import token_output
from evispark.llm.common import fresh_path
from evispark.llm.tokens import default_path, encoder

PATH = default_path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_round_trip(ids, block):
    words, starts = token_output.encode(np.array(ids, np.uint64), block)
    assert token_output.decode(words, starts, len(ids), block).tolist() == ids


def _greedy_selectors(ids):
    """Word by word, the selector that holds the most of the ids that come next; None for an escape and its literal."""
    out, at, bits = [], 0, [int(x).bit_length() for x in ids]
    while at < len(ids):
        fits = [s for s, (c, b) in enumerate(zip(token_output.COUNTS, token_output.BITS)) if max(bits[at : at + c]) <= b]
        out += fits[:1] or [None, None]
        at += int(token_output.COUNTS[fits[0]]) if fits else 1
    return out


def test_every_word_holds_the_most_ids_and_all_selectors_occur():
    rng = np.random.default_rng(4)
    seen = set()
    for _ in range(60):
        runs = [np.zeros(rng.integers(1, 260), np.uint64) if b == 0 else rng.integers(0, 1 << b, rng.integers(1, 130), dtype=np.uint64) for b in rng.integers(0, 63, 12)]
        ids, block = np.concatenate(runs), int(rng.integers(50, 3000))
        words, _ = token_output.encode(ids, block)
        want = [s for a in range(0, len(ids), block) for s in _greedy_selectors(ids[a : a + block])]
        assert len(words) == 8 * len(want)
        seen |= set(want)
    assert seen >= set(range(16))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 70000), st.integers(2**59, 2**64 - 1)), max_size=60), max_size=6), st.booleans())
def test_many_documents_at_once(docs, small):
    docs = [np.array([x % 70000 if small else x for x in d], np.uint64) for d in docs]
    coded = token_output.encode_many(docs, 24)
    assert coded == [token_output.encode(d, 24) for d in docs]
    got = token_output.decode_many([w for w, _ in coded], [b for _, b in coded], np.array([len(d) for d in docs]), 24)
    assert [x.tolist() for x in got][: len(docs)] == [d.tolist() for d in docs]


def test_words_by_hand():
    words, starts = token_output.encode(np.full(24, 31, np.uint64))
    assert np.frombuffer(words, "<u8").tolist() == [(6 << 60) | ((1 << 60) - 1)] * 2 and starts == [0]
    sixty_ones = np.array([(2 << 60) | ((1 << 60) - 1), 0], "<u8").tobytes()  # then 240 zeros
    assert token_output.decode(sixty_ones, [0], 300, 300).tolist() == [1] * 60 + [0] * 240


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. ,'sétS\n\t\x01  Σ9-́"), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = encoder(default_path(name))
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_give_back_every_document(spark, edge_docs):
    path = fresh_path(spark, "test-ids")
    token_output.write_ids(edge_docs, path, PATH, shards=3)
    rows = token_output.read_ids(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(PATH)
    docs = sorted(edge_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    assert [r.doc_id for r in rows] == [r.doc_id for r in docs]
    start = 0
    for row, doc in zip(rows, docs):
        ids = np.array(tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_documents(spark, no_docs):
    path = fresh_path(spark, "test-ids")
    token_output.write_ids(no_docs, path, PATH)
    assert token_output.read_ids(spark, path).count() == 0
