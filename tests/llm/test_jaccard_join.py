import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import jaccard_join as j


def _slow(rows):
    sets = []
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for i, (k, _) in enumerate(rows):
        low.setdefault(find(i), []).append(k)
    return sorted((k, len(s), min(low[find(i)])) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def _rows(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeF") for _ in range(rng.randint(2, 6)))
    bases = [[word() for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 15, 30, 90]))] for _ in range(25)]
    passage = [word() for _ in range(20)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(max(1, len(w)))
            w[i : i + 1] = rng.choice([[], [word()], [word(), *w[i : i + 1]]])
        if rng.random() < 0.2:
            w += passage
        rows.append((k, rng.choice([" ", "\t", " \n"]).join(w)))
    return rows


@pytest.mark.parametrize("seed,long_list,sample", [(1, 64, 20_000), (2, 3, 20_000), (3, 1, 10)])
def test_components_are_those_of_all_pairs(spark, seed, long_list, sample, monkeypatch):
    monkeypatch.setattr(j, "LONG_LIST", long_list)
    monkeypatch.setattr(j, "BLOCK", 4 if long_list == 1 else 1024)
    monkeypatch.setattr(j, "SAMPLE", sample)
    monkeypatch.setattr(j, "HOT", 3 if seed == 2 else 100)
    rows = _rows(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == _slow(rows)


def test_light_and_heavy_agree(spark, monkeypatch):
    rows = [(k, " ".join("abcdefghijklmnop"[: 5 + k % 9]) + (" z" if k % 2 else "")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for light in (0, 4, 9, 12):
        monkeypatch.setattr(j, "choose_light", lambda *a, light=light: light)
        assert sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == _slow(rows)


def test_costs_choose_the_bound():
    assert j.choose_light({5: 10}, 10**6) <= 12
    assert j.overlap(4, 5) == 4 and j.prefix(10) == 3


def test_edges(spark, edge_docs, no_docs):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in j.join_components(edge_docs).collect())
    assert len(got) == edge_docs.count()
    by = {g[1]: g for g in got if g[0]}
    assert by[1][3] == 1 and by[6][3] == 1 and by[2][2:] == (0, 2) and by[3][2:] == (0, 3) and by[4][2:] == (1, 4)
    kept = j.keep_one_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x)) == [None, 1, 2, 3, 4, 5]
    same_id = spark.createDataFrame([(7, "one text here"), (7, "another text there"), (7, "one text here"), (8, "one text here")], "doc_id bigint, text string")
    assert sorted(r.text for r in j.keep_one_each(same_id).collect()) == ["another text there", "one text here"]
    assert j.join_components(no_docs).count() == 0 and j.keep_one_each(no_docs).count() == 0


@pytest.mark.parametrize("light", [0, 3, 4, 5, 8, 12])
def test_long_texts_of_few_shingles_are_light(spark, light, monkeypatch):
    monkeypatch.setattr(j, "choose_light", lambda *a: light)
    texts = []
    for words in (4, 8, 10, 12, 13):
        phrase = " ".join(f"w{words}x{i}" for i in range(words)) + " "
        texts += [phrase * 100, phrase * 70 + "q", phrase * 60 + "q r"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == _slow(rows)


def test_a_long_list_of_many_clusters_and_sizes(spark, monkeypatch):
    for name, value in {"LONG_LIST": 8, "BLOCK": 6, "MEMBERS": 7, "HOT": 20}.items():
        monkeypatch.setattr(j, name, value)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = [word() for _ in range(14)]
    bases = [[word() for _ in range(n)] for n in (3, 4, 6, 9, 14, 20, 40)]
    rows = []
    for k in range(160):
        w = passage + rng.choice(bases)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w + [word() for _ in range(rng.randrange(3))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == _slow(rows)


def test_states_by_whole_numbers():
    for n in range(1, 30):
        for m in range(n, 30):
            for common in range(n + 1):
                share = common / (n + m - common)
                assert j._state(common, n, m) == (0 if share >= 0.8 - 1e-12 else 1 if share >= 0.6 - 1e-12 else 2)


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(5)
    rows, most = [], []
    for n in (1, 2, 40, 60, 70, 127, 128, 129, 600, 1030):
        for kept in (n, n - n // 10, n // 3):
            a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
            more = rng.integers(1, 1 << 62, max(0, int(n * 1.2) - kept), dtype=np.uint64)
            b = np.unique(np.concatenate([a[:kept], more]))
            rows.append((len(most), j.sketch(a).tolist(), j.sketch(b).tolist()))
            most.append(len(np.setxor1d(a, b)))
    found = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>").select("i", j._bits_apart(F.col("a"), F.col("b")).alias("n"))
    apart = {r.i: r.n for r in found.collect()}
    assert all(apart[i] <= m for i, m in enumerate(most)) and apart[0] == 0 < sum(apart.values())


def test_texts_of_sets_that_meet_by_chance_are_not_sent(spark, monkeypatch):
    for name, value in {"SAMPLE_COUNT": 10**6, "LONG_LIST": 100}.items():  # a sample that tells no shingle, as in large tables
        monkeypatch.setattr(j, name, value)
    rng = random.Random(3)
    rows = []
    for k in range(80):  # frequent words in fives, between words of their own
        words = []
        for i in range(12):
            words += [rng.choice("ab") for _ in range(9)] + [f"w{k}x{i}"]
        rows.append((k, " ".join(words)))
    rows.append((80, rows[0][1] + " z"))
    sent, roles_of = [], j._verified
    monkeypatch.setattr(j, "_verified", lambda docs, sets, roles: sent.append(roles.count()) or roles_of(docs, sets, roles))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == _slow(rows)
    assert sent[0] == 2  # the pair that is linked


def test_texts_that_nothing_asks_for_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(j, "BROADCAST_ROWS", 0)  # as in large tables
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " z") for k in range(5)] + [(400, rows[7][1]), (400, rows[7][1]), (401, "a b"), (401, "a b"), (402, None), (403, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("extra", F.col("doc_id") * 2).repartition(3)
    assert sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=lambda r: (r[0], r[1])) == _slow(rows)
    asked = docs.where("doc_id < 10").select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("t"))
    keyed = docs.withColumn("_k", F.col("doc_id")).withColumn("_t", F.xxhash64("text"))
    assert keyed.where(j._may_be_among(asked)("_k", "_t")).count() <= 12
    kept = j.keep_one_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(300), 401, 402, 403]
    assert all(r.extra == 2 * r.doc_id for r in kept.collect())


def test_counts_come_to_the_driver_as_columns(spark, no_docs, monkeypatch):
    docs = spark.createDataFrame([(k, "one two three four five six " + "abcde"[k % 5]) for k in range(20)], "doc_id bigint, text string")
    for name in ("collect", "toPandas"):  # an object for each row
        monkeypatch.setattr(type(docs), name, None)
    names, counts = j.frequent_shingles(docs, 20)
    assert sorted(counts.tolist()) == [4] * 5 + [20] * 2 and (np.diff(names.astype(float)) > 0).all()
    weights = j.word_weights(docs, 20)
    assert sorted(weights[weights > 0].tolist()) == [16] * 5 + [35] * 6
    assert not len(j.frequent_shingles(no_docs, 0)[0]) and not j.word_weights(no_docs, 0).any()
    taken = j._may_be_among(docs.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("t")).where("k < 7"))
    assert 7 <= docs.where(taken("doc_id", F.xxhash64("text"))).count() <= 8


def test_texts_of_a_long_list_that_sets_share_by_chance_are_not_sent(spark, monkeypatch):
    for name, value in {"SAMPLE_COUNT": 10**6, "LONG_LIST": 8}.items():
        monkeypatch.setattr(j, name, value)
    monkeypatch.setattr(j, "word_weights", lambda *a: np.zeros(j.WORD_PLACES, np.int16))  # the order is that of names
    shares = (f"a b c d p{i}" for i in range(1000))
    passage = next(p for p in shares if 0.14 < int(j.shingles(p)[0]) / 2**64 < 0.16)  # late in the prefix of most sets
    rows = [(k, " ".join([passage, *(f"w{k}x{i}" for i in range(100))])) for k in range(80)]
    rows.append((80, rows[0][1] + " z"))
    sent, roles_of = [], j._verified
    monkeypatch.setattr(j, "_verified", lambda docs, sets, roles: sent.append(roles.count()) or roles_of(docs, sets, roles))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, j.join_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == _slow(rows)
    assert sum(sent) < 40  # the pair that is linked, and the few sets that hold it early


@pytest.mark.parametrize("n_long", [1, 40])
def test_pairs_left_of_a_crowded_list_are_all_that_may_link(spark, n_long, monkeypatch):
    monkeypatch.setattr(j, "LONG_LIST", 20)
    rng = random.Random(n_long)
    members = []
    for s in range(n_long):
        for v in rng.sample(range(1000), 600 if n_long == 1 else rng.choice([25, 70])):
            n = rng.choice([20, 100, rng.randrange(1, 2000)])
            members.append((s, v, n, j.prefix(n) - 1 if rng.random() < 0.9 else rng.randrange(j.prefix(n))))
    lists = spark.createDataFrame([(*m, 99) for m in members], "s bigint, v bigint, n int, pos int, size long")
    got = j._crowded(lists, 3).collect()
    named = {(r.u, r.v) for r in got if not r.many}
    groups = {}
    for r in got:
        if r.many:
            groups.setdefault(r.u, {r.u}).add(r.v)
    links = set()
    for s in range(n_long):
        here = [m[1:] for m in members if m[0] == s]
        for a, x in enumerate(here):
            for y in here[:a]:
                (v, n, p), (w, m, q) = x, y
                if v != w and max(n, m) > 3 and 100 * min(n, m) >= 80 * max(n, m) and min(n - p, m - q) >= j.overlap(n, m):
                    links.add((min(v, w), max(v, w)))
    assert links and named <= links
    assert all(pair in named or any(set(pair) <= g for g in groups.values()) for pair in links)
