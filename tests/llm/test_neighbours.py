import numpy as np
from pyspark.sql import functions as F

from evispark.llm import neighbours


def _table(spark, m, ids=None):
    rows = [(int(i), [float(x) for x in v] if v is not None else None, 0, "clash") for i, v in zip(ids if ids is not None else range(len(m)), m)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, list string")


def _search(table, k=10, probes=None):
    index = neighbours.build(table, k)
    index.probes = probes or index.probes
    v = F.col("embedding").cast("array<double>")
    asked = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), v.alias("v")).where(neighbours.usable(F.col("v")) & (F.size("v") == index.dimensions))
    return neighbours.search(index, asked)


def _exact(table, k):
    rows = [r for r in table.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    out = {}
    for q in np.unique(ids[ids % 100 == 0]):
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        out[int(q)] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def _recall(table, **more):
    want, got = _exact(table, 10), {}
    for r in _search(table, **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    return hits / sum(map(len, want.values())), want, got


def _clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    return _table(spark, np.concatenate([centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 32)), np.tile(centres[:1], (200, 1))]))


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 100)
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    recall, want, got = _recall(_clustered(spark))
    assert recall >= 0.95
    hot = [q for q in want if q >= 3000]  # of 200 equal vectors, those of smallest id
    for q in hot:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_lists_that_grow_are_divided(spark, monkeypatch):
    for name, value in {"LIST": 100, "LISTS": 3, "SPLIT": 300, "DEAL": 256, "CHUNK": 64}.items():
        monkeypatch.setattr(neighbours, name, value)
    table = _clustered(spark)
    index = neighbours.build(table)
    cells = index.cells.toPandas()
    assert 1 < index.probes < len(cells)
    assert cells["list"].nunique() == 3 and len(cells) > 20 and cells.n.sum() == 3011
    recall, _, _ = _recall(table)
    assert recall >= 0.9


def test_few_candidates_repeated_ids_and_small_samples(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 2)
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 16 * 40)
    m = np.random.default_rng(6).normal(size=(60, 2)) * np.arange(1, 61)[:, None] ** 2
    recall, want, got = _recall(_table(spark, m), probes=1)
    assert all(len(x) == 10 for x in got.values())
    recall, _, got = _recall(_table(spark, m[:6]), probes=1)
    assert recall == 1 and len(got[0]) == 5
    repeated = _table(spark, [[1.0, 0.0], [0.0, 3.0], [1.0, 0.0], [4.0, 0.0], [4.0, 0.0]], [100, 100, 7, 200, 200])
    rows = [tuple(r) for r in _search(repeated).collect()]
    assert len(rows) == 16  # every row is a query, and a candidate of all others
    assert sorted(v for q, _, v, s in rows if q == 200) == [7, 7, 100, 100, 100, 100, 200, 200]
    assert sorted(v for q, _, v, s in rows if q == 100) == [7, 7, 100, 100, 200, 200, 200, 200]
    assert sum(s == 0 for *_, s in rows) == 3  # each of the two equal rows at 4, 0 to the other, and 100 to 7


def test_edges(spark):
    m = [[1.0, 0.0], [1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [2.0, 0.0], [1.0, 2.0, 3.0], [5.0, 1.0], [0.0, -0.0]]
    table = _table(spark, m, [100, 1, 2, 3, 4, 200, 6, 7, 300])
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in _search(table).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(100, 1, 1, 0.0), (100, 2, 200, 1.0), (100, 3, 7, np.sqrt(17.0))]
    assert {q for q, *_ in got} == {100, 200}
    assert _search(table.where("false")).count() == 0
    assert _search(table.where("vec_id = 100")).count() == 0


def test_blocks_give_up_far_candidates_early():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(500, 64))
    m[:20] *= 0.01
    alive, read = neighbours.scan(np.zeros(64), [m[:, a : a + 16] for a in range(0, 64, 16)], 10, 1.0)
    assert set(alive) == set(range(20)) and read < 600
