"""Nearest neighbours: recall against all pairs, merging of shards, awkward rows."""

import numpy as np

from quirefold.llm import hnsw


def exact(ids, v, k=10):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return {i: {ids[j] for j in np.argsort(-s[n], kind="stable")[:k]} for n, i in enumerate(ids)}


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.similarity))
    for near in got.values():
        near.sort()
        assert [x[0] for x in near] == list(range(1, len(near) + 1))
        assert [-x[2] for x in near] == sorted(-x[2] for x in near)
    return np.mean([len({x[1] for x in got[i]} & w) / len(w) for i, w in want.items()])


def table(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<float>")


def test_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = exact([r.vec_id for r in rows], np.array([r.embedding for r in rows]))
    got = hnsw.neighbours(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()
    assert len(got) == 10 * len(rows)
    assert recall(got, want) >= 0.9
    asked = {i: w for i, w in want.items() if i % 50 == 0}
    got = hnsw.op7_hnsw(spark, sf).collect()
    assert {r.vec_id for r in got} == set(asked) and len(got) == 10 * len(asked)
    assert recall(got, asked) >= 0.95


def test_shards_are_merged(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 16))
    got = hnsw.neighbours(table(spark, range(3000), v), shard=500).collect()
    assert recall(got, exact(list(range(3000)), v)) >= 0.9


def test_graph_is_within_bounds():
    v = np.random.default_rng(5).normal(size=(2000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g, places = hnsw.build(v)
    assert sorted(places.tolist()) == list(range(2000))
    for k, links in enumerate(g.links):
        assert links.shape[1] == (2 * hnsw.LINKS if k == 0 else hnsw.LINKS) and links.max() < len(links) and not (links == np.arange(len(links))[:, None]).any()
    again = hnsw.Graph.frombytes(g.tobytes(), 24)
    ids, sims = hnsw.search(again, v[places][:50], 1)
    assert (ids[:, 0] == np.arange(50)).all() and np.allclose(sims[:, 0], 1, atol=1e-5)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, ID long").drop("ID")
    got = hnsw.neighbours(df).orderBy("vec_id", "rank").collect()
    assert [(r.vec_id, r.neighbour_id) for r in got] == [(1, 11), (1, 2), (1, 10), (2, 1), (2, 10), (2, 11), (10, 2), (10, 1), (10, 11), (11, 1), (11, 2), (11, 10)]
    assert hnsw.neighbours(df.limit(0)).count() == 0
    assert hnsw.neighbours(df.where("vec_id = 1")).count() == 0


def test_many_equal_vectors(spark):
    v = np.tile([[1.0, 2.0, 3.0]], (300, 1))
    got = hnsw.neighbours(table(spark, range(300), v), k=5).collect()
    assert len(got) == 1500 and all(abs(r.similarity - 1) < 1e-5 and r.neighbour_id != r.vec_id for r in got)
