import numpy as np

from netweave.llm import permutation_index as p


def brute(ids, vectors, k, every):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(1))
            out[i] = sorted((x, j) for x, j in zip(d, ids, strict=True) if j != i)[:k]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score string")
    want = brute(range(3000), vectors.astype(float), 10, 100)
    hits = n = 0
    got = {}
    for x in p.search(df, "vec_id", "embedding").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.score, x.vec_id))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        assert all(abs(s - np.sqrt(((vectors[q].astype(float) - vectors[v]) ** 2).sum())) < 1e-12 for _, s, v in found)
        hits += len({v for _, _, v in found} & {v for _, v in want[q]})
        n += 10
    assert len(got) == 30 and hits / n >= 0.95


def test_odd_rows(spark):
    bad = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (None, [1.0, 1.0]), (700, [1.0, 2.0, 3.0])]
    good = [(i, [1.0, 2.0]) for i in range(0, 1500, 3)] + [(1, [1.5, 2.0]), (2, [9.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")
    got = {}
    for x in p.search(df, "vec_id", "embedding").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == set(range(0, 1500, 300))
    for q, found in got.items():
        assert sorted(found) == [(i + 1, v, 0.0) for i, v in enumerate([v for v in range(0, 36, 3) if v != q][:10])]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(x.query_id, x.rank, x.vec_id) for x in p.search(few, "vec_id", "embedding").collect()] == [(0, 1, 1)]
    assert p.search(few.limit(0), "vec_id", "embedding").count() == 0
    assert p.search(few.filter("vec_id = 1"), "vec_id", "embedding").count() == 0


def test_footrule():
    r = np.random.default_rng(1)
    pivots, vectors = r.normal(size=(20, 8)), r.normal(size=(50, 8))
    files = p.Shard(np.arange(50), vectors, pivots, 6)
    order = p.permutations(vectors, pivots, 6)
    place = np.full((50, 20), 6)
    np.put_along_axis(place, order, np.arange(6)[None, :], 1)
    whole = np.abs(place - place[7]).sum(1)
    least = files.footrule(order[7])
    assert np.allclose(least - least[7], whole - whole[7])
