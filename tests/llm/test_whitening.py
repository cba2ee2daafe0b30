import math

import numpy as np

from netweave.llm import whitening as w


def test_limbs_and_products_are_exact():
    r = np.random.default_rng(1)
    for top in (1, 1 << 19, (1 << 19) + 1, 1 << 40, 1 << 62):
        x = r.integers(-top, top, (300, 5))
        x[0] = [-top, top - 1, 0, -1, 1]
        parts = w.limbs(x)
        assert all(np.abs(p).max() <= 1 << (w.LIMB - 1) for p in parts)
        assert (sum(p.astype(np.int64).astype(object) << (w.LIMB * k) for k, p in enumerate(parts)) == x).all()
        big = x.astype(object)
        assert (w.exact_gram(x) == big.T @ big).all() and (w.exact_sums(x) == big.sum(0)).all()
    old, w.BLOCK = w.BLOCK, 7
    assert (w.exact_gram(x) == big.T @ big).all()
    w.BLOCK = old


def brute(rows, components, scale=64, offset=1_000_000):
    """By dimension: (n, deviations, whitened up to signs, explained)."""
    out = {}
    for dim in {len(v) for _, v in rows}:
        own = [(i, v) for i, v in rows if len(v) == dim]
        x = np.array([[math.floor(scale * c) + offset for c in v] for _, v in own], object)
        n, s = len(x), x.sum(0)
        centred = ((n * x - s) / n).astype(float)
        cover = np.array([int(c) / n**3 for c in ((n * x - s).T @ (n * x - s)).ravel()]).reshape(dim, dim)
        values, vectors = np.linalg.eigh(cover)
        order = np.argsort(-values)[:components]
        order = order[values[order] > dim * 2.0**-52 * max(values.max(), 0)]
        out[dim] = own, ((n * x - s) ** 2).sum(1), np.abs(centred @ vectors[:, order] / np.sqrt(values[order])), values[order] / values.sum() if len(order) else []
    return out


def rows_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.vec_id, r.n, r.deviation), {}).setdefault(r.component, []).append(r)
    return found


def test_whitening(spark):
    r = np.random.default_rng(2)
    data = (r.normal(size=(500, 12)) * np.arange(1, 13) + r.normal(size=12) * 100).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += rows[:40]  # repeated rows count each
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, n string, component int").repartition(7)
    got = w.whiten(df, "vec_id", "embedding", components=8)
    own, deviations, whitened, explained = brute(rows, 8)[12]
    found = got.collect()
    assert len(found) == len(rows) * 8 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len({x.identity_error for x in found}) == 1 and found[0].identity_error < 1e-9
    place = {i: k for k, (i, _) in enumerate(own)}
    for x in found:
        k = place[x.vec_id]
        assert x.n == len(rows) and x.deviation == deviations[k]
        assert abs(abs(x.whitened) - whitened[k][x.component - 1]) < 1e-9 and abs(x.explained - explained[x.component - 1]) < 1e-12
    one = {c: {x.vec_id: x.whitened for x in found if x.component == c} for c in (1, 8)}
    assert all(abs(sum(one[c][i] for i, _ in rows)) < 1e-8 for c in one)  # one sign for all rows
    again = {(x.vec_id, x.component): x.deviation for x in w.whiten(df.repartition(2), "vec_id", "embedding", components=8).collect()}
    assert again == {(x.vec_id, x.component): x.deviation for x in found}


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert w.whiten(make([]), "vec_id", "embedding").count() == 0
    assert w.whiten(make([(1, [1.0, 2.0])]), "vec_id", "embedding").count() == 0  # one row alone has no variance
    two = w.whiten(make([(1, [0.0, 0.0]), (None, [1.0, 0.0])]), "vec_id", "embedding").collect()
    assert sorted((x.vec_id or 0, x.component, x.n, x.deviation, abs(round(x.whitened, 9)), x.explained) for x in two) == [(0, 1, 2, 64**2, 1.0, 1.0), (1, 1, 2, 64**2, 1.0, 1.0)]
    mixed = w.whiten(make([(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 1.0]), (6, [float("nan")])]), "vec_id", "embedding").collect()
    assert sorted((x.vec_id, x.component, x.n) for x in mixed) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (3, 2, 3), (4, 1, 3), (4, 2, 3), (5, 1, 3), (5, 2, 3)]
    far = w.whiten(make([(1, [3e9]), (2, [-3e9]), (3, [0.0])]), "vec_id", "embedding").collect()  # beyond a long: null
    assert [x.deviation is None for x in sorted(far, key=lambda x: x.vec_id)] == [False, False, False] or all(x.identity_error < 1e-9 for x in far)
