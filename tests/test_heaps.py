"""Many points at one place, large graphs and long networks: what is joined
follows the places, nothing of a graph is broadcast, and results stay the same."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest

from netweave.operators import components, hydraulics, placement, spatial, topology


def heaps(seed, n=160, places=25):
    rng = random.Random(seed)
    spots = [(rng.randrange(40) / 1.0, rng.randrange(40) / 1.0) for _ in range(places)]
    return [(i, *rng.choice(spots), rng.randrange(1000) / 10) for i in rng.sample(range(1000), n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "node_id long, x double, y double, v double")


def joined_rows(monkeypatch, name):
    """How many points a join by distance is given."""
    seen, real = [], getattr(spatial, name)
    monkeypatch.setattr(spatial, name, lambda one, *rest: seen.append(one.count()) or real(one, *rest))
    return seen


def test_clusters_join_places(spark, monkeypatch):
    rows = heaps(1) + [(2000, None, 1.0, 0.0), (2001, math.nan, 1.0, 0.0)]
    seen = joined_rows(monkeypatch, "radius_pairs")
    got = {r.node_id: r.cluster for r in spatial.clusters(frame(spark, rows), "node_id", 5.0).collect()}
    root = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a in rows[:-2]:
            for b in rows[:-2]:
                if math.dist(a[1:3], b[1:3]) <= 5.0 and root[a[0]] > root[b[0]]:
                    root[a[0]] = root[b[0]]
                    changed = True
    assert got == root
    assert max(seen) <= 25


def test_neighbourhood_mean_joins_places(spark, monkeypatch):
    rows = heaps(2)
    seen = joined_rows(monkeypatch, "radius_join")
    got = {r.node_id: (r.mean, r.n) for r in spatial.neighbourhood_mean(frame(spark, rows), "node_id", "v", 9.0).collect()}
    for a in rows:
        near = [b[3] for b in rows if math.dist(a[1:3], b[1:3]) <= 9.0]
        assert got[a[0]] == (float(sum(Decimal(str(v)) for v in near)) / len(near), len(near))
    assert len(got) == len(rows) and max(seen) <= 25


def test_nearest_within_joins_no_radius(spark, monkeypatch):
    rows = heaps(3)
    seen = joined_rows(monkeypatch, "radius_join")
    got = {r["query"]: (r.target, r.distance) for r in spatial.nearest_within(frame(spark, rows[:80]), frame(spark, rows[80:]), "node_id", "node_id", 4.0).collect()}
    want = {}
    for a in rows[:80]:
        d, target = min((math.dist(a[1:3], b[1:3]), b[0]) for b in rows[80:])
        if d <= 4.0:
            want[a[0]] = (target, d)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert not seen  # before, all pairs within the radius


def test_bridges_between_heaps(spark, monkeypatch):
    """The same bridges as Kruskal's over all pairs of nodes."""
    for seed in (4, 5):
        rows = heaps(seed, places=40)
        ids = sorted(r[0] for r in rows)
        rng = random.Random(seed)
        links = [(a, b) for a, b in zip(ids, ids[1:], strict=False) if rng.random() < 0.8]
        seen = joined_rows(monkeypatch, "radius_pairs")
        found = topology.bridge_islands(spark.createDataFrame(links, "node1 long, node2 long"), frame(spark, rows), 6.0).collect()
        root = {i: i for i in ids}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        sizes = {}
        for i in ids:
            sizes[find(i)] = sizes.get(find(i), 0) + 1
        largest = min(sizes, key=lambda c: (-sizes[c], c))
        gaps = sorted((math.dist(p[1:3], q[1:3]), p[0], q[0]) for p in rows for q in rows if p[0] < q[0])
        taken = []
        for d, a, b in gaps:
            if d <= 6.0 and find(a) != find(b):
                root[find(b)] = find(a)
                taken.append((a, b))
        assert sorted((r.node1, r.node2) for r in found) == sorted(t for t in taken if find(t[0]) == find(largest))
        assert max(seen) <= 40
        monkeypatch.undo()


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    assert components.connected_components(edges).groupBy("component").count().count() == 2
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_levels_equal_dense_solve():
    rng = np.random.default_rng(7)
    for n, extra in ((1, 0), (2, 0), (60, 0), (60, 40), (400, 60)):
        a = np.concatenate([np.arange(1, n), rng.integers(0, n, extra)]).astype(int)
        b = np.concatenate([np.array([rng.integers(0, i) for i in range(1, n)], int), rng.integers(0, n, extra)]).astype(int)
        root, w, right = int(rng.integers(0, n)), rng.uniform(0.1, 10, len(a)), rng.normal(size=n)
        ground = np.zeros(n)
        ground[root] = 2.0
        matrix = np.diag(ground)
        for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
            np.add.at(matrix, (i, j), sign * w)
        assert hydraulics.Levels(n, a, b, root).solve(w, ground, right) == pytest.approx(np.linalg.solve(matrix, right), rel=1e-8, abs=1e-8)
    with pytest.raises(np.linalg.LinAlgError):
        hydraulics.Levels(4, np.array([0, 2]), np.array([1, 3]), 0)


def test_a_long_network_is_solved_level_by_level():
    n = 60000
    links = np.concatenate([np.arange(n - 1), np.arange(0, n - 35, 5)]), np.concatenate([np.arange(1, n), np.arange(35, n, 5)])
    levels = hydraulics.Levels(n, *links, 0)
    assert len(levels.own) and levels.own[-1] < 50 * n  # a dense matrix has n * n


def test_reason_rounds_as_the_sql(spark):
    import duckdb

    figures = [8727.05, 8799.55, -8727.05, -0.04, 0.0, 0.25, 10.00005, 9999.15, 1e-13]
    got = [tuple(r) for r in frame(spark, [(i, 0.0, 0.0, v) for i, v in enumerate(figures)]).orderBy("node_id").select(placement._fixed(spatial.F.col("v"), 1), placement._fixed(spatial.F.col("v"), 4)).collect()]
    text = "CAST(round(CAST({0}::DOUBLE AS DECIMAL(28,12)), {1}) AS VARCHAR)"
    con = duckdb.connect()
    assert got == [con.execute(f"SELECT {text.format(repr(v), 1)}, {text.format(repr(v), 4)}").fetchone() for v in figures]


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A chain of 600 terms with chords and a circle: what one term reaches, in far
    fewer tables than steps."""
    from netweave.rdf import sparql as module

    links = [(i, i + 1) for i in range(600)] + [(i, i + 35) for i in range(0, 100, 5)] + [(600, 590), (1000, 3)]
    tables, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: tables.append(1) or real(df))
    graph = spark.createDataFrame([(f"<u:{a}>", "<u:to>", f"<u:{b}>") for a, b in links], "s string, p string, o string")
    for start, want in ((1000, range(3, 601)), (595, range(590, 601))):
        tables.clear()
        got = module.sparql(graph, f"SELECT ?x WHERE {{ <u:{start}> <u:to>+ ?x }}").collect()
        assert sorted(r.x for r in got) == sorted(f"u:{i}" for i in want)
        assert len(tables) < 60
