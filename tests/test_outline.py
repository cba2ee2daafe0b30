"""Nearest neighbours, outlines and Thiessen polygons against brute force."""

import math
import random

import pytest

from netweave.operators import outline, overlay, spatial

POINTS = "node_id long, x double, y double"
INF, NAN = float("inf"), float("nan")


def test_k_nearest_against_brute_force(spark):
    r = random.Random(4)
    heap = [(5000 + r.gauss(0, 0.01), 5000 + r.gauss(0, 0.01)) for _ in range(300)]
    targets = heap + [(r.uniform(0, 9000), r.uniform(0, 300)) for _ in range(200)] + [(7.0, 7.0)] * 30
    queries = [(r.uniform(-9000, 18000), r.uniform(-9000, 18000)) for _ in range(60)] + heap[:40] + [(7.0, 7.0)] * 5 + [(1e7, -3.0)]
    odd = [(-1, NAN, 0.0), (-2, None, 1.0), (-3, INF, 0.0)]
    q = spark.createDataFrame([(i, *p) for i, p in enumerate(queries)] + odd, POINTS)
    t = spark.createDataFrame([(i, *p) for i, p in enumerate(targets)] + odd, POINTS)
    for k in (1, 7):
        got = sorted((x.query, x.rank, x.target, x.distance) for x in spatial.k_nearest(q, t, "node_id", "node_id", k).collect())
        want = []
        for i, (x, y) in enumerate(queries):
            near = sorted((math.sqrt((x - tx) ** 2 + (y - ty) ** 2), j) for j, (tx, ty) in enumerate(targets))[:k]
            want += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))
    few = spatial.k_nearest(q, t.filter("node_id BETWEEN 0 AND 1"), "node_id", "node_id", 5)
    assert few.count() == 2 * len(queries)
    assert spatial.k_nearest(q, t.limit(0), "node_id", "node_id", 5).count() == 0 and spatial.k_nearest(q.limit(0), t, "node_id", "node_id", 5).count() == 0
    one = spark.createDataFrame([(1, 3.0, 3.0)], POINTS)
    assert [tuple(x) for x in spatial.k_nearest(one, one, "node_id", "node_id", 3).collect()] == [(1, 1, 1, 0.0)]


def brute_alpha(points, radius):
    """(from, to) by every pair and both of its discs."""
    out = set()
    for a, (ax, ay) in enumerate(points):
        for b, (bx, by) in enumerate(points[:a]):
            d = math.dist((ax, ay), (bx, by))
            if 0 < d <= 2 * radius:
                h = math.sqrt(max(radius**2 - d * d / 4, 0)) / d
                sides = []
                for way in (1, -1):
                    cx, cy = (ax + bx) / 2 - way * h * (by - ay), (ay + by) / 2 + way * h * (bx - ax)
                    sides.append(any(math.dist((cx, cy), p) < radius * (1 - 1e-9) for i, p in enumerate(points) if i not in (a, b)))
                if sides[0] != sides[1]:
                    out.add((a, b) if sides[0] else (b, a))
    return out


def test_outline_against_brute_force(spark):
    r = random.Random(6)
    points = [(r.uniform(0, 400), r.uniform(0, 400)) for _ in range(160)] + [(900.0, 900.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(500, *points[0]), (501, NAN, 1.0)], POINTS)
    assert {(x.a, x.b) for x in outline.alpha_edges(df, "node_id", 45.0).collect()} == brute_alpha(points, 45.0)
    whole = overlay.outlines(outline.hull(df, "node_id", 45.0)).collect()
    assert whole and all(x.area > 0 for x in whole)


@pytest.mark.parametrize("distance", [35.0, 45.0])
def test_footprints(spark, distance):
    """Five points, four corners and a middle; and a C of points 20 apart."""
    five = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0, 100.0), (4, 0.0, 100.0), (5, 50.0, 50.0)], POINTS)
    got = overlay.area(outline.footprint(five, "node_id", 80.0, distance)).first()["area"]
    assert got == pytest.approx(100 * 100 + 400 * distance + math.pi * distance**2, rel=0.01)
    spots = [(x, y) for x in range(0, 401, 20) for y in range(0, 401, 20) if not (x > 100 and 100 < y < 300)]
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], POINTS)
    got = overlay.area(outline.footprint(c, "node_id", 15.0, distance)).first()["area"]
    rim = 4 * 400 + 2 * 300  # six corners outwards; the two inwards lose what two strips share
    assert got == pytest.approx(400 * 400 - 300 * 200 + rim * distance + 1.5 * math.pi * distance**2 - 2 * distance**2, rel=0.01)
    apart = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], POINTS)
    assert overlay.area(outline.footprint(apart, "node_id", 50.0, distance)).first()["area"] == pytest.approx(2 * math.pi * distance**2, rel=0.01)


def test_cells_fill_the_box(spark):
    r = random.Random(9)
    points = [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(120)] + [(r.gauss(30, 0.5), r.gauss(30, 0.5)) for _ in range(60)] + [(float(x), 70.0) for x in range(0, 50, 5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, *points[3])], POINTS)
    found = outline.cells(df, "node_id", (-10.0, -10.0, 110.0, 110.0)).collect()
    assert sorted(x.id for x in found) == list(range(len(points)))
    area = lambda ring: sum(p.x * q.y - q.x * p.y for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    assert sum(area(x.polygon) for x in found) == pytest.approx(120 * 120, rel=1e-9) and all(area(x.polygon) > 0 for x in found)
    for x in found:
        for v in x.polygon:
            nearest = min(math.dist((x.x + v.x, x.y + v.y), p) for p in points)
            assert math.hypot(v.x, v.y) == pytest.approx(nearest, abs=1e-6)


def test_thiessen_areas(spark):
    r = random.Random(10)
    points = [(r.uniform(0, 100), r.uniform(0, 100)) for _ in range(40)] + [(150.0, 150.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], POINTS)
    rings = [[(2.0, 3.0), (97.0, 8.0), (90.0, 95.0), (50.0, 40.0), (5.0, 90.0)], [(20.0, 15.0), (60.0, 15.0), (60.0, 30.0), (20.0, 30.0)]]
    areas = spark.createDataFrame([(0, rings)], "plane long, parts array<array<struct<x: double, y: double>>>")
    boundary = overlay.even_odd(overlay.edges_of(areas, "plane"), 20.0)
    found = outline.thiessen(df, "node_id", boundary)
    got = {x.plane: x.area for x in overlay.area(found).collect()}
    assert sum(got.values()) == pytest.approx(overlay.area(boundary).first()["area"], rel=1e-5)

    def inside(x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    step, want = 0.5, {}
    for i in range(200):
        for j in range(200):
            x, y = (i + 0.5) * step, (j + 0.5) * step
            if inside(x, y):
                n = min(range(len(points)), key=lambda p: math.dist((x, y), points[p]))
                want[n] = want.get(n, 0) + step * step
    assert all(abs(got.get(n, 0) - want.get(n, 0)) < 4 for n in range(len(points))) and 40 not in got
    closed = overlay.outlines(found).collect()
    sums = {}
    for x in closed:
        sums[x.plane] = sums.get(x.plane, 0) + x.area
    assert all(sums[n] == pytest.approx(got[n], abs=1e-2) for n in got)


def test_area_queries_add_up(spark):
    import os

    from netweave.plans import area_queries, fixtures

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    whole = overlay.area(area_queries.ground(spark, folder)).first()["area"]
    nodes = {x.node_id: (x.x, x.y) for x in fixtures.net_nodes(spark, folder).collect()}
    got = {x.node_id: x.area for x in area_queries.thiessen_areas(spark, folder).collect()}
    assert set(got) == set(nodes) and sum(got.values()) == pytest.approx(whole, rel=1e-5)
    rings = [area_queries.RING, area_queries.HOLE]

    def inside(x, y):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ring in rings for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    want = dict.fromkeys(nodes, 0)
    for i in range(200):
        for j in range(200):
            x, y = 5 * i + 2.5, 5 * j + 2.5
            if inside(x, y):
                want[min(nodes, key=lambda n: (nodes[n][0] - x) ** 2 + (nodes[n][1] - y) ** 2)] += 25
    assert all(abs(got[n] - want[n]) < 0.12 * want[n] + 250 for n in nodes)
    zones = area_queries.zone_polygons(spark, folder).collect()
    assert sum(z.area for z in zones) == pytest.approx(whole, rel=1e-4)
