"""Overlay of areas against exact areas of rectangles, formulas and point tests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netweave.operators import doubling, overlay

SHAPES = "plane long, parts array<array<struct<x: double, y: double>>>"


def box(x, y, w, h, left=True):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return ring if left else ring[::-1]


def drawn(spark, shapes):
    return overlay.edges_of(spark.createDataFrame([(p, [[(float(x), float(y)) for x, y in ring] for ring in parts]) for p, parts in shapes], SHAPES), "plane")


def areas(df):
    return {r.plane: round(r.area, 6) for r in overlay.area(df).collect()}


def covered_area(boxes):
    """Of boxes, by coordinates that occur."""
    xs, ys = sorted({v for x, _, w, _ in boxes for v in (x, x + w)}), sorted({v for _, y, _, h in boxes for v in (y, y + h)})
    return sum((b - a) * (d - c) for a, b in zip(xs, xs[1:], strict=False) for c, d in zip(ys, ys[1:], strict=False) if any(x <= a < x + w and y <= c < y + h for x, y, w, h in boxes))


def test_even_odd_and_holes(spark):
    shapes = [(1, [box(0, 0, 10, 10), box(2, 2, 4, 4), box(3, 3, 1, 1)]), (2, [box(0, 0, 10, 10, False), box(2, 2, 4, 4, False)]), (3, [[(0, 0), (10, 10), (10, 0), (0, 10)]]), (4, [[(0, 0), (1, 1)]]), (5, [])]
    made = overlay.even_odd(drawn(spark, shapes), 3.0)
    assert areas(made) == {1: 100 - 16 + 1, 2: 84, 3: 50}
    rings = overlay.outlines(made).collect()
    assert sorted((r.plane, round(r.area, 6), len(r.points)) for r in rings) == [(1, -16, 4), (1, 1, 4), (1, 100, 4), (2, -16, 4), (2, 100, 4), (3, 25, 3), (3, 25, 3)]
    points = spark.createDataFrame([(1, 1, 2.5, 2.5), (1, 2, 3.5, 3.5), (1, 3, 9.0, 1.0), (1, 4, 11.0, 5.0), (1, 5, -1.0, 5.0), (2, 6, 3.5, 3.5), (9, 7, 1.0, 1.0)], "plane long, id long, x double, y double")
    assert sorted(r.id for r in overlay.covered(points, made, 3.0).collect()) == [2, 3]


def test_combined_and_overlap(spark):
    one = overlay.even_odd(drawn(spark, [(1, [box(0, 0, 10, 10), box(4, 4, 2, 2)]), (2, [box(0, 0, 2, 2)]), (3, [box(0, 0, 5, 5)]), (4, [box(0, 0, 4, 4)])]), 2.0)
    two = overlay.even_odd(drawn(spark, [(1, [box(5, 5, 10, 10)]), (2, [box(5, 5, 2, 2)]), (3, [box(0, 0, 5, 5)]), (4, [box(1, 4, 2, 3)])]), 2.0)
    assert areas(overlay.combined(one, two, "union", 2.0)) == {1: 96 + 100 - 24, 2: 8, 3: 25, 4: 22}
    assert areas(overlay.combined(one, two, "intersection", 2.0)) == {1: 24, 3: 25}
    assert areas(overlay.combined(one, two, "difference", 2.0)) == {1: 72, 2: 4, 4: 16}
    found = {r.plane: (r.intersection, r.union, r.iou) for r in overlay.overlap(one, two, 2.0).collect()}
    assert found[3] == (25, 25, 1) and found[2] == (0, 8, 0) and found[1][2] == pytest.approx(24 / 172)
    assert overlay.overlap(one.limit(0), two.limit(0), 2.0).count() == 0


def test_dissolve_against_exact_areas(spark):
    r = random.Random(5)
    boxes = {p: [(r.randrange(60), r.randrange(60), r.randrange(1, 14), r.randrange(1, 14)) for _ in range(25)] for p in range(6)}
    made = overlay.dissolve(drawn(spark, [(p, [box(*b)]) for p, own in boxes.items() for b in own]), 4.0)
    assert areas(made) == {p: covered_area(own) for p, own in boxes.items()}
    for ring in overlay.outlines(made).collect():
        assert len({(q.x, q.y) for q in ring.points}) >= 4


def test_slanted_areas_against_points(spark):
    r = random.Random(8)
    stars = {p: [(50 + 40 * math.cos(a) * s, 50 + 40 * math.sin(a) * s) for a, s in ((2 * math.pi * i / 17, r.uniform(0.3, 1)) for i in range(17))] for p in (1, 2)}
    moved = [(x + 13.3, y - 7.7) for x, y in stars[2]]

    def inside(x, y, ring):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    one, two = overlay.even_odd(drawn(spark, [(7, [stars[1]])]), 5.0), overlay.even_odd(drawn(spark, [(7, [moved])]), 5.0)
    grid = [(i, r.uniform(0, 110), r.uniform(-10, 100)) for i in range(4000)]
    points = spark.createDataFrame([(7, *g) for g in grid], "plane long, id long, x double, y double")
    for how, want in (("union", lambda a, b: a or b), ("intersection", lambda a, b: a and b), ("difference", lambda a, b: a and not b)):
        made = overlay.combined(one, two, how, 5.0)
        got = {q.id for q in overlay.covered(points, made, 5.0).collect()}
        assert got == {i for i, x, y in grid if want(inside(x, y, stars[1]), inside(x, y, moved))}
        assert sum(q.area for q in overlay.outlines(made).collect()) == pytest.approx(areas(made)[7], abs=1e-3)


def test_buffer(spark):
    made = overlay.buffered(overlay.even_odd(drawn(spark, [(1, [box(0, 0, 100, 60)]), (2, [box(0, 0, 100, 100), box(30, 30, 40, 40)])]), 30.0), 10.0)
    found = areas(made)
    assert found[1] == pytest.approx(100 * 60 + 2 * 160 * 10 + math.pi * 100, rel=1e-3)
    assert found[2] == pytest.approx(100 * 100 + 4 * 100 * 10 + math.pi * 100 - 20 * 20, rel=1e-3)
    lone = overlay.buffered(made.limit(0), 10.0, lone=spark.createDataFrame([(5, 3.0, 4.0)], "plane long, x double, y double"))
    assert areas(lone)[5] == pytest.approx(math.pi * 100, rel=2e-3)


def test_doubling_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = doubling.cut
    monkeypatch.setattr(doubling, "cut", lambda df: rounds.append(1) or real(df))
    n = 10_000
    steps = spark.range(n).select("id", F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"), F.lit(1).alias("one"))
    got = {r.id: (r.end, r.n, r.total) for r in doubling.to_the_end(steps, "one").collect()}
    assert got == {i: (n - 1, n - 1 - i, n - i) for i in range(n)} and len(rounds) < 20
    loops = [(i, 3 + (i + 1 - 3) % 7) for i in range(3, 10)] + [(20, 20)] + [(30, 31), (31, 30)]
    got = sorted(tuple(r) for r in doubling.rings(spark.createDataFrame(loops, "id long, next long")).collect())
    assert got == [*((i, 3, i - 3) for i in range(3, 10)), (20, 20, 0), (30, 30, 0), (31, 30, 1)]
    odd = spark.createDataFrame([(1, 99), (2, 1), (3, None)], "id long, next long")
    assert sorted(tuple(r) for r in doubling.to_the_end(odd).collect()) == [(1, 1, 0), (2, 1, 1), (3, 3, 0)]


def test_overlap_cuts_edges_once(spark, monkeypatch):
    """Union and intersection are asked of the same pieces."""
    calls, whole = [], overlay.pieces
    monkeypatch.setattr(overlay, "pieces", lambda *a: calls.append(1) or whole(*a))
    edge = "plane long, ax double, ay double, bx double, by double"
    box = lambda x: [(1, x, 0.0, x + 2, 0.0), (1, x + 2, 0.0, x + 2, 1.0), (1, x + 2, 1.0, x, 1.0), (1, x, 1.0, x, 0.0)]
    (found,) = overlay.overlap(spark.createDataFrame(box(0.0), edge), spark.createDataFrame(box(1.0), edge), 2.0).collect()
    assert (found.intersection, found.union, len(calls)) == (1.0, 3.0, 1)
