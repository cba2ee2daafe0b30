"""Cleaning of drawn lines against plain loops and hand-made drawings."""

import math
import random

import pytest

from netweave.operators import cleaning, noding, topology
from netweave.plans import fixtures, registry


def lines(spark, *drawn):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in line]) for i, line in enumerate(drawn)]
    return spark.createDataFrame(rows, f"line_id long, points {cleaning.POINTS}")


def plain(df):
    """Each line as its points, from its smaller end."""
    found = [tuple((p.x, p.y) for p in r.points) for r in df.collect()]
    return sorted(min(x, x[::-1]) for x in found)


def test_rings_are_cut_at_half_their_length(spark):
    ring = [(0, 0), (10, 0), (10, 2), (0, 2), (0, 0)]
    got = plain(cleaning.halved_rings(lines(spark, ring, [(0, 0), (5, 5)], [(1, 1), (1, 1)])))
    assert got == sorted([((0, 0), (10, 0), (10, 2)), ((0, 0), (0, 2), (10, 2)), ((0, 0), (5, 5))])
    middle = lines(spark, [(0, 0), (4, 0), (4, 4)]).select(cleaning.point_along(topology.F.col("points"), topology.F.lit(0.75)).alias("p")).first().p
    assert (middle.x, middle.y) == (4, 2)


def test_merge_and_overlap(spark):
    cross = lines(spark, [(0, 0), (10, 0)], [(5, -5), (5, 5)], [(2, 0), (8, 0)], [(10, 0), (20, 0)], [(20, 0), (20, 7)])
    got = plain(cleaning.node_and_merge(cross, 4.0))
    assert sum(math.dist(a, b) for line in got for a, b in zip(line, line[1:], strict=False)) == 37  # what lies twice counts once
    assert ((5, 0), (8, 0), (10, 0), (20, 0), (20, 7)) in got and len(got) == 4


def test_prune_merges_what_is_left(spark):
    main = [[(0, 0), (50, 0)], [(50, 0), (100, 0)], [(50, 0), (50, 5)], [(100, 0), (100, 6.5)]]
    assert plain(cleaning.pruned(cleaning.merged(lines(spark, *main)), 7.0)) == [((0, 0), (50, 0), (100, 0), (100, 6.5))]


def test_build(spark):
    drawing = lines(
        spark,
        [(0, 0), (100, 0)], [(100.2, 0.1), (200, 0)],  # a gap that welding closes
        [(50, 20), (50, 80)],  # an island, 53.852 m from the nearest end of the main
        [(150, 0), (150, 3)],  # a stub
        [(200, 0), (230, 0), (230, 30), (200, 30), (200, 0)],  # a ring
        [(900, 900), (990, 990)],  # too far away
    )
    links, nodes, report = cleaning.build(drawing)
    got = links.collect()
    assert round(report["bridged_m"], 3) == 53.852 and round(report["dropped_m"], 3) == round(90 * math.sqrt(2), 3)
    assert len(topology.components_by_size(links).collect()) == 1
    assert abs(sum(r.length_m for r in got) - (200 + 53.852 + 60 + 120)) < 0.5
    assert all(r.node1 != r.node2 for r in got) and {n for r in got for n in (r.node1, r.node2)} == {r.node_id for r in nodes.collect()}
    with pytest.raises(cleaning.Disconnected):
        cleaning.build(lines(spark))


def test_merge_keeps_length_and_degrees(spark):
    r = random.Random(3)
    spots = [(float(r.randrange(40)), float(r.randrange(40))) for _ in range(25)]
    drawn = [r.sample(spots, 2) for _ in range(30)]
    noded = noding.node(noding.segments(lines(spark, *drawn)), 8.0).collect()
    pieces = [((p.ax, p.ay), (p.bx, p.by)) for p in noded]
    got = plain(cleaning.node_and_merge(lines(spark, *drawn), 8.0))
    length = lambda x: sum(math.dist(a, b) for line in x for a, b in zip(line, line[1:], strict=False))
    assert abs(length(got) - length(pieces)) < 1e-6
    degree = {}
    for piece in pieces:
        for end in piece:
            degree[end] = degree.get(end, 0) + 1
    assert {end for line in got for end in (line[0], line[-1])} >= {p for p, n in degree.items() if n != 2}
    assert all(degree[p] == 2 for line in got for p in line[1:-1])


def test_spatial_clusters(spark):
    folder = "/root/testdata/sf0.001"
    nodes = [(x.node_id, x.x, x.y) for x in fixtures.net_nodes(spark, folder).collect()]
    root = {i: i for i, _, _ in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x, y in nodes:
        for j, u, v in nodes:
            if i < j and math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 40:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.node_id: r.spatial_cluster for r in registry.queries()["spatial_clusters"](spark, folder).collect()}
    assert got == {i: find(i) for i, _, _ in nodes}


def test_network_build_is_one_network(spark):
    links = registry.queries()["network_build"](spark, "/root/testdata/sf0.001").collect()
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for r in links:
        assert r.length_m > 0 and r.node1 != r.node2
        root[find(r.node1)] = find(r.node2)
    assert len({find(i) for i in root}) == 1


def test_lines_drawn_many_times_are_cut_once(spark, monkeypatch):
    """60 equal squares, half of them drawn the other way round: four segments are compared, not 240."""
    seen, real = [], noding.crossings
    monkeypatch.setattr(noding, "crossings", lambda segs, size: seen.append(segs.count()) or real(segs, size))
    ring = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    got = noding.node(noding.segments(lines(spark, *[ring, ring[::-1]] * 30, [(4, 4), (12, 4)])), 10.0).collect()
    assert seen == [5] and len(got) == 7
