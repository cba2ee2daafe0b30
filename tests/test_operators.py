"""Operators without SQL, by invariants and plain re-statements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netweave.functions import geometry, labels
from netweave.operators import cleaning, demand, georeference, hydraulics, noding, placement, spatial, topology, trees, zones
from netweave.operators.components import connected_components
from netweave.plans import fixtures, graph_queries
from netweave.session import stored
from netweave.sources import config, layers

SMALL = "/root/testdata/sf0.001"
#: text, millimetres, on the ladder, material, asset
LABELS = [
    ('6"', 150.0, 150.0, None, None), ('3"G.I.', 75.0, 75.0, "GI", None), ('12"C.I.', 300.0, 300.0, "CI", None), ("NEW 250MM", 250.0, 250.0, None, None), ("D.I. 150 MM", 150.0, 150.0, "DI", None),
    ('1 1/2"', 40.0, 40.0, None, None), ('11/2"', 40.0, 40.0, None, None), ('3/4"', 40.0, 40.0, None, None), ('1 1/4"', 32.0, 40.0, None, None), ('2.5"', 65.0, 75.0, None, None), ('7"', 150.0, 150.0, None, None),
    ('5"', 125.0, 100.0, None, None), ("100", 100.0, 100.0, None, None), ("10", None, None, None, None), ("2500", None, None, None, None), ("A.V.", None, None, None, "AirValve"), ("P/H", None, None, None, "PumpHouse"),
    ("W.O.", None, None, None, "WashOut"), ("NON RETURN VALUE", None, None, None, "NonReturnValve"), ("FIRE HYDRANT", None, None, None, "FireHydrant"), ('S.V. 6"', 150.0, 150.0, None, "SluiceValve"),
    ('4" PVC', 100.0, 100.0, "PVC", None), ("DEAD END", None, None, None, "DeadEnd"), ('GALV 2"', 50.0, 50.0, "GI", None), ("ESR", None, None, None, "Tank"), ('9"', 200.0, 200.0, None, None), ("1/4", None, None, None, None),
    ('8 "', 200.0, 200.0, None, None), ("CI 65 M.M.", 65.0, 65.0, "CI", None), (None, None, None, None, None), ("", None, None, None, None),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LABELS)], "i int, raw string")
    plain = {r.i: r for r in labels.parse_labels(df, "raw").collect()}
    stepped = {r.i: r.diameter_mm for r in labels.parse_labels(df, "raw", fixtures.LADDER).collect()}
    for i, (t, mm, on_ladder, material, asset) in enumerate(LABELS):
        r = plain[i]
        want = mm if mm is None or t in ("100",) or "MM" in t or "M.M" in t else on_ladder
        assert (r.diameter_mm, r.material, r.asset) == (mm, material, asset), t
        assert stepped[i] == want, t


def test_ladders_and_demand(spark):
    row = spark.range(1).select(
        labels.next_size(F.lit(75.0), F.lit(40.0), fixtures.LADDER), labels.next_size(F.lit(75.1), F.lit(40.0), fixtures.LADDER), labels.next_size(F.lit(0.0), F.lit(150.0), fixtures.LADDER), labels.next_size(F.lit(401.0), F.lit(40.0), fixtures.LADDER),
        labels.snap(F.lit(65.0), fixtures.LADDER), labels.snap(F.lit(125.0), fixtures.LADDER), labels.snap(F.lit(float("nan")), fixtures.LADDER),
        hydraulics.total_demand(F.lit(13429), F.lit(135.0)), hydraulics.total_demand(F.lit(13429), F.lit(135.0), None, F.lit(0.15)), labels.material_name(F.lit("gi")), labels.roughness(F.lit(None).cast("string")),
    ).first()
    assert list(row[:7]) == [75.0, 100.0, 150.0, 400.0, 75.0, 100.0, None]
    assert row[7] == pytest.approx(20.9828125) and row[8] == pytest.approx(24.6856618) and row[9:] == ("GalvanisedIron", 110.0)


def test_projection_and_bearing(spark):
    x, y = geometry.to_utm(F.lit(72.912694), F.lit(19.13588), 43)
    lon, lat = geometry.from_utm(F.lit(280451.775), F.lit(2117173.713), 43)
    got = spark.range(1).select(x, y, lon, lat, geometry.bearing(F.lit(1753.8 - 2435.6), F.lit(-389.5 - 1041.0))).first()
    assert abs(got[0] - 280451.775) < 0.1 and abs(got[1] - 2117173.713) < 0.1
    assert abs(got[2] - 72.912694) < 1e-6 and abs(got[3] - 19.13588) < 1e-6 and got[4] == pytest.approx(205.48324, abs=1e-4)
    points = spark.createDataFrame([(1592.8, 1286.5, 279964.18, 2117575.05), (2783.8, -389.5, 281155.18, 2115899.05)], "x double, y double, u double, v double")
    found = geometry.similarity_fit(points)
    assert found["scale"] == pytest.approx(1) and found["theta"] == pytest.approx(0, abs=1e-9) and found["rms"] < 1e-6
    assert geometry.ring_area(geometry.clip_convex([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (6, 2), (6, 6), (2, 6)])) == 4


def test_registration_and_dispatch(spark):
    shape = [(0.0, 0.0), (900.0, 50.0), (800.0, 700.0), (350.0, 500.0), (60.0, 900.0)]
    found = georeference.register(spark, shape, [(x + 210, y - 135) for x, y in shape], reach=120, step=40)
    assert abs(found["dx"] - 210) < 2 and abs(found["dy"] + 135) < 2 and found["iou"] > 0.99 > found["iou_at"][25] > found["iou_at"][100]
    points = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "x double, y double")
    assert [tuple(r) for r in georeference.georeference(points, "fit_to_boundary", box=(0, 0, 2, 4)).collect()] == [(0.0, 0.0), (2.0, 4.0)]
    assert georeference.georeference(points, "identity") is points
    with pytest.raises(ValueError):
        georeference.georeference(points, "by hand")


def test_nearest_beyond_the_first_ring(spark):
    r = random.Random(1)
    a, b = [(i, r.random() ** 5 * 1000, r.random() * 9) for i in range(60)], [(i, r.random() ** 4 * 1000, r.random() * 9) for i in range(40)] + [(99, 5000.0, 5000.0)]
    got = {(x.query, x.rank): (x.distance, x.target) for x in spatial.k_nearest(spark.createDataFrame(a, "i long, x double, y double"), spark.createDataFrame(b, "i long, x double, y double"), "i", "i", 4).collect()}
    for i, x, y in a:
        want = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in b)[:4]
        assert [got[(i, k + 1)] for k in range(4)] == [pytest.approx(w) for w in want]
    none = spark.createDataFrame([], "i long, x double, y double")
    assert spatial.k_nearest(spark.createDataFrame(a, "i long, x double, y double"), none, "i", "i", 2).count() == 0
    assert spatial.k_nearest(none, spark.createDataFrame(b, "i long, x double, y double"), "i", "i", 2).count() == 0


def test_polygon_edges(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    points = [(1.0, 1.0, True), (0.0, 1.0, False), (2.0, 3.0, False), (2.0, 2.0, False), (4.0, 4.0, False), (3.0, 2.0, True), (5.0, 0.0, False), (2.0, 0.0, False)]
    df = spark.createDataFrame(points, "x double, y double, inside boolean")
    assert df.filter(spatial.in_polygon(F.col("x"), F.col("y"), ring) != F.col("inside")).count() == 0


def links(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "link_id long, node1 long, node2 long, length_m double")


def test_prune_bridge_merge(spark):
    chain = links(spark, [(1, 2, 9.0), (2, 3, 9.0), (3, 1, 9.0), (3, 4, 1.0), (4, 5, 1.0), (1, 6, 5.0)])
    assert sorted(r.link_id for r in topology.prune_dangles(chain, 2.0).collect()) == [0, 1, 2, 5]
    places = {1: (0, 0), 2: (1, 0), 3: (0, 1), 11: (5, 0), 12: (6, 0), 21: (9, 0), 31: (100, 100)}
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in places.items()], "node_id long, x double, y double")
    parts = links(spark, [(1, 2, 1.0), (2, 3, 1.0), (11, 12, 1.0)])
    got = sorted((r.node1, r.node2, r.length_m) for r in topology.bridge_islands(parts, nodes, 10.0).collect())
    assert got == [(2, 11, 4.0), (12, 21, 3.0)]
    assert topology.bridge_islands(parts, nodes, 2.0).count() == 0
    short, merged = topology.merge_short(parts.union(links(spark, [(3, 11, 0.1)])), nodes, 0.5)
    assert merged.count() == len(places) - 1 and short.filter("node1 = node2").count() == 0
    assert [r.n_nodes for r in topology.components_by_size(parts).collect()] == [3, 2]
    assert sorted(r.link_id for r in topology.largest_component(parts).collect()) == [0, 1]


def test_weld_and_rings(spark):
    point = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    rows = [(1, point((0, 0), (10, 0))), (2, point((10.4, 0.3), (20, 0))), (3, point((10.2, -0.4), (10, 9), (10, 20))), (4, point((0, 0.2), (0.1, 0)))]
    lines = spark.createDataFrame(rows, "line_id long, points array<struct<x:double,y:double>>")
    got = {r.line_id: [(p.x, p.y) for p in r.points] for r in topology.weld(lines, 0.8).collect()}
    assert set(got) == {1, 2, 3} and got[1][1] == got[2][0] == got[3][0] == (10.2, -0.033) and got[3][1] == (10.0, 9.0)
    rings = spark.createDataFrame([(1, point((0, 0), (4, 0), (4, 4), (0, 0))), (2, point((1, 1), (1, 1))), (3, point((0, 0), (1, 0)))], "line_id long, points array<struct<x:double,y:double>>")
    halves = [(r.line_id, [(p.x, p.y) for p in r.points]) for r in cleaning.halved_rings(rings).collect()]
    assert sorted(i for i, _ in halves) == [1, 2, 3] and all(p[0] != p[-1] for _, p in halves)


def test_noding_keeps_length(spark):
    point = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    rows = [(1, point((0, 0), (10, 0))), (2, point((5, -5), (5, 5))), (3, point((0, 2), (10, 2), (10, 0))), (4, point((2, 0), (2, 1)))]
    lines = spark.createDataFrame(rows, "line_id long, points array<struct<x:double,y:double>>")
    pieces = noding.node(noding.segments(lines), 3.0)
    length = pieces.select(F.sum(F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))).first()[0]
    assert length == pytest.approx(noding.total_length(lines)) and pieces.count() == 10
    merged = {r.link_id: (r.node1, r.node2, r.length_m, r.n_links) for r in noding.merge_chains(links(spark, [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (3, 5, 1.0), (7, 8, 1.0), (8, 9, 1.0), (9, 7, 1.0)])).collect()}
    assert merged == {0: (1, 3, 3.0, 2), 2: (3, 4, 3.0, 1), 3: (3, 5, 1.0, 1), 4: (7, 7, 3.0, 3)}


def test_solve(spark):
    nodes, pipes = fixtures.net_nodes(spark, SMALL), fixtures.net_pipes(spark, SMALL)
    found = graph_queries.solved(spark, SMALL).collect()
    heads = {r.id: r.head_m for r in found if r.kind == "node"}
    flows = {r.id: r for r in found if r.kind == "pipe"}
    codes = list(labels.ROUGHNESS)
    sources = {r.network_id: r.id for r in found if r.kind == "source"}
    balance = dict.fromkeys(heads, 0.0)
    for r in pipes.collect():
        f = flows[r.link_id].flow_lps / 1000
        balance[r.node1] -= f
        balance[r.node2] += f
        rough = labels.ROUGHNESS[codes[r.link_id % len(codes)]]
        loss = 10.667 * max(r.length_m, 0.1) / (rough**1.852 * (r.diameter_mm / 1000) ** 4.871) * abs(f) ** 1.852
        assert abs(abs(heads[r.node1] - heads[r.node2]) - loss) < 1e-4 * max(1, loss)
    for r in nodes.collect():
        if r.node_id not in sources.values():
            assert abs(balance[r.node_id] - r.demand_lps / 100 / 1000 * 2.5) < 1e-6
    for r in found:
        if r.kind == "source":
            assert min(x.pressure_m for x in found if x.kind == "node" and x.network_id == r.network_id) == pytest.approx(15)


def test_tree_flows(spark):
    rows = links(spark, [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 1.0), (3, 4, 1.0), (2, 2, 1.0), (8, 9, 1.0)])
    root = spark.createDataFrame([(1,)], "node_id long")
    tree = stored(trees.spanning_tree(rows, root))
    assert {(r.node_id, r.depth, r.link_id) for r in tree.collect()} == {(1, 0, None), (2, 1, 0), (4, 1, 2), (3, 2, 1)}
    needs = spark.createDataFrame([(2, 1.0), (3, 2.0), (4, 4.0), (9, 9.0)], "node_id long, demand double")
    assert {(r.link_id, r.flow) for r in trees.tree_flows(tree, needs, 2.0).collect()} == {(0, 6.0), (1, 4.0), (2, 8.0)}
    many = hydraulics.network_trees(needs.withColumn("network_id", F.lit(1)), rows.withColumn("network_id", F.lit(1)), root.withColumn("network_id", F.lit(1)), 2.0).collect()
    assert {(r.link_id, r.flow) for r in many if r.depth} == {(0, 6.0), (1, 4.0), (2, 8.0)}


def test_demand_methods(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "node_id long, x double, y double")
    with pytest.warns(UserWarning):
        assert [r.demand for r in demand.allocate(nodes, 6.0, "magic").collect()] == [3.0, 3.0]
    nothing = links(spark, [(1, 2, 0.0)])
    assert [r.demand for r in demand.allocate(nodes, 6.0, "pipe_length", links=nothing).collect()] == [3.0, 3.0]


def test_zones(spark):
    points = spark.createDataFrame([(i, float(i % 3) * 100 + i / 100, 0.0) for i in range(60)], "node_id long, x double, y double")
    zoned, centres = zones.kmeans_zones(points, ["x", "y"], k=3, starts=3)
    for r in zoned.collect():
        assert min(range(3), key=lambda k: (centres[k][0] - r.x) ** 2 + (centres[k][1] - r.y) ** 2) + 1 == r.cluster
    with pytest.raises(ValueError):
        zones.kmeans_zones(points.limit(2), ["x", "y"], k=3)


def test_raster(spark):
    points = spark.createDataFrame([(1, 0.5, 1.5), (2, 1.5, 1.5), (3, 9.0, 9.0)], "node_id long, x double, y double")
    raster = spark.createDataFrame([(0, 0, 5.0), (0, 1, None)], "row int, col int, z double")
    got = {r.node_id: (r.z, r.filled) for r in layers.sample_raster(points, raster, "node_id", (0.0, 2.0), (1.0, 1.0), fill="idw").collect()}
    assert got == {1: (5.0, False), 2: (5.0, True), 3: (5.0, True)}
    with pytest.raises(ValueError):
        layers.sample_raster(points.filter("node_id = 3"), raster, "node_id", (0.0, 2.0), (1.0, 1.0))


def test_small_groups_and_empty(spark):
    rows = [(i, 1, "dead_end" if i % 2 else "bend", float(i), float(i), float(i)) for i in range(4)]
    nodes = spark.createDataFrame(rows, "node_id long, cluster int, node_type string, elevation_m double, pressure_m double, demand_lps double")
    chosen = placement.top_up(placement.cascade(nodes))
    assert sorted(r.node_id for r in chosen.filter("selected").collect()) == [3]
    assert placement.top_up(placement.cascade(nodes.limit(0))).count() == 0
    assert connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"demand": {"population": 10}, "placement": {"k": 3}}')
    c = config.Config.load(str(tmp_path / "c.json")).validate()
    assert c.get("placement.k") == 3 and c.get("placement.floor") == 5 and c.get("no.such", 1) == 1
    with pytest.raises(config.ConfigError) as e:
        config.Config({"placement": {"low": 0.9}, "demand": {"peak_factor": 0}}).validate()
    assert str(e.value).count(";") == 2
    assert config.match_column(["Elev", "X"], "elevation_m") == "Elev" and config.match_column(["q"], "node_id") is None
