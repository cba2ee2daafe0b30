"""Boundaries, exports, the graph on disk, and small pieces."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from netweave.functions import geometry
from netweave.operators import cleaning, demand, hydraulics, overlay, topology
from netweave.rdf import profile, store
from netweave.rdf.sparql import sparql
from netweave.sources import boundary, export, layers


def test_boundary_reads_joins_and_buffers(spark, tmp_path):
    square = lambda x: [[x, 0.0], [x + 10, 0.0], [x + 10, 10.0], [x, 10.0], [x, 0.0]]
    shapes = [{"type": "Polygon", "coordinates": [square(0.0)]}, {"type": "MultiPolygon", "coordinates": [[square(5.0)], [square(40.0)]]}, {"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "LineString", "coordinates": [[0.0, 0.0], [3.0, 4.0]]}]
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"layer": f"l{i}", "Text": '6"'}, "geometry": g} for i, g in enumerate(shapes)]}))
    features = layers.read_geojson(spark, str(path), spark.range(0).selectExpr("'' AS layer", "'' AS Text").schema)
    rings = boundary.rings(boundary.load_boundary(features))
    assert sorted(len(r) for r in rings) == [4, 8]  # two that overlap are one
    points = spark.createDataFrame([(7.0, 5.0), (12.0, 5.0), (17.0, 5.0), (45.0, 12.9), (45.0, 13.1), (30.0, 5.0)], "x double, y double")
    inside = lambda d: [r.c for r in points.select(boundary.covers(F.col("x"), F.col("y"), rings, d).alias("c")).collect()]
    assert inside(0.0) == [True, True, False, False, False, False] and inside(3.0) == [True, True, True, True, False, False]
    assert [r.layer for r in layers.read_lines(features).collect()] == ["l3"] and layers.read_lines(features, (0, 0, 2, 9)).count() == 0
    assert {(r.layer, r.raw, r.x, r.y) for r in layers.read_texts(features).collect()} >= {("l2", '6"', 1.0, 2.0), ("l3", '6"', 1.5, 2.0)}
    assert boundary.load_boundary(features.limit(0)).count() == 0
    none = spark.createDataFrame([("e", '4"', [], "Point"), ("n", '5"', None, None)], "layer string, Text string, parts array<array<struct<x:double,y:double>>>, geom_type string")
    assert {(r.layer, r.x, r.y) for r in layers.read_texts(none).collect()} == {("e", None, None), ("n", None, None)}


def test_boundary_with_holes(spark):
    box = lambda x, w: [(x, x), (x + w, x), (x + w, x + w), (x, x + w)]
    features = spark.createDataFrame([("Polygon", [box(0.0, 30.0), box(10.0, 10.0)]), ("Polygon", [box(12.0, 3.0)])], "geom_type string, parts array<array<struct<x:double,y:double>>>")
    area = boundary.load_boundary(features)
    assert overlay.area(area).first()["area"] == 900 - 100 + 9
    spots = [(1, 5.0, 5.0), (2, 11.0, 11.0), (3, 13.0, 13.0), (4, 18.0, 18.0), (5, 40.0, 5.0)]
    points = spark.createDataFrame([(0, *s) for s in spots], "plane long, id long, x double, y double")
    rings = boundary.rings(area)
    assert [r.id for r in points.filter(boundary.covers(F.col("x"), F.col("y"), rings)).orderBy("id").collect()] == [1, 3]
    assert sorted(r.id for r in overlay.covered(points, area, 8.0).collect()) == [1, 3]
    alone = features.limit(1)
    wider = overlay.area(boundary.load_boundary(alone, buffer=2.0)).first()["area"]
    assert wider == pytest.approx(30 * 30 + 120 * 2 + math.pi * 4 - 6 * 6, rel=1e-3)


def test_shapes_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.123456, True, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.23456789)]])], "id string, v double, flag boolean, parts array<array<struct<x:double,y:double>>>")
    polygon, line = (json.loads(export.geojson_shapes(rows, ["id", "v", "flag", "none"], F.col("parts"), kind).first().feature) for kind in ("Polygon", "LineString"))
    assert polygon["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.234568], [0.0, 0.0]]]}
    assert line["geometry"]["coordinates"] == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.234568]] and polygon["properties"] == {"id": "a", "v": 0.1235, "flag": 1}
    export.write_csv(rows.select("id", "v"), str(tmp_path / "c"), ["id"])
    assert [tuple(r) for r in layers.read_csv(spark, str(tmp_path / "c"), "id string, v double").collect()] == [("a", 0.123456)]
    assert json.loads(export.summary_json(rows.select("id", "v")).first().json) == {"id": "a", "v": 0.123456}
    text = export.control_points_yaml([(2435.6, 1041.0, 280000.125, 2117000.5)])
    assert text.splitlines()[5:] == ["    - cad:   [2435.6, 1041.0]", "      world: [280000.12, 2117000.50]"]


def test_inp_is_written_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 5.0, 0.5, 0.0, 0.0), (2, 6.0, 0.25, 10.0, 0.0)], "node_id long, elevation_m double, demand_lps double, x double, y double")
    pipes = spark.createDataFrame([(1, 1, 2, 10.0, 100.0, 130.0)], "link_id long, node1 long, node2 long, length_m double, diameter_mm double, roughness double")
    export.write_inp(export.inp_lines(nodes, pipes, nodes.limit(1), 2.5, 40.0), str(tmp_path / "n"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "n")).orderBy(F.monotonically_increasing_id()).collect()]
    heads = [x for x in lines if x.startswith("[")]
    assert heads == ["[JUNCTIONS]", "[RESERVOIRS]", "[PIPES]", "[PATTERNS]", "[TIMES]", "[OPTIONS]", "[COORDINATES]", "[END]"]
    assert "J2\t6.0000\t0.250000\tPEAK" in lines and lines.index("R1\t40.0000") < lines.index("[PIPES]")


def test_service_area_follows_pipes(spark):
    r = random.Random(1)
    pipes = [tuple(r.uniform(0, 100) for _ in range(4)) for _ in range(12)] + [(5.0, 5.0, 5.0, 5.0)]
    cells = demand.grid_points(spark, (0.0, 0.0, 100.0, 100.0), 4.0)

    def apart(x, y, p):
        dx, dy = p[2] - p[0], p[3] - p[1]
        t = max(0, min(1, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(x - p[0] - t * dx, y - p[1] - t * dy)

    df = spark.createDataFrame(pipes, "x1 double, y1 double, x2 double, y2 double")
    want = {c.cell for c in cells.collect() if min(apart(c.x, c.y, p) for p in pipes) <= 6}
    assert {c.cell for c in demand.network_service_area(cells, df, None, 6.0).collect()} == want
    assert demand.network_service_area(cells, df.limit(0), None, 6.0).count() == cells.count()
    with pytest.warns(UserWarning):
        assert demand.too_concentrated(spark.createDataFrame([(0.06,)], "top1_share double"))
    nothing = demand.concentration(spark.createDataFrame([(0.0,), (0.0,)], "demand double"))
    assert tuple(nothing.first()) == (0.0, None, None) and not demand.too_concentrated(nothing)


def test_served_ground(spark):
    square = overlay.edges_of(spark.createDataFrame([(0, [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]])], "plane long, parts array<array<struct<x:double,y:double>>>"), "plane")
    pipes = spark.createDataFrame([(10.0, 50.0, 90.0, 50.0), (500.0, 500.0, 500.0, 500.0)], "x1 double, y1 double, x2 double, y2 double")
    nodes = spark.createDataFrame([(1, 10.0, 50.0), (2, 90.0, 50.0), (3, 700.0, 700.0)], "node_id long, x double, y double")
    near = demand.served_ground(square, pipes, nodes, 5.0)
    assert overlay.area(near).first()["area"] == pytest.approx(80 * 10 + math.pi * 25, rel=2e-3)
    areas = {r.node_id: r.area for r in demand.thiessen_areas(nodes, near).collect()}
    assert areas[1] == pytest.approx(areas[2], rel=1e-4) and areas[3] == 0 and areas[1] + areas[2] == pytest.approx(80 * 10 + math.pi * 25, rel=2e-3)
    assert overlay.area(demand.served_ground(square, pipes.limit(0), nodes, 5.0)).first()["area"] == 10_000
    alone = overlay.area(demand.served_ground(None, None, nodes, None)).first()["area"]  # two of the three discs meet
    lens = 2 * 45**2 * math.acos(80 / 90) - 40 * math.sqrt(4 * 45**2 - 80**2)
    assert alone == pytest.approx(3 * math.pi * 45**2 - lens, rel=1e-2)
    assert not demand.too_concentrated(spark.createDataFrame([(0.05,)], "top1_share double"))


def test_cluster_and_source_and_scale(spark):
    lines = spark.createDataFrame([(1, 1, 5.0, True), (2, 1, 5.0, False), (3, 2, 3.0, True), (4, 3, 90.0, False)], "id long, cluster long, length_m double, inside boolean")
    kept = lambda test: sorted(r.id for r in topology.select_cluster(lines, "cluster", test).collect())
    assert kept(F.col("inside")) == [3] and kept(None) == [4] and kept(F.lit(False)) == [4]
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, -3.0, 0.0)], "node_id long, x double, y double")
    assert hydraulics.source_at(nodes, 0.0, 9.0).first().node_id == 1 and hydraulics.source_at(nodes.filter("node_id > 1"), 0.0, 0.0).first().node_id == 2
    assert [spark.range(1).select(geometry.scale_step(F.lit(s)).alias("s")).first().s for s in (1000.0, 10.0, 1e6)] == [250, 25, 5000]
    terms = spark.createDataFrame([("wdn:J12",), ("<http://x/n#P7>",), ("wdn:J12x",), ("other",)], "t string")
    assert [(r.a, r.b) for r in terms.select(profile.ids_of(F.col("t")).alias("a"), profile.ids_of(F.col("t"), "P").alias("b")).collect()] == [("J12", None), (None, "P7"), (None, None), (None, None)]


def test_schema_document(spark):
    a, n = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "http://x/n#"
    rows = [(f"<{n}a>", a, f"<{n}Pipe>"), (f"<{n}b>", a, f"<{n}Node>"), (f"<{n}c>", a, f"<{n}Node>"), (f"<{n}a>", f"<{n}start>", f"<{n}b>")]
    found = json.loads(profile.schema_json(spark.createDataFrame(rows, "s string, p string, o string")).first().json)
    assert found["counts"] == {"Node": 2, "Pipe": 1} and found["maxN"] == 2 and found["edges"] == [{"source": "Pipe", "target": "Node", "label": "start", "n": 1}]
    assert [x["id"] for x in found["nodes"]] == ["Node", "Pipe"]


def test_plans_of_patterns(spark):
    """The predicate reaches the scan; a variable that may be unbound is joined by
    a key; a closure starts at the end that is known."""
    n = "http://x/n#"
    t = [(f"<{n}{i}>", f"<{n}next>", f"<{n}{i + 1}>") for i in range(30)] + [(f"<{n}{i}>", f"<{n}kind>", f"<{n}k{i % 3}>") for i in range(0, 30, 2)] + [(f"<{n}k{i}>", f"<{n}name>", f'"k{i}"') for i in range(3)]
    graph = store.stored_graph(spark.createDataFrame(t, "s string, p string, o string"))
    ask = lambda text: sparql(graph, text, {"n": n}, counts=store.counts(graph))
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert f"EqualTo(p,<{n}kind>)" in plan(ask("SELECT ?a ?k WHERE { ?a n:kind ?k }"))
    late = ask("SELECT ?a ?k WHERE { ?a n:next ?b OPTIONAL { ?a n:kind ?k } ?b n:kind ?k }")
    assert "NestedLoop" not in plan(late) and "Cartesian" not in plan(late)
    assert sorted(r.a for r in late.collect()) == sorted(f"{n}{i}" for i in range(1, 29, 2))
    back = ask("SELECT ?x WHERE { ?x n:next+ n:4 }")
    assert sorted(r.x for r in back.collect()) == [f"{n}{i}" for i in range(4)]
    assert ask("SELECT ?x WHERE { ?x n:next* n:2 }").count() == 3 and ask("SELECT ?x WHERE { ?x (n:next/n:next)+ n:4 }").count() == 2


def test_service_area_does_not_repeat_pipes(spark):
    """A pipe's points were posted to nine squares each; cells are now."""
    from pyspark.sql import functions as F

    pipes = spark.range(50).select(F.col("id").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.col("id").cast("double").alias("x2"), F.lit(90.0).alias("y2"))
    cells = demand.grid_points(spark, (0.0, 0.0, 100.0, 100.0), 10.0)
    plan = demand.network_service_area(cells, pipes, None, 5.0)._jdf.queryExecution().optimizedPlan().toString()
    posted = [line for line in plan.split("\n") if "Generate explode(" in line and "struct" in line and "array" in line]
    assert posted and not any("x1" in line for line in posted), plan
