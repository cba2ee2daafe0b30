"""Label reading, ladders, sizing formulas, polylines, geometry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.functions import geometry, labels
from netweave.operators import hydraulics, overlay, topology
from netweave.plans.fixtures import BASE, LADDER, PIPES, label_sql, memo, net_nodes, net_pipes
from netweave.plans.registry import query
from netweave.session import table
from netweave.sources import layers

_INCHES = "[" + ", ".join(f"{{'k': {k}::DOUBLE, 'i': {i}, 'mm': {mm}::DOUBLE}}" for i, (k, mm) in enumerate(labels.INCHES)) + "]"
_LADDER = "[" + ", ".join(f"{v}::DOUBLE" for v in LADDER) + "]"


def _closest(value: str, keys: str = _INCHES) -> str:
    return f"list_min(list_transform({keys}, lambda s: {{'d': abs(s.k - ({value})), 'i': s.i, 'mm': s.mm}})).mm"


def _snap(value: str) -> str:
    return f"list_min(list_transform({_LADDER}, lambda v: {{'d': abs(v - ({value})), 'v': v}})).v"


_CASES = lambda patterns: "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for p, n in patterns) + " END"
LABELS = f"""raw AS (SELECT p_partkey AS id, {label_sql()} AS raw FROM part),
up AS (SELECT *, trim(upper(raw)) AS t FROM raw),
parts AS (SELECT *, regexp_extract(t, '(\\d+)?\\s*(\\d)\\s*/\\s*(\\d)\\s*["”]', ['w', 'a', 'b']) AS f, regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*["”]', 1) AS inch, regexp_extract(t, '(\\d{{2,4}})\\s*(?:MM|M\\.M\\.)', 1) AS mm, regexp_extract(t, '^(\\d{{2,4}})$', 1) AS bare FROM up),
inches AS (SELECT *, CASE WHEN f.a = '' THEN NULL WHEN f.w <> '' AND try_cast(f.w AS DOUBLE) <> 0 THEN try_cast(f.w AS DOUBLE) + try_cast(f.a AS DOUBLE) / try_cast(f.b AS DOUBLE) WHEN f.w = '' AND try_cast(f.a AS DOUBLE) / try_cast(f.b AS DOUBLE) < 1 THEN 1 + try_cast(f.a AS DOUBLE) / try_cast(f.b AS DOUBLE) ELSE try_cast(f.a AS DOUBLE) / try_cast(f.b AS DOUBLE) END AS fraction FROM parts),
read AS (SELECT id, raw, t,
  CASE WHEN mm <> '' THEN try_cast(mm AS DOUBLE) WHEN fraction IS NOT NULL THEN {_closest("fraction")} WHEN inch <> '' THEN {_closest("try_cast(inch AS DOUBLE)")} WHEN bare <> '' AND try_cast(bare AS DOUBLE) BETWEEN 15 AND 2000 THEN try_cast(bare AS DOUBLE) END AS diameter_mm,
  {_CASES(labels.MATERIALS)} AS material, {_CASES(labels.ASSETS)} AS asset FROM inches)"""


@memo
def read_labels(spark, sf_dir):
    return labels.parse_labels(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{label_sql()} AS raw"), "raw")


@query("annotation_parse", f"WITH {LABELS} SELECT id, raw, diameter_mm, material, asset FROM read")
def annotation_parse(spark, sf_dir):
    return read_labels(spark, sf_dir)


@query("inch_to_mm", f"SELECT p_partkey AS id, {_closest('p_size / 3.0::DOUBLE')} AS mm, {_snap(_closest('p_size / 3.0::DOUBLE'))} AS ladder_mm FROM part")
def inch_to_mm(spark, sf_dir):
    inch = F.col("p_size") / F.lit(3.0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), labels.inch_to_mm(inch).alias("mm"), labels.inch_to_mm(inch, LADDER).alias("ladder_mm"))


@query("ladder_snap", f"SELECT p_partkey AS id, {_snap('p_size * 8.5')} AS mm FROM part")
def ladder_snap(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), labels.snap(F.col("p_size") * F.lit(8.5), LADDER).alias("mm"))


@query("ladder_next", f"SELECT p_partkey AS id, greatest({_snap('p_size * 5.0')}, coalesce(list_min(list_filter({_LADDER}, lambda v: v >= p_size * 9.0)), 400)) AS mm FROM part")
def ladder_next(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), labels.next_size(size * F.lit(9.0), labels.snap(size * F.lit(5.0), LADDER), LADDER).alias("mm"))


@query("velocity_required_diameter", "SELECT l_orderkey, l_linenumber, sqrt(4 * (abs(l_quantity) / 1000) / (pi() * 1.5)) * 1000 AS need_mm, 4 * (abs(l_quantity) / 1000) / (pi() * (100.0::DOUBLE / 1000) * (100.0::DOUBLE / 1000)) AS velocity, 4 * (abs(l_quantity) / 1000) / (pi() * (100.0::DOUBLE / 1000) * (100.0::DOUBLE / 1000)) > 6 AS too_fast FROM lineitem")
def velocity_required_diameter(spark, sf_dir):
    q = F.col("l_quantity")
    v = hydraulics.velocity(q, F.lit(100.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hydraulics.required_diameter(q, 1.5).alias("need_mm"), v.alias("velocity"), (v > 6).alias("too_fast"))


@query("total_demand", "SELECT r_regionkey, coalesce(CASE WHEN r_regionkey = 4 THEN 1000000.0::DOUBLE END, (13429 + r_regionkey) * 135.0::DOUBLE) / (CASE WHEN r_regionkey * 0.3::DOUBLE < 1 THEN 1 - r_regionkey * 0.3::DOUBLE ELSE 1 END) / 86400 AS lps FROM region")
def total_demand(spark, sf_dir):
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select("r_regionkey", hydraulics.total_demand(k + 13429, F.lit(135.0), F.when(k == 4, 1000000.0), k * F.lit(0.3)).alias("lps"))


@query("layer_pick", "SELECT DISTINCT layer FROM (SELECT split_part(p_name, ' ', 1) || CASE p_partkey % 4 WHEN 0 THEN ' water main' WHEN 1 THEN ' pipe text' WHEN 2 THEN ' building' ELSE ' supply line' END AS layer FROM part) WHERE regexp_matches(lower(layer), 'water|supply|pipe|main|wdn|distribution|line') AND NOT regexp_matches(lower(layer), '" + "|".join(layers.PIPE_VETO + layers.EXCLUDED) + "')")
def layer_pick(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 4 == 0, " water main").when(F.col("p_partkey") % 4 == 1, " pipe text").when(F.col("p_partkey") % 4 == 2, " building").otherwise(" supply line")
    features = table(spark, sf_dir, "part").select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), kind).alias("layer"), F.lit("LineString").alias("geom_type"))
    return layers.pick_layers(features)


@query("fallback_layer", "SELECT source AS layer FROM documents WHERE lang <> 'en' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1")
def fallback_layer(spark, sf_dir):
    features = table(spark, sf_dir, "documents").select(F.col("source").alias("layer"), F.when(F.col("lang") != "en", "LineString").otherwise("Point").alias("geom_type"))
    return layers.pick_layers(features)


@query("polyline_length_midpoint", """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value FROM events),
  s AS (SELECT user_id, i, sqrt(1 + (value - lag(value) OVER w) * (value - lag(value) OVER w)) AS step FROM t WINDOW w AS (PARTITION BY user_id ORDER BY i))
  SELECT user_id, count(*) AS n_points, list_reduce(list_prepend(0.0::DOUBLE, list(step ORDER BY i) FILTER (step IS NOT NULL)), lambda a, b: a + b) AS length FROM s GROUP BY user_id HAVING count(*) > 1""")
def polyline_length_midpoint(spark, sf_dir):
    nr = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    points = table(spark, sf_dir, "events").select("user_id", F.struct(nr.cast("double").alias("x"), F.col("value").alias("y")).alias("p"))
    lines = points.groupBy("user_id").agg(F.sort_array(F.collect_list("p")).alias("points")).filter("size(points) > 1")
    return lines.select("user_id", F.size("points").cast("long").alias("n_points"), topology.line_length(F.col("points")).alias("length"))


@query("quantise_dedup", """WITH t AS (SELECT user_id, ts, event_id, floor(value / 50) AS v FROM events), s AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM t)
  SELECT user_id, list(v ORDER BY ts, event_id) FILTER (before IS NULL OR before <> v) AS kept FROM s GROUP BY user_id HAVING count(*) FILTER (before IS NULL OR before <> v) >= 2""")
def quantise_dedup(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.floor(F.col("value") / 50).cast("double").alias("v")).alias("e"))
    lines = own.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e.v.alias("x"), F.lit(0.0).alias("y"))).alias("points"))
    kept = lines.select("user_id", topology.quantise(F.col("points")).alias("points")).filter("points IS NOT NULL")
    return kept.select("user_id", F.transform("points", lambda p: p.x).alias("kept"))


@query("affine_apply", f"WITH {BASE} SELECT node_id, x * 2 + y * (-0.5::DOUBLE) + 100 AS x, x * 0.5::DOUBLE + y * 2 + (-7) AS y FROM nodes")
def affine_apply(spark, sf_dir):
    x, y = geometry.affine(2.0, -0.5, 0.5, 2.0, 100.0, -7.0, F.col("x"), F.col("y"))
    return net_nodes(spark, sf_dir).select("node_id", x.alias("x"), y.alias("y"))


@query("similarity_fit")
def similarity_fit(spark, sf_dir):
    """Recovers a known turn, scale and shift; held against it in the tests."""
    m = geometry.matrix(1200.0, -340.0, 0.3, 1.7)
    u, v = geometry.affine(*m, F.col("x"), F.col("y"))
    found = geometry.similarity_fit(net_nodes(spark, sf_dir).select("x", "y", u.alias("u"), v.alias("v")))
    return spark.createDataFrame([(found["scale"], found["theta"], found["matrix"][4], found["matrix"][5], found["rms"])], "scale double, theta double, dx double, dy double, rms double")


@query("fit_to_extent", f"WITH {BASE}, m AS (SELECT (0 + 500.0::DOUBLE) / 2 - 1.0::DOUBLE * (min(x) + max(x)) / 2 AS dx, (0 + 400.0::DOUBLE) / 2 - 1.0::DOUBLE * (min(y) + max(y)) / 2 AS dy FROM nodes) SELECT node_id, x * 1.0::DOUBLE + y * 0 + dx AS x, x * 0 + y * 1.0::DOUBLE + dy AS y FROM nodes, m")
def fit_to_extent(spark, sf_dir):
    nodes = net_nodes(spark, sf_dir)
    x, y = geometry.affine(*geometry.extent_fit(nodes, (0.0, 0.0, 500.0, 400.0)), F.col("x"), F.col("y"))
    return nodes.select("node_id", x.alias("x"), y.alias("y"))


@query("bearing_check", f"WITH {BASE}, {PIPES}, b AS (SELECT link_id, length_m, floor((degrees(atan2(x2 - x1, y2 - y1)) + 360) % 360 * 1000 + 0.5) / 1000 AS bearing FROM pipes) SELECT link_id, length_m, bearing, least(abs(bearing - 90), 360 - abs(bearing - 90)) AS from_east, least(abs(bearing - 90), 360 - abs(bearing - 90)) <= 2 AS eastward FROM b")
def bearing_check(spark, sf_dir):
    pipes = net_pipes(spark, sf_dir)
    shown = F.floor(geometry.bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 1000 + 0.5) / 1000
    found = pipes.select("link_id", "length_m", shown.alias("bearing"))
    apart = geometry.angle_apart(F.col("bearing"), F.lit(90.0))
    return found.select("link_id", "length_m", "bearing", apart.alias("from_east"), (apart <= 2).alias("eastward"))


@query("polygon_area_iou", """WITH r AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 40 AS DOUBLE) AS dx FROM part)
  SELECT id, w * 10 AS area, round(greatest(0, least(w, dx + 20) - dx) * 10 / (w * 10 + 20 * 10 - greatest(0, least(w, dx + 20) - dx) * 10), 9) AS iou FROM r""")
def polygon_area_iou(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 40).cast("double").alias("dx"))
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    box = lambda x, w: F.array(corner(x, 0.0), corner(x + w, 0.0), corner(x + w, 10.0), corner(x, 10.0))
    one, other = (overlay.edges_of(parts.select("id", F.array(ring).alias("parts")), "id") for ring in (box(F.lit(0.0), F.col("w")), box(F.col("dx"), F.lit(20.0))))
    shares = overlay.overlap(one, other, 25.0).select(F.col("plane").alias("id"), F.round("iou", 9).alias("iou"))
    return parts.select("id", geometry.polygon_area(box(F.lit(0.0), F.col("w"))).alias("area")).join(shares, "id")


@query("utm_project")
def utm_project(spark, sf_dir):
    """There and back for a grid of places; held against known places in the tests."""
    grid = spark.range(400).select((F.col("id") % 20 * 0.3 + 72.05).alias("lon"), (F.floor(F.col("id") / 20) * 4.0 + 0.5).alias("lat"))
    x, y = geometry.to_utm(F.col("lon"), F.col("lat"), 43)
    placed = grid.select("lon", "lat", geometry.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), x.alias("x"), y.alias("y"))
    lon, lat = geometry.from_utm(F.col("x"), F.col("y"), 43)
    return placed.select("*", lon.alias("lon_back"), lat.alias("lat_back"))
