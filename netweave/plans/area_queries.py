"""Outlines, areas laid over each other, and who is nearest to which ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.operators import demand, outline, overlay, zones
from netweave.plans.fixtures import BASE, memo, net_nodes
from netweave.plans.registry import query
from netweave.plans.spatial_queries import RING

RADIUS = 40.0123
HOLE = [(300.0, 250.0), (500.0, 250.0), (500.0, 380.0), (300.0, 380.0)]
_OUTLINE = f"""WITH {BASE}, p AS (SELECT min(node_id) AS id, x, y FROM nodes GROUP BY x, y),
  pr AS (SELECT a.id AS a, b.id AS b, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {2 * RADIUS}),
  h AS (SELECT *, sqrt(greatest({RADIUS * RADIUS} - ((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy)) / 4, 0)) / d AS high FROM pr),
  c AS (SELECT a, b, way, (ux + vx) / 2 - way * high * (vy - uy) AS cx, (uy + vy) / 2 + way * high * (vx - ux) AS cy FROM h, (VALUES (1), (-1)) w(way)),
  held AS (SELECT DISTINCT a, b, way FROM c JOIN p ON p.id <> a AND p.id <> b AND sqrt((cx - p.x) * (cx - p.x) + (cy - p.y) * (cy - p.y)) < {RADIUS * (1 - outline.RIM)}),
  e AS (SELECT a, b, min(way) AS way FROM held GROUP BY a, b HAVING count(*) = 1),
  edges AS (SELECT CASE WHEN way = 1 THEN a ELSE b END AS a, CASE WHEN way = 1 THEN b ELSE a END AS b FROM e) """


@memo
def node_outline(spark, sf_dir):
    return outline.alpha_edges(net_nodes(spark, sf_dir), "node_id", RADIUS)


@query("outline_edges", _OUTLINE + "SELECT a, b FROM edges")
def outline_edges(spark, sf_dir):
    """The outline of all nodes."""
    return node_outline(spark, sf_dir).select("a", "b")


@query("outline_area", _OUTLINE + "SELECT count(*) AS n_edges, CAST(sum(CAST((p.x * q.y - q.x * p.y) / 2 AS DECIMAL(38,6))) AS DOUBLE) AS area FROM edges JOIN p ON p.id = a JOIN p q ON q.id = b")
def outline_area(spark, sf_dir):
    edges = node_outline(spark, sf_dir).withColumn("plane", F.lit(0))
    return overlay.area(edges).crossJoin(edges.agg(F.count("*").alias("n_edges"))).select("n_edges", "area")  # one row each


_BOXES = f"""WITH {BASE}, b AS (SELECT cluster, node_id % 2 AS half, x - (2 + node_id % 5) AS west, x + (2 + node_id % 5) AS east, y - (3 + node_id % 4) AS south, y + (3 + node_id % 4) AS north FROM nodes),
  xs AS (SELECT cluster, v AS x1, lead(v) OVER (PARTITION BY cluster ORDER BY v) AS x2 FROM (SELECT cluster, west AS v FROM b UNION SELECT cluster, east FROM b)),
  ys AS (SELECT cluster, v AS y1, lead(v) OVER (PARTITION BY cluster ORDER BY v) AS y2 FROM (SELECT cluster, south AS v FROM b UNION SELECT cluster, north FROM b)),
  cells AS (SELECT b.cluster, x1, y1, (x2 - x1) * (y2 - y1) AS size, max(half) AS odd, max(1 - half) AS even
    FROM b JOIN xs ON xs.cluster = b.cluster AND x1 >= west AND x2 <= east JOIN ys ON ys.cluster = b.cluster AND y1 >= south AND y2 <= north GROUP BY ALL) """


def _boxes(spark, sf_dir, half=None):
    """Boxes round the nodes, those of a cluster in one plane."""
    w, h = 2 + F.col("node_id") % 5, 3 + F.col("node_id") % 4
    corner = lambda i, j: F.struct((F.col("x") + i * w).alias("x"), (F.col("y") + j * h).alias("y"))
    nodes = net_nodes(spark, sf_dir) if half is None else net_nodes(spark, sf_dir).filter(F.col("node_id") % 2 == half)
    return overlay.edges_of(nodes.select("cluster", F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("parts")), "cluster")


@query("dissolved_boxes", _BOXES + "SELECT cluster, round(sum(size), 3) AS area FROM cells GROUP BY cluster")
def dissolved_boxes(spark, sf_dir):
    """The ground that boxes of all nodes of a cluster cover, however they overlap."""
    found = overlay.area(overlay.dissolve(_boxes(spark, sf_dir), 8.0))
    return found.select(F.col("plane").alias("cluster"), F.round("area", 3).alias("area"))


@query("overlay_shares", _BOXES + "SELECT cluster, round(sum(size), 3) AS whole, round(sum(size * odd * even), 3) AS shared, round(round(sum(size * odd * even), 3) / round(sum(size), 3), 6) AS iou FROM cells GROUP BY cluster")
def overlay_shares(spark, sf_dir):
    """What the boxes of a cluster's even nodes share with those of its odd ones."""
    even, odd = (overlay.dissolve(_boxes(spark, sf_dir, half), 8.0) for half in (0, 1))
    found = overlay.overlap(even, odd, 8.0).select(F.col("plane").alias("cluster"), F.round("union", 3).alias("whole"), F.round("intersection", 3).alias("shared"))
    return found.select("*", F.round(F.col("shared") / F.col("whole"), 6).alias("iou"))


@memo
def ground(spark, sf_dir):
    """A boundary with a hole in it."""
    from netweave.sources import boundary

    points = lambda ring: [(float(x), float(y)) for x, y in ring]
    features = spark.createDataFrame([("Polygon", [points(RING), points(HOLE)])], "geom_type string, parts array<array<struct<x: double, y: double>>>")
    return boundary.load_boundary(features)


@query("thiessen_areas")
def thiessen_areas(spark, sf_dir):
    """Each node's part of a boundary with a hole; held against grid shares and
    against the boundary's area in the tests."""
    return demand.thiessen_areas(net_nodes(spark, sf_dir), ground(spark, sf_dir))


@query("zone_polygons")
def zone_polygons(spark, sf_dir):
    """The ground of each cluster's middle, as rings; their areas add up to the
    boundary's in the tests."""
    middle = net_nodes(spark, sf_dir).groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return zones.zone_polygons(middle, ground(spark, sf_dir))
