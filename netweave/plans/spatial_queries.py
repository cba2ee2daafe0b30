"""Joins by distance, shapes and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.operators import demand, spatial
from netweave.plans.fixtures import BASE, PIPES, net_links, net_nodes, net_pipes
from netweave.plans.registry import query
from netweave.session import shared_path, table

RING = [(100.0, 100.0), (900.0, 150.0), (850.0, 900.0), (500.0, 450.0), (150.0, 800.0)]
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
SPLIT = f"WITH {BASE}, q AS (SELECT * FROM nodes WHERE node_id % 2 = 0), t AS (SELECT * FROM nodes WHERE node_id % 2 = 1) "


def halves(spark, sf_dir):
    nodes = net_nodes(spark, sf_dir)
    return nodes.filter("node_id % 2 = 0"), nodes.filter("node_id % 2 = 1")


@query("nearest_label", SPLIT + f"SELECT query, best.id AS target, best.d AS distance FROM (SELECT a.node_id AS query, min(struct_pack(d := {_D}, id := b.node_id)) AS best FROM q a, t b GROUP BY a.node_id)")
def nearest_label(spark, sf_dir):
    return spatial.k_nearest(*halves(spark, sf_dir), "node_id", "node_id", 1).select("query", "target", "distance")


@query("nearest_with_cutoff", SPLIT + f"SELECT query, best.id AS target, best.d AS distance FROM (SELECT a.node_id AS query, min(struct_pack(d := {_D}, id := b.node_id)) AS best FROM q a, t b WHERE {_D} <= 12 GROUP BY a.node_id)")
def nearest_with_cutoff(spark, sf_dir):
    return spatial.nearest_within(*halves(spark, sf_dir), "node_id", "node_id", 12.0)


KNN = SPLIT + f", near AS (SELECT a.node_id AS query, b.node_id AS target, b.elevation_m AS v, {_D} AS distance, row_number() OVER (PARTITION BY a.node_id ORDER BY {_D}, b.node_id) AS rank FROM q a, t b QUALIFY rank <= 6) "


@query("knn_idw", KNN + "SELECT query, list_reduce(list_prepend(0.0::DOUBLE, list(v * (1 / greatest(distance, 1e-6)) ORDER BY rank)), lambda a, b: a + b) / list_reduce(list_prepend(0.0::DOUBLE, list(1 / greatest(distance, 1e-6) ORDER BY rank)), lambda a, b: a + b) AS mean FROM near GROUP BY query")
def knn_idw(spark, sf_dir):
    queries, targets = halves(spark, sf_dir)
    return spatial.inverse_distance_mean(spatial.k_nearest(queries, targets, "node_id", "node_id", 6), targets, "node_id", "elevation_m")


@query("k_nearest", KNN + "SELECT query, CAST(rank AS INTEGER) AS rank, target, distance FROM near")
def k_nearest(spark, sf_dir):
    return spatial.k_nearest(*halves(spark, sf_dir), "node_id", "node_id", 6)


@query("radius_pairs", f"WITH {BASE} SELECT a.node_id AS a, b.node_id AS b, {_D} AS distance FROM nodes a JOIN nodes b ON a.node_id < b.node_id AND {_D} <= 25")
def radius_pairs(spark, sf_dir):
    return spatial.radius_pairs(net_nodes(spark, sf_dir), "node_id", 25.0)


@query("neighbourhood_mean", f"WITH {BASE} SELECT a.node_id, CAST(sum(CAST(b.elevation_m AS DECIMAL(28,6))) AS DOUBLE) / count(b.elevation_m) AS mean, count(*) AS n FROM nodes a JOIN nodes b ON {_D} <= 25 GROUP BY a.node_id")
def neighbourhood_mean(spark, sf_dir):
    return spatial.neighbourhood_mean(net_nodes(spark, sf_dir), "node_id", "elevation_m", 25.0)


@query("closest_pair_between_groups", f"WITH {BASE} SELECT a.node_id AS a, b.node_id AS b, {_D} AS distance FROM nodes a, nodes b WHERE a.cluster = 1 AND b.cluster = 2 ORDER BY 3, 1, 2 LIMIT 1")
def closest_pair_between_groups(spark, sf_dir):
    return spatial.closest_between_groups(net_nodes(spark, sf_dir), "node_id", "cluster", 1, 2)


def _winding(x: str, y: str) -> str:
    parts, edge = [], []
    for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1], strict=True):
        parts.append(f"CASE WHEN ({y} < {ay}) <> ({y} < {by}) AND {x} < ({bx - ax}::DOUBLE) * ({y} - {ay}::DOUBLE) / ({by - ay}::DOUBLE) + {ax}::DOUBLE THEN 1 ELSE 0 END")
        edge.append(f"(({x} - {ax}) * {by - ay}::DOUBLE = ({y} - {ay}) * {bx - ax}::DOUBLE AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
    return f"({' + '.join(parts)}) % 2 = 1 AND NOT ({' OR '.join(edge)})"


def _within(x: str, y: str, far: float) -> str:
    near = []
    for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1], strict=True):
        px, py = bx - ax, by - ay
        t = f"greatest(0, least(1, (({x} - {ax}) * {px} + ({y} - {ay}) * {py}) / {px * px + py * py}::DOUBLE))"
        near.append(f"({x} - {ax} - {t} * {px}) ** 2 + ({y} - {ay} - {t} * {py}) ** 2 <= {far * far}")
    return f"({' OR '.join(near)})"


@query("point_in_polygon", f"WITH {BASE} SELECT node_id FROM nodes WHERE {_winding('x', 'y')}")
def point_in_polygon(spark, sf_dir):
    return net_nodes(spark, sf_dir).filter(spatial.in_polygon(F.col("x"), F.col("y"), RING)).select("node_id")


@query("bbox_filter", f"WITH {BASE} SELECT node_id FROM nodes WHERE x BETWEEN 200 AND 600 AND y BETWEEN 100 AND 500.5")
def bbox_filter(spark, sf_dir):
    return net_nodes(spark, sf_dir).filter(spatial.in_box("x", "y", (200.0, 100.0, 600.0, 500.5))).select("node_id")


GRID = f"""WITH {BASE}, few AS (SELECT * FROM nodes), cells AS (SELECT range AS cell, 0 + (range % 20 + 0.5::DOUBLE) * 50 AS x, 0 + (floor(range / 20) + 0.5::DOUBLE) * 50 AS y FROM range(400)),
  owner AS (SELECT a.cell, arg_min(b.node_id, struct_pack(d := {_D}, id := b.node_id)) AS node_id FROM cells a, few b GROUP BY a.cell) """


def cells(spark):
    return demand.grid_points(spark, (0.0, 0.0, 1000.0, 1000.0), 50.0)


@query("voronoi_grid_share", GRID + "SELECT few.node_id, count(owner.cell) AS n_cells, CAST(count(owner.cell) * 2500.0 AS DOUBLE) AS area FROM few LEFT JOIN owner USING (node_id) GROUP BY few.node_id")
def voronoi_grid_share(spark, sf_dir):
    return demand.voronoi_share(cells(spark), net_nodes(spark, sf_dir), 50.0)


@query("service_area", GRID + f"SELECT DISTINCT a.cell, a.x, a.y FROM cells a JOIN few b ON {_D} <= 40 WHERE {_winding('a.x', 'a.y')}")
def service_area(spark, sf_dir):
    return demand.service_area(cells(spark), net_nodes(spark, sf_dir), RING, 40.0)


_SEGMENT = """(SELECT cell, CASE WHEN px * px + py * py > 0 THEN greatest(0, least(1, (qx * px + qy * py) / (px * px + py * py))) ELSE 0 END AS t, px, py, qx, qy FROM (
  SELECT cell, x2 - x1 AS px, y2 - y1 AS py, cells.x - x1 AS qx, cells.y - y1 AS qy FROM cells, pipes))"""


@query("network_service_area", f"WITH {BASE}, {PIPES}, cells AS (SELECT range AS cell, (range % 20 + 0.5::DOUBLE) * 50 AS x, (floor(range / 20) + 0.5::DOUBLE) * 50 AS y FROM range(400)), near AS (SELECT DISTINCT cell FROM {_SEGMENT} WHERE sqrt((qx - t * px) * (qx - t * px) + (qy - t * py) * (qy - t * py)) <= 5) SELECT cell, x, y FROM cells JOIN near USING (cell) WHERE {_winding('x', 'y')}")
def network_service_area(spark, sf_dir):
    """Cells within 5 m of a pipe, anywhere along it."""
    return demand.network_service_area(cells(spark), net_pipes(spark, sf_dir), RING, 5.0)


@query("alloc_voronoi", GRID + "SELECT few.node_id, CAST(count(owner.cell) * 2500.0 AS DOUBLE) / CAST(1000000 AS DOUBLE) * 20.98::DOUBLE AS demand FROM few LEFT JOIN owner USING (node_id) GROUP BY few.node_id")
def alloc_voronoi(spark, sf_dir):
    return demand.allocate(net_nodes(spark, sf_dir), 20.98, "voronoi", areas=voronoi_grid_share(spark, sf_dir))


@query("alloc_uniform", f"WITH {BASE} SELECT node_id, 20.98::DOUBLE / (SELECT count(*) FROM nodes) AS demand FROM nodes")
def alloc_uniform(spark, sf_dir):
    return demand.allocate(net_nodes(spark, sf_dir), 20.98)


HALVES = f"WITH {BASE}, {PIPES}, w AS (SELECT node_id, CAST(sum(CAST(length_m / 2 AS DECIMAL(28,9))) AS DOUBLE) AS weight FROM (SELECT node1 AS node_id, length_m FROM pipes UNION ALL SELECT node2, length_m FROM pipes) GROUP BY node_id) "


@query("half_length_weights", HALVES + "SELECT node_id, weight FROM w")
def half_length_weights(spark, sf_dir):
    return demand.half_lengths(net_pipes(spark, sf_dir))


@query("alloc_pipe_length", HALVES + "SELECT nodes.node_id, coalesce(weight, 0) / (SELECT CAST(sum(CAST(weight AS DECIMAL(28,9))) AS DOUBLE) FROM w) * 20.98::DOUBLE AS demand FROM nodes LEFT JOIN w USING (node_id)")
def alloc_pipe_length(spark, sf_dir):
    return demand.allocate(net_nodes(spark, sf_dir), 20.98, "pipe_length", links=net_pipes(spark, sf_dir))


@query("demand_concentration", f"WITH {BASE}, top AS (SELECT CAST(demand_lps AS DECIMAL(28,9)) AS d, row_number() OVER (ORDER BY demand_lps DESC) AS nr FROM nodes), s AS (SELECT CAST(sum(d) AS DOUBLE) AS total, CAST(sum(d) FILTER (nr = 1) AS DOUBLE) AS one, CAST(sum(d) FILTER (nr <= 10) AS DOUBLE) AS ten FROM top) SELECT total, one / total AS top1_share, ten / total AS top10_share FROM s")
def demand_concentration(spark, sf_dir):
    return demand.concentration(net_nodes(spark, sf_dir), "demand_lps")


@query("raster_sample", f"""WITH {BASE}, dem AS (SELECT CAST(range // 40 AS INTEGER) AS row, CAST(range % 40 AS INTEGER) AS col, CAST((range * 37) % 101 AS DOUBLE) AS z FROM range(1600) WHERE range % 7 > 0)
  SELECT node_id, coalesce(z, 5) + 1.5::DOUBLE AS z, z IS NULL AS filled FROM nodes LEFT JOIN dem ON dem.col = CAST(floor((x - 0) / 25) AS INTEGER) AND dem.row = CAST(floor((1000 - y) / 25) AS INTEGER)""")
def raster_sample(spark, sf_dir):
    from netweave.sources import layers

    dem = spark.range(1600).filter("id % 7 > 0").selectExpr("CAST(id DIV 40 AS INT) AS row", "CAST(id % 40 AS INT) AS col", "CAST((id * 37) % 101 AS DOUBLE) AS z")
    return layers.sample_raster(net_nodes(spark, sf_dir), dem, "node_id", (0.0, 1000.0), (25.0, 25.0), fill="constant", constant=5.0, offset=1.5)


#: Heights by cells of 25 m, the mean of what stands there, cut out of tiles for RING and 40 m around it.
_DEM = f"""WITH {BASE}, dem AS (SELECT CAST(floor((1000 - y) / 25) AS INTEGER) AS row, CAST(floor(x / 25) AS INTEGER) AS col, CAST(sum(CAST(elevation_m AS DECIMAL(28,6))) AS DOUBLE) / count(elevation_m) AS z FROM nodes GROUP BY ALL),
  centred AS (SELECT *, (col + 0.5::DOUBLE) * 25 AS x, 1000 - (row + 0.5::DOUBLE) * 25 AS y FROM dem),
  kept AS (SELECT row, col, z FROM centred WHERE {_winding('x', 'y')} OR {_within('x', 'y', 40)}) """


def _prepared(spark, sf_dir, grid):
    from netweave.operators.placement import exact_mean
    from netweave.sources import raster

    nodes = net_nodes(spark, sf_dir)
    row, col = grid.place(F.col("x"), F.col("y"))
    path = shared_path(spark, "dem")
    raster.write_tiles(nodes.groupBy(row.alias("row"), col.alias("col")).agg(exact_mean("elevation_m").alias("z")), path, grid)
    ground = spark.createDataFrame([("Polygon", [[(x, y) for x, y in RING]])], "geom_type string, parts array<array<struct<x:double,y:double>>>")
    return raster.prepare(ground, path, grid, buffer=40.0)


@query("raster_prepare", _DEM + "SELECT row, col, z FROM kept")
def raster_prepare(spark, sf_dir):
    from netweave.sources.raster import Grid

    return _prepared(spark, sf_dir, Grid(0.0, 1000.0, 25.0, 25.0, 16))


@query("raster_tile_sample", _DEM + "SELECT node_id, coalesce(z, -1) + 1.5::DOUBLE AS z, z IS NULL AS filled FROM nodes LEFT JOIN kept ON col = CAST(floor(x / 25) AS INTEGER) AND row = CAST(floor((1000 - y) / 25) AS INTEGER)")
def raster_tile_sample(spark, sf_dir):
    """All nodes on the raster that raster_prepare gives, written in tiles again."""
    from netweave.sources import raster

    grid, path = raster.Grid(0.0, 1000.0, 25.0, 25.0, 16), shared_path(spark, "prepared")
    raster.write_tiles(_prepared(spark, sf_dir, grid), path, grid)
    return raster.sample_tiles(net_nodes(spark, sf_dir), path, grid, "node_id", fill="constant", constant=-1.0, offset=1.5)


@query("left_join_flags", "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_flags(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("top"))


@query("semi_join_selected", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_selected(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("anti_join_unselected", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_unselected(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("anti_join_small", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join_small(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("link_join_two_sided", f"WITH {BASE} SELECT link_id, a.elevation_m - b.elevation_m AS drop_m, a.node_type AS from_type, b.node_type AS to_type FROM links JOIN nodes a ON a.node_id = node1 JOIN nodes b ON b.node_id = node2")
def link_join_two_sided(spark, sf_dir):
    nodes = net_nodes(spark, sf_dir)
    a, b = (nodes.select(F.col("node_id").alias(k), F.col("elevation_m").alias(f"{k}_z"), F.col("node_type").alias(t)) for k, t in (("node1", "from_type"), ("node2", "to_type")))
    return net_links(spark, sf_dir).join(a, "node1").join(b, "node2").select("link_id", (F.col("node1_z") - F.col("node2_z")).alias("drop_m"), "from_type", "to_type")
