"""Sharing a total demand out to nodes."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.operators import outline, overlay
from netweave.operators.spatial import in_polygon, k_nearest, radius_join
from netweave.session import cut


def grid_points(spark, box: tuple[float, float, float, float], step: float) -> DataFrame:
    """(cell, x, y): centres of square cells that cover a box."""
    wide, high = max(1, int((box[2] - box[0]) / step)), max(1, int((box[3] - box[1]) / step))
    i, j = F.col("id") % wide, F.floor(F.col("id") / wide)
    return spark.range(wide * high).select(F.col("id").alias("cell"), (F.lit(box[0]) + (i + 0.5) * step).alias("x"), (F.lit(box[1]) + (j + 0.5) * step).alias("y"))


def service_area(cells: DataFrame, nodes: DataFrame, ring: list[tuple[float, float]] | None, reach: float) -> DataFrame:
    """The cells inside the boundary and within reach of a node."""
    inside = cells.filter(in_polygon(F.col("x"), F.col("y"), ring)) if ring else cells
    served = radius_join(inside, nodes.select("x", "y"), reach).select(F.col("l.cell").alias("cell")).distinct()
    return inside.join(served, "cell", "left_semi")


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a straight segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length))).otherwise(F.lit(0.0))
    px, py = x - (ax + t * dx), y - (ay + t * dy)
    return F.sqrt(px * px + py * py)


def network_service_area(cells: DataFrame, pipes: DataFrame, ring: list[tuple[float, float]] | None, reach: float) -> DataFrame:
    """The cells inside the boundary and within reach of a pipe (x1, y1, x2,
    y2), anywhere along it. If there are none, all cells inside the boundary.

    Cells are posted to the squares around their own, and points along each pipe,
    at most reach apart, meet the cells posted to theirs; pipes, which are many,
    are not repeated for the squares around them."""
    inside = cells.filter(in_polygon(F.col("x"), F.col("y"), ring)) if ring else cells
    side = 1.25 * reach  # what is within reach of a pipe is in a square next to one of its points
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    steps = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / reach), F.lit(1))
    along = pipes.select("x1", "y1", "x2", "y2").distinct().withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    share = F.col("i") / F.col("n")
    points = along.select("x1", "y1", "x2", "y2", F.floor((F.col("x1") + share * dx) / side).alias("cx"), F.floor((F.col("y1") + share * dy) / side).alias("cy"))
    around = F.array(*[F.struct((F.floor(F.col("x") / side) + i).alias("cx"), (F.floor(F.col("y") / side) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    placed = inside.select("cell", "x", "y", F.explode(around).alias("at")).select("cell", "x", "y", "at.cx", "at.cy")
    near = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]) <= reach
    served = points.join(placed, ["cx", "cy"]).filter(near).select("cell").distinct()
    found = inside.join(served, "cell", "left_semi")
    return found if found.take(1) else inside


def too_concentrated(shares: DataFrame, limit: float = 0.05) -> bool:
    """Whether one node takes more than that part of all demand, of what
    ``concentration`` gives; warns if so."""
    share = shares.first()["top1_share"]
    if share is not None and share > limit:
        warnings.warn(f"one node takes {share:.1%} of the demand", stacklevel=2)
        return True
    return False


def served_ground(boundary: DataFrame | None, pipes: DataFrame | None, nodes: DataFrame, reach: float | None, radius: float = 60.0, apart: float = 45.0) -> DataFrame:
    """The ground that demand is spread over, as an area of plane 0: the boundary
    (an area), of that what is within reach of a pipe (x1, y1, x2, y2) where there is
    any; without a boundary the outline of the nodes and what is within ``apart`` of
    it or of a node."""
    if boundary is None or not boundary.take(1):
        return outline.footprint(nodes, "node_id", radius, apart)
    if reach and pipes is not None:
        ways = pipes.select(F.lit(0).cast("long").alias("plane"), *[F.round(c, overlay.DIGITS).alias(n) for c, n in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"))])
        tips = ways.select("plane", F.col("ax").alias("x"), F.col("ay").alias("y")).union(ways.select("plane", "bx", "by")).distinct()
        lines = ways.filter("ax <> bx OR ay <> by")
        both = lines.union(lines.select("plane", F.col("bx"), F.col("by"), F.col("ax"), F.col("ay"))).distinct()
        near = overlay.combined(boundary, overlay.buffered(both, reach, lone=tips), "intersection", max(reach / 4, 1.0))
        near = cut(near)
        if near.take(1):
            return near
    return boundary


def thiessen_areas(nodes: DataFrame, ground: DataFrame) -> DataFrame:
    """(node_id, area): of the ground, an area of plane 0, what is nearer to a
    node than to any other, exactly; 0 for nodes without any."""
    found = overlay.area(outline.thiessen(nodes, "node_id", ground)).withColumnRenamed("plane", "node_id")
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("area", F.lit(0.0)).alias("area"))


def voronoi_share(cells: DataFrame, nodes: DataFrame, step: float) -> DataFrame:
    """(node_id, n_cells, area): the cells nearest to each node, ties to the
    smaller id; a Voronoi cell to the grid's accuracy. Nodes without a cell
    have area 0."""
    owner = k_nearest(cells, nodes, "cell", "node_id", 1)
    counted = owner.groupBy(F.col("target").alias("node_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", n.alias("n_cells"), (n * (step * step)).cast("double").alias("area"))


def half_lengths(links: DataFrame, src: str = "node1", dst: str = "node2", length: str = "length_m") -> DataFrame:
    """(node_id, weight): half the length of each node's links."""
    half = F.sum((F.col(length) / 2).cast("decimal(28,9)")).cast("double")
    return links.select(F.explode(F.array(src, dst)).alias("node_id"), length).groupBy("node_id").agg(half.alias("weight"))


def share(weights: DataFrame, total: float, weight: str = "weight") -> Column:
    """A node's part of a total by weight, evenly if all weights are 0. The
    weights' sum is one row, joined by a window over all rows' sum; use it on a
    frame with that sum as ``weight_sum`` and ``n``."""
    return F.when(F.col("weight_sum") > 0, F.col(weight) / F.col("weight_sum") * total).otherwise(F.lit(total) / F.col("n"))


def allocate(nodes: DataFrame, total: float, method: str = "uniform", links: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """(node_id, demand) by ``voronoi`` (areas: node_id, area), ``pipe_length``
    (links) or ``uniform``; any other method is uniform, with a warning."""
    weighted = nodes.select("node_id")
    if method == "voronoi" and areas is not None:
        weighted = weighted.join(areas.select("node_id", F.col("area").alias("weight")), "node_id", "left")
    elif method == "pipe_length" and links is not None:
        weighted = weighted.join(half_lengths(links), "node_id", "left")
    else:
        if method != "uniform":
            warnings.warn(f"no method {method!r}: shared evenly", stacklevel=2)
        weighted = weighted.withColumn("weight", F.lit(1.0))
    weighted = weighted.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sums = weighted.agg(F.sum(F.col("weight").cast("decimal(28,9)")).cast("double").alias("weight_sum"), F.count("*").alias("n"))
    return weighted.crossJoin(F.broadcast(sums)).select("node_id", share(weighted, total).alias("demand"))  # sums: one row


def concentration(demands: DataFrame, demand: str = "demand", top: int = 10) -> DataFrame:
    """(total, top1_share, top10_share): how much of all the largest nodes
    take, null where there is nothing to take; the largest are found without sorting all nodes."""
    exact = F.col(demand).cast("decimal(28,9)")
    sums = demands.agg(F.sum(exact).cast("double").alias("total"))
    first = demands.orderBy(F.desc(demand)).limit(top).withColumn("nr", F.row_number().over(W.orderBy(F.desc(demand))))  # top rows
    best = first.agg(F.sum(F.when(F.col("nr") == 1, exact)).cast("double").alias("one"), F.sum(exact).cast("double").alias("ten"))
    some = F.nullif(F.col("total"), F.lit(0.0))
    return sums.crossJoin(best).select("total", (F.col("one") / some).alias("top1_share"), (F.col("ten") / some).alias("top10_share"))  # one row each
