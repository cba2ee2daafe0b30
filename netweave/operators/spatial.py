"""Joins by distance. The plane is cut into square cells as wide as the radius,
one side is posted to its cell and the eight around, and the join is one on
equal cells with an exact test; no pair further apart than that is ever made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cell(x: Column | str, y: Column | str, size: float) -> tuple[Column, Column]:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")


def _around(df: DataFrame, size: float) -> DataFrame:
    """df in each of the nine cells around its own."""
    cx, cy = cell("x", "y", size)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.select("*", cx, cy, F.explode(steps).alias("step")).withColumn("cx", F.col("cx") + F.col("step.i")).withColumn("cy", F.col("cy") + F.col("step.j")).drop("step")


def _apart(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of left and right (structs l, r) at most radius apart, with
    ``distance``. Both have columns x and y."""
    one = left.select(F.struct("*").alias("l"), *cell("x", "y", radius))
    other = _around(right, radius).select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("r"), "cx", "cy")
    return one.join(other, ["cx", "cy"]).select("l", "r", _apart("l", "r").alias("distance")).filter(F.col("distance") <= radius)


def radius_pairs(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(a, b, distance): pairs of points with a < b at most radius apart."""
    own = points.select(F.col(key).alias("id"), "x", "y")
    return radius_join(own, own, radius).filter("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "distance")


def clusters(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, cluster): the smallest key among the points that a point is joined to
    by steps of at most radius (0 or more). Points at one place are one from the
    start; a point without a finite place is by itself."""
    from netweave.operators.components import connected_components
    from netweave.session import cut

    own = points.select(F.col(key).alias("id"), "x", "y")
    places = cut(own.filter(finite("x", "y")).groupBy("x", "y").agg(F.min("id").alias("id")))  # named by their smallest key
    found = connected_components(radius_pairs(places, "id", radius), "a", "b")
    named = places.join(found, places["id"] == found["node"], "left").select("x", "y", F.coalesce("component", "id").alias("cluster"))
    return own.join(named, ["x", "y"], "left").select(F.col("id").alias(key), F.coalesce("cluster", "id").alias("cluster"))


def neighbourhood_mean(points: DataFrame, key: str, value: str, radius: float) -> DataFrame:
    """(key, mean, n) of the values within the radius, its own included; a
    radius of 0 or less leaves values as they are. What lies at one place is summed
    first (as decimals, so the sums are the same), and places are joined, so heaps
    of points at a place are not compared with each other."""
    own = points.select(F.col(key).alias("id"), "x", "y", F.col(value).cast("double").alias("v"))
    if radius <= 0:
        return own.select(F.col("id").alias(key), F.col("v").alias("mean"), F.lit(1).cast("long").alias("n"))
    from netweave.session import cut

    own = own.filter(finite("x", "y"))
    places = cut(own.groupBy("x", "y").agg(F.sum(F.col("v").cast("decimal(28,6)")).alias("total"), F.count("v").alias("known"), F.count("*").alias("n")))
    sums = radius_join(places.select("x", "y"), places, radius).groupBy("l.x", "l.y").agg((F.sum("r.total").cast("double") / F.sum("r.known")).alias("mean"), F.sum("r.n").alias("n"))
    return own.join(sums, ["x", "y"]).select(F.col("id").alias(key), "mean", "n")


def nearest_within(queries: DataFrame, targets: DataFrame, query_key: str, target_key: str, radius: float) -> DataFrame:
    """(query, target, distance): the nearest target at most radius away, of
    equals the one with the smallest key; none without such a target. Found as the
    nearest of all, so its cost follows how many rows there are and not how many
    targets lie within the radius."""
    return k_nearest(queries, targets, query_key, target_key, 1).filter(F.col("distance") <= radius).select("query", "target", "distance")


def finite(*columns: str) -> Column:
    """Whether all of these are numbers, and neither NaN nor infinite."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return found


#: Levels of cells at most, each half as wide as the one before.
LEVELS = 24


def k_nearest(queries: DataFrame, targets: DataFrame, query_key: str, target_key: str, k: int = 1) -> DataFrame:
    """(query, rank, target, distance): the k nearest targets of every query, all
    targets where there are fewer; rows without a finite place take no part.

    The targets' box is cut into cells of many sizes and the targets in each
    counted. The smallest cell round a query with k targets or more says how far
    the k-th can be, so one join on cells of that width finds them, whether the
    targets lie even or in heaps. A query outside the box is looked up where the box
    is nearest to it. What lies at one place is searched once, and of targets at one
    place those with the k smallest keys count.
    """
    from netweave.session import cut

    spark = queries.sparkSession
    asked = queries.select(F.col(query_key).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite("x", "y"))
    places = cut(asked.select("x", "y").distinct())
    known = targets.select(F.col(target_key).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite("x", "y"))
    schema = f"query {asked.schema['id'].dataType.simpleString()}, rank int, target {known.schema['id'].dataType.simpleString()}, distance double"
    total = known.count()
    if not total or k < 1:
        return spark.createDataFrame([], schema)
    k = min(k, total)
    known = cut(known.withColumn("nr", F.row_number().over(W.partitionBy("x", "y").orderBy("id"))).filter(F.col("nr") <= k).drop("nr"))
    west, south, east, north = known.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    width = max(east - west, north - south) * (1 + 1e-9) or 1.0
    finest = max(0, min(LEVELS, math.ceil(math.log2(max(total / k, 1)) / 2) + 4))
    index = lambda v, low: F.least(F.floor((v - low) / (width / 2**finest)), F.lit(2**finest - 1))
    levels = F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level")
    coarser = lambda c: F.call_function("shiftright", F.col(c), F.lit(finest) - F.col("level")).alias(c)
    fine = known.groupBy(index(F.col("x"), west).alias("cx"), index(F.col("y"), south).alias("cy")).count()
    counts = fine.select("*", levels).select("level", coarser("cx"), coarser("cy"), "count").groupBy("level", "cx", "cy").agg(F.sum("count").alias("n")).filter(F.col("n") >= k).drop("n")
    px, py = F.greatest(F.lit(west), F.least(F.lit(east), F.col("x"))), F.greatest(F.lit(south), F.least(F.lit(north), F.col("y")))
    places = places.withColumn("px", px).withColumn("py", py).withColumn("cx", index(F.col("px"), west)).withColumn("cy", index(F.col("py"), south))
    own = places.select("cx", "cy").distinct().select(F.col("cx").alias("qx"), F.col("cy").alias("qy"), "cx", "cy", levels).select("qx", "qy", "level", coarser("cx"), coarser("cy"))
    level = own.join(counts, ["level", "cx", "cy"]).groupBy(F.col("qx").alias("cx"), F.col("qy").alias("cy")).agg(F.max("level").alias("level"))
    outside = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    reach = (outside + width * math.sqrt(2) / F.pow(F.lit(2.0), F.col("level"))) * (1 + 1e-9)
    placed = places.join(level, ["cx", "cy"]).withColumn("reach", reach)
    placed = cut(placed.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(F.log2(F.lit(width) / F.col("reach"))).cast("int")))))
    used = sorted(r["level"] for r in placed.select("level").distinct().collect())  # LEVELS rows at most
    if not used:
        return spark.createDataFrame([], schema)
    held = known.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), index(F.col("x"), west).alias("cx"), index(F.col("y"), south).alias("cy"), F.explode(F.array(*map(F.lit, used))).alias("level"))
    held = held.select("target", "tx", "ty", "level", coarser("cx"), coarser("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = placed.select("x", "y", "reach", "level", coarser("cx"), coarser("cy"), F.explode(steps).alias("step")).withColumn("cx", F.col("cx") + F.col("step.i")).withColumn("cy", F.col("cy") + F.col("step.j"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    near = around.join(held, ["level", "cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).filter((F.col("distance") <= F.col("reach")) | (F.col("level") == 0))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("x", "y").orderBy("distance", "target"))).filter(F.col("rank") <= k)
    return asked.join(ranked.select("x", "y", F.col("rank").cast("int").alias("rank"), "target", "distance"), ["x", "y"]).select(F.col("id").alias("query"), "rank", "target", "distance")


def inverse_distance_mean(neighbours: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """(query, mean): mean of the neighbours' values weighted by 1 / distance,
    distances at least 1e-6; values that are null or NaN do not count."""
    known = values.select(F.col(key).alias("target"), F.col(value).alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    weighted = neighbours.join(known, "target").withColumn("w", 1 / F.greatest("distance", F.lit(1e-6)))
    in_order = lambda c: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("v")))), lambda s: s.v), F.lit(0.0), lambda a, b: a + b)  # noqa: E731  k values a query
    return weighted.groupBy("query").agg((in_order(F.col("v") * F.col("w")) / in_order(F.col("w"))).alias("mean"))


def closest_between_groups(points: DataFrame, key: str, group: str, group_a, group_b) -> DataFrame:
    """(a, b, distance): the closest pair between two groups, one row."""
    one, other = points.filter(F.col(group) == group_a), points.filter(F.col(group) == group_b)
    return k_nearest(one, other, key, key, 1).select(F.col("query").alias("a"), F.col("target").alias("b"), "distance").orderBy("distance", "a", "b").limit(1)


def in_box(x: str, y: str, box: tuple[float, float, float, float]) -> Column:
    """Inside west, south, east, north, edges included; scalars, so it reaches
    the scan."""
    return (F.col(x) >= box[0]) & (F.col(y) >= box[1]) & (F.col(x) <= box[2]) & (F.col(y) <= box[3])


def on_or_in(x: Column, y: Column, ring: list[tuple[float, float]]) -> tuple[Column, Column]:
    """How many edges of a ring are crossed on the way out, and whether the
    point is on one. The ring is a literal, so this is plain arithmetic in the
    scan's stage."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ax, ay) == (bx, by):
            continue
        side = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        on_edge = on_edge | ((side == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            crossings = crossings + F.when(((y < ay) != (y < by)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossings, on_edge


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Strictly inside a ring (even-odd); points on an edge are outside."""
    crossings, on_edge = on_or_in(x, y, ring)
    return (crossings % 2 == 1) & ~on_edge
