"""Areas with holes as edges: overlay, dissolve, buffer, and points in areas.

An area is a set of directed edges (plane, ax, ay, bx, by) with its inside to
their left; what is in different planes does not meet, so many overlays run at
once. Edges are cut where they meet, pieces that lie on each other become one,
and each piece is told how often every layer's edges wind round the ground at its
left and at its right. A rule on these numbers says which ground is inside; the
pieces with inside at one hand only are the result's edges.

How often edges wind round a place is counted locally: from the place up to the
top of its square cell, along it to the cell's corner, and from there by running
sums over the cells above. So the work grows with the edges' length in cells, not
with pairs of edges that are on one line of sight. Coordinates are rounded to
``DIGITS``; cells start off the round numbers that coordinates like.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.operators.doubling import rings
from netweave.operators.noding import crossings, walked
from netweave.session import cut

DIGITS = 3
#: Where cells start, as a part of a cell.
OFF = 0.3819660113


def edges_of(areas: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """(plane, ax, ay, bx, by): the edges of rings, arrays of points x and y,
    closed or not; as they are drawn, so nothing is known of their inside."""
    rings_ = areas.select(F.col(key).alias("plane"), F.explode(parts).alias("ring")).filter(F.size("ring") > 2)
    following = lambda i: F.get("ring", (i + 1) % F.size("ring"))
    pairs = F.transform("ring", lambda p, i: F.struct(p.x.alias("ax"), p.y.alias("ay"), following(i)["x"].alias("bx"), following(i)["y"].alias("by")))
    flat = rings_.select("plane", F.explode(pairs).alias("e")).select("plane", *[F.round(F.col(f"e.{c}").cast("double"), DIGITS).alias(c) for c in ("ax", "ay", "bx", "by")])
    return flat.filter("ax <> bx OR ay <> by")


def winding(points: DataFrame, edges: DataFrame, size: float, weights: list[str], own: str | None = None) -> DataFrame:
    """points (plane, id, x, y) with, for each of weights, how often the edges
    (plane, ax, ay, bx, by, weights) wind round them. Edges run from left to right, or
    upwards; an edge's weight is how often it is there, less how often the other
    way round. A point on an upright edge counts as at its right. own: a column of the
    edges; a point does not see the edge that has its id there."""
    shift = OFF * size
    cell = lambda v: F.floor((v - shift) / size)
    line = lambda c: c * size + shift
    rise = (F.col("by") - F.col("ay")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0))
    at_x = lambda x: F.col("ay") + (x - F.col("ax")) * rise
    # the signs of what crosses each cell's left line, summed from above
    upright = edges.withColumn("cx", F.explode(F.sequence(cell(F.col("ax")) + 1, F.greatest(cell(F.col("bx")), cell(F.col("ax")) + 1)))).filter((F.col("ax") <= line(F.col("cx"))) & (line(F.col("cx")) < F.col("bx")))
    crossed = upright.withColumn("cy", cell(at_x(line(F.col("cx"))))).groupBy("plane", "cx", "cy").agg(*[F.sum(-F.col(w)).alias(w) for w in weights])
    placed = points.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    cells = placed.select("plane", "cx", "cy").distinct()
    both = crossed.unionByName(cells.select("plane", "cx", "cy", *[F.lit(0).cast("long").alias(w) for w in weights])).groupBy("plane", "cx", "cy").agg(*[F.sum(w).alias(w) for w in weights])
    above = W.partitionBy("plane", "cx").orderBy(F.desc("cy")).rowsBetween(W.unboundedPreceding, -1)  # a column of cells
    corner = both.select("plane", "cx", "cy", *[F.coalesce(F.sum(w).over(above), F.lit(0)).alias(f"{w}_c") for w in weights])
    # what is between the place and the corner, among the edges in its cell
    posted = walked(edges, size, shift).withColumnsRenamed({w: f"{w}_e" for w in weights})
    seen = placed.join(posted, ["plane", "cx", "cy"], "left").join(corner, ["plane", "cx", "cy"])
    top, left = line(F.col("cy") + 1), line(F.col("cx"))
    up = (F.col("ax") <= F.col("x")) & (F.col("x") < F.col("bx")) & (at_x(F.col("x")) > F.col("y")) & (cell(at_x(F.col("x"))) == F.col("cy"))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    cross_x = F.col("ax") + (top - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    along = (low <= top) & (top < high) & (cross_x > left) & (cross_x <= F.col("x"))
    if own:
        up = up & ~F.col(own).eqNullSafe(F.col("id"))  # the way starts above it; along the cell's top it may be met
    part = lambda w: F.when(up, -F.col(f"{w}_e")).otherwise(0) - F.when(along, F.when(F.col("by") > F.col("ay"), F.col(f"{w}_e")).otherwise(-F.col(f"{w}_e"))).otherwise(0)
    found = seen.groupBy("plane", "id").agg(*[(F.sum(F.coalesce(part(w), F.lit(0))) + F.first(f"{w}_c")).alias(w) for w in weights])
    return found


def pieces(edges: DataFrame, size: float) -> DataFrame:
    """(plane, id, ax, ay, bx, by, w0, w1): what edges (plane, layer, ax, ay, bx,
    by) of layers 0 and 1 become when they are cut where they meet, each once and from
    left to right or upwards, with how often each layer has it (less the other
    way round). With ``parity`` edges count the same both ways."""
    numbered = cut(edges.withColumn("seg_id", F.monotonically_increasing_id()))
    meets = crossings(numbered, size).groupBy("seg_id").agg(F.collect_list(F.struct("t", "x", "y")).alias("found"))  # an edge's own
    joined = numbered.join(meets, "seg_id", "left")
    tip = lambda t, x, y: F.struct(F.lit(t).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.filter(F.coalesce("found", F.array().cast(joined.schema["found"].dataType)), lambda m: (m.t > 1e-9) & (m.t < 1 - 1e-9))
    cuts = joined.withColumn("cuts", F.array_sort(F.concat(F.array(tip(0.0, "ax", "ay")), inner, F.array(tip(1.0, "bx", "by")))))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b"))))
    flat = cuts.select("plane", "layer", each.alias("p")).select("plane", "layer", *[F.round(F.col(f"p.{c}"), DIGITS).alias(c[0] + c[2]) for c in ("a.x", "a.y", "b.x", "b.y")])
    flat = flat.filter("ax <> bx OR ay <> by")
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    turned = flat.select("plane", "layer", *[F.when(forward, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))], F.when(forward, 1).otherwise(-1).cast("long").alias("way"))
    of = lambda n: F.sum(F.when(F.col("layer") == n, F.col("way")).otherwise(0))
    many = lambda n: F.count_if(F.col("layer") == n)
    once = turned.groupBy("plane", "ax", "ay", "bx", "by").agg(of(0).alias("w0"), of(1).alias("w1"), many(0).alias("n0"), many(1).alias("n1"))
    return cut(once.withColumn("id", F.monotonically_increasing_id()))


def counted(edges: DataFrame, size: float, parity: bool = False) -> DataFrame:
    """(plane, ax, ay, bx, by, l0, l1, r0, r1): the pieces of edges (plane, layer
    0 or 1, ax, ay, bx, by), with each layer's number of the ground at the left and
    at the right. With parity the numbers are 0 and 1 by the even-odd rule,
    whichever way edges run. Any number of rules can be asked of it."""
    found = pieces(edges, size)
    if parity:
        found = found.withColumn("w0", F.col("n0")).withColumn("w1", F.col("n1"))
    middles = found.select("plane", "id", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    around = winding(middles, found.withColumn("piece", F.col("id")).drop("id", "n0", "n1"), size, ["w0", "w1"], own="piece")
    known = found.join(around.withColumnsRenamed({"w0": "s0", "w1": "s1"}), ["plane", "id"])
    upright = F.col("ax") == F.col("bx")
    number = (lambda n: F.pmod(n, F.lit(2))) if parity else (lambda n: n)
    # what was counted is the ground above the piece, or right of an upright one
    left = [number(F.when(upright, F.col(f"s{i}") + F.col(f"w{i}")).otherwise(F.col(f"s{i}"))).alias(f"l{i}") for i in (0, 1)]
    right = [number(F.when(upright, F.col(f"s{i}")).otherwise(F.col(f"s{i}") - F.col(f"w{i}"))).alias(f"r{i}") for i in (0, 1)]
    return known.select("plane", "ax", "ay", "bx", "by", *left, *right)


def ruled(known: DataFrame, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """The area (plane, ax, ay, bx, by) that a rule takes of what ``counted`` gives."""
    told = known.withColumn("left", rule(F.col("l0"), F.col("l1"))).withColumn("right", rule(F.col("r0"), F.col("r1"))).filter(F.col("left") != F.col("right"))
    return told.select("plane", *[F.when(F.col("left"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])


def overlay(edges: DataFrame, size: float, rule: Callable[[Column, Column], Column], parity: bool = False) -> DataFrame:
    """The area (plane, ax, ay, bx, by) of the ground that the rule takes.

    edges: plane, layer (0 or 1), ax, ay, bx, by. rule: of the two layers' numbers
    whether ground is inside; with parity the numbers are 0 and 1 by the
    even-odd rule, whichever way edges run."""
    return ruled(counted(edges, size, parity), rule)


def even_odd(edges: DataFrame, size: float) -> DataFrame:
    """The area of rings drawn any way round, holes and islands by the even-odd rule."""
    return overlay(edges.withColumn("layer", F.lit(0)), size, lambda a, b: a > 0, parity=True)


def dissolve(edges: DataFrame, size: float) -> DataFrame:
    """One area of all that areas of a plane cover, however they overlap."""
    return overlay(edges.withColumn("layer", F.lit(0)), size, lambda a, b: a > 0)


RULES: dict[str, Callable[[Column, Column], Column]] = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b <= 0),
}


def combined(one: DataFrame, two: DataFrame, how: str, size: float) -> DataFrame:
    """Union, intersection or difference of two areas, plane by plane."""
    return overlay(layered(one, two), size, RULES[how])


def layered(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two areas as the layers 0 and 1."""
    return one.select("plane", F.lit(0).alias("layer"), "ax", "ay", "bx", "by").unionByName(two.select("plane", F.lit(1).alias("layer"), "ax", "ay", "bx", "by"))


def area(edges: DataFrame) -> DataFrame:
    """(plane, area): of a plane without edges there is no row."""
    half = (F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    return edges.groupBy("plane").agg(F.sum(half.cast("decimal(38,6)")).cast("double").alias("area"))


def overlap(one: DataFrame, two: DataFrame, size: float) -> DataFrame:
    """(plane, intersection, union, iou) of two areas; planes that have
    neither are left out."""
    known = counted(layered(one, two), size)  # once, for both rules
    half = ((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).cast("decimal(38,6)")

    def size_of(how: str) -> Column:
        left, right = RULES[how](F.col("l0"), F.col("l1")), RULES[how](F.col("r0"), F.col("r1"))
        return F.sum(F.when(left & ~right, half).when(right & ~left, -half)).cast("double").alias(how)

    joined = known.groupBy("plane").agg(size_of("union"), size_of("intersection")).filter(F.col("union").isNotNull()).withColumn("intersection", F.coalesce("intersection", F.lit(0.0)))
    return joined.select("plane", "intersection", "union", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0).alias("iou"))


def outlines(edges: DataFrame) -> DataFrame:
    """(plane, ring, points, area): the closed rings of an area, outer ones
    left-handed and with an area above 0, holes below. At a place where rings touch
    each goes on by the sharpest turn to the right, so none crosses itself."""
    numbered = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    come = numbered.select("plane", "id", F.col("bx").alias("x"), F.col("by").alias("y"), F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")).alias("back"))
    go = numbered.select("plane", F.col("id").alias("next"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("ahead"))
    turn = F.pmod(F.col("back") - F.col("ahead"), F.lit(2 * math.pi))
    turn = F.when(turn <= 1e-12, 2 * math.pi).otherwise(turn)
    # inside is to the left, so the next edge is the first one clockwise from where the ring came
    following = come.join(go, ["plane", "x", "y"]).groupBy("plane", "id").agg(F.min(F.struct(turn.alias("turn"), "next"))["next"].alias("next"))
    places = rings(following.select("id", "next"))
    point = F.struct("at", F.col("ax").alias("x"), F.col("ay").alias("y"))
    chained = numbered.join(places, "id").groupBy("plane", "ring").agg(F.array_sort(F.collect_list(point)).alias("chain"))  # one ring's corners
    points = F.transform("chain", lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    shoelace = F.aggregate(F.transform("chain", lambda p, i: p.x * F.get("chain", (i + 1) % F.size("chain"))["y"] - F.get("chain", (i + 1) % F.size("chain"))["x"] * p.y), F.lit(0.0), lambda s, v: s + v) / 2
    return chained.select("plane", "ring", points.alias("points"), shoelace.alias("area"))


def shapes(edges: DataFrame) -> DataFrame:
    """(plane, parts, area): an area's rings as arrays of points, the largest
    first, such as the exports and ``edges_of`` take."""
    found = outlines(edges).groupBy("plane").agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("small"), "points"))).alias("all"), F.sum("area").alias("area"))  # one area's rings
    return found.select("plane", F.transform("all", lambda r: r["points"]).alias("parts"), "area")


def buffered(edges: DataFrame, distance: float, quarter: int = 16, lone: DataFrame | None = None) -> DataFrame:
    """The area within a distance of an area: with a strip along each edge and a
    disc, a polygon of so many corners a quarter, at each corner. lone: points
    (plane, x, y) that get a disc of their own."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    ox, oy = dy / length * distance, -dx / length * distance  # to the right, where outside is
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by")}
    strip = F.array(corner(c["ax"], c["ay"]), corner(c["ax"] + ox, c["ay"] + oy), corner(c["bx"] + ox, c["by"] + oy), corner(c["bx"], c["by"]))
    strips = edges.select("plane", F.array(strip).alias("parts"))
    tips = edges.select("plane", F.col("ax").alias("x"), F.col("ay").alias("y"))
    tips = (tips if lone is None else tips.unionByName(lone.select("plane", "x", "y"))).distinct()
    disc = F.array(*[corner(F.col("x") + distance * math.cos(math.pi * k / (2 * quarter)), F.col("y") + distance * math.sin(math.pi * k / (2 * quarter))) for k in range(4 * quarter)])
    shapes = strips.unionByName(tips.select("plane", F.array(disc).alias("parts")))
    drawn = edges_of(shapes, "plane").unionByName(edges.select("plane", "ax", "ay", "bx", "by"))
    return dissolve(drawn, max(distance / 4, 10.0**-DIGITS))


def covered(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """The points (plane, id, x, y) that lie in the area, whatever its number of
    edges; on an edge either may be said."""
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    turned = edges.select("plane", *[F.when(forward, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))], F.when(forward, 1).otherwise(-1).cast("long").alias("w0"))
    inside = winding(points.select("plane", "id", "x", "y"), turned, size, ["w0"]).filter("w0 > 0").select("plane", "id")
    return points.join(inside, ["plane", "id"], "left_semi")


def cell_size(edges: DataFrame) -> float:
    """The edges' mean length, a fair width of cells; 1 if there are none."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    found = edges.agg(F.avg(F.sqrt(dx * dx + dy * dy))).first()[0]
    return max(found or 1.0, 10.0**-DIGITS)
