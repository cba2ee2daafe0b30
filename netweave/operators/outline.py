"""Outlines of point sets, and Thiessen polygons, as edges of areas.

The outline is an alpha shape: two points at most twice the radius apart share an
edge of it if of the two discs of that radius through both one holds no other
point and the other does; the inside is on the side that does. That is decided by
joins within the radius alone, so it is as local as the points are dense.

A Thiessen polygon starts as a box round everything and is cut by the bisectors
with the nearest other points, until no point beyond them could cut it: those
further than twice its furthest corner. Then it is cut by the boundary, of which
each cell sees the edges that pass its own square cells. Holes stay holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators import overlay
from netweave.operators.noding import walked
from netweave.operators.spatial import finite, k_nearest, radius_join, radius_pairs
from netweave.session import cut

#: A point this part of the radius inside a disc's rim is on it.
RIM = 1e-9


def alpha_edges(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(a, b, ax, ay, bx, by): the outline's edges, directed with the inside to
    their left; a and b are points. Of points at one place that with the smallest
    key counts; points without a finite place do not."""
    own = points.select(F.col(key).alias("id"), "x", "y").filter(finite("x", "y")).groupBy("x", "y").agg(F.min("id").alias("id"))
    own = cut(own)
    spots = own.select("id", "x", "y")
    pairs = radius_pairs(spots, "id", 2 * radius)
    named = lambda c: spots.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    placed = cut(pairs.join(named("a"), "a").join(named("b"), "b"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    high = F.sqrt(F.greatest(F.lit(radius * radius) - (dx * dx + dy * dy) / 4, F.lit(0.0))) / F.col("distance")
    centre = lambda way: F.struct(F.lit(way).alias("way"), ((F.col("ax") + F.col("bx")) / 2 - way * high * dy).alias("x"), ((F.col("ay") + F.col("by")) / 2 + way * high * dx).alias("y"))
    centres = placed.select("a", "b", F.explode(F.array(centre(1), centre(-1))).alias("c")).select("a", "b", "c.way", "c.x", "c.y")
    met = radius_join(centres, spots, radius).filter((F.col("distance") < radius * (1 - RIM)) & (F.col("r.id") != F.col("l.a")) & (F.col("r.id") != F.col("l.b")))
    held = met.groupBy("l.a", "l.b").agg(F.min("l.way").alias("low"), F.max("l.way").alias("high")).filter("low = high")
    forward = F.col("low") == 1
    joined = placed.join(held, ["a", "b"])
    return joined.select(*[F.when(forward, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])


def hull(points: DataFrame, key: str, radius: float, holes: bool = False) -> DataFrame:
    """The outline as an area (plane, ax, ay, bx, by), plane 0; without holes
    the ground in them counts too. Points apart from all others have no part."""
    edges = alpha_edges(points, key, radius).select(F.lit(0).cast("long").alias("plane"), *[F.round(c, overlay.DIGITS).alias(c) for c in ("ax", "ay", "bx", "by")])
    if holes:
        return edges
    outer = overlay.outlines(edges).filter("area > 0").select("plane", F.array("points").alias("parts"))
    return overlay.dissolve(overlay.edges_of(outer, "plane"), overlay.cell_size(edges))


def footprint(points: DataFrame, key: str, radius: float, distance: float) -> DataFrame:
    """The outline and what is within a distance of it or of a point that it
    leaves out, as one area."""
    inside = hull(points, key, radius)
    spots = points.filter(finite("x", "y")).select(F.lit(0).cast("long").alias("plane"), F.col(key).alias("id"), "x", "y").dropDuplicates(["x", "y"])
    held = overlay.covered(spots, inside, overlay.cell_size(inside)).select("id")
    corners = inside.select(F.col("ax").alias("x"), F.col("ay").alias("y"))
    return overlay.buffered(inside, distance, lone=spots.join(held, "id", "left_anti").join(corners, ["x", "y"], "left_anti"))


def _clip(polygon: Column, near: Column) -> Column:
    """A convex polygon (x, y, by), about its own point, less what is nearer to
    another point ``near`` (dx, dy, target). by: whose bisector starts at a corner."""
    beyond = lambda v: v["x"] * near["dx"] + v["y"] * near["dy"] - (near["dx"] * near["dx"] + near["dy"] * near["dy"]) / 2

    def corner(v: Column, i: Column) -> Column:
        w = F.get(polygon, (i + 1) % F.size(polygon))
        share = beyond(v) / (beyond(v) - beyond(w))
        met = lambda by: F.struct((v["x"] + (w["x"] - v["x"]) * share).alias("x"), (v["y"] + (w["y"] - v["y"]) * share).alias("y"), by.alias("by"))
        none = F.array().cast("array<struct<x:double,y:double,by:bigint>>")
        stays, leaves = F.array(v), F.array(v, met(near["target"]))
        return F.when(beyond(v) <= 0, F.when(beyond(w) <= 0, stays).otherwise(leaves)).otherwise(F.when(beyond(w) < 0, F.array(met(v["by"]))).otherwise(none))

    cuts = F.exists(polygon, lambda v: beyond(v) > 0)
    return F.when(cuts, F.flatten(F.transform(polygon, corner))).otherwise(polygon)


def cells(points: DataFrame, key: str, box: tuple[float, float, float, float], first: int = 12) -> DataFrame:
    """(id, x, y, polygon): the part of a box (west, south, east, north) that is
    nearer to a point than to any other; corners (x, y, by) are relative to the
    point, against the clock, and by is the neighbour across the edge that starts
    there. Keys are whole numbers; of points at one place one has a cell."""
    sites = cut(points.select(F.col(key).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite("x", "y")).groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"))
    total = sites.count()
    corner = lambda x, y: F.struct((F.lit(x) - F.col("x")).alias("x"), (F.lit(y) - F.col("y")).alias("y"), F.lit(None).cast("long").alias("by"))
    west, south, east, north = map(float, box)
    start = F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north))
    left, k, parts = sites, first, []
    while True:
        k = min(k, total - 1)
        near = k_nearest(left, sites, "id", "id", k + 1).filter("query <> target").join(sites.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")), "target")
        near = near.join(left.select(F.col("id").alias("query"), "x", "y"), "query")
        around = near.groupBy(F.col("query").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", (F.col("tx") - F.col("x")).alias("dx"), (F.col("ty") - F.col("y")).alias("dy"), "target", "distance"))).alias("near"))  # k of them
        placed = left.join(around, "id", "left").withColumn("near", F.coalesce("near", F.array().cast(around.schema["near"].dataType)))
        clipped = placed.select("id", "x", "y", F.aggregate("near", start, _clip).alias("polygon"), F.array_max(F.transform("near", lambda n: n["distance"])).alias("seen"))
        reach = 2 * F.array_max(F.transform("polygon", lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])))
        clipped = cut(clipped.withColumn("sure", F.lit(k == total - 1) | (F.coalesce("seen", F.lit(0.0)) >= reach)))
        parts.append(clipped.filter("sure").select("id", "x", "y", "polygon"))
        left = clipped.filter("NOT sure").select("id", "x", "y")
        if k == total - 1 or not left.take(1):
            break
        k *= 4
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def thiessen(points: DataFrame, key: str, boundary: DataFrame) -> DataFrame:
    """Of each point the part of a boundary, an area of plane 0, that is nearer to
    it than to any other point, as an area: plane is the point's key."""
    boundary = cut(boundary.select(F.monotonically_increasing_id().alias("edge"), "ax", "ay", "bx", "by"))
    span = boundary.agg(*[f(c) for f in (F.min, F.max) for c in ("ax", "ay")], F.count("*")).first()
    spots = points.filter(finite("x", "y"))
    own = spots.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not span[4] or own[0] is None:
        return boundary.limit(0).select(F.lit(0).cast("long").alias("plane"), "ax", "ay", "bx", "by")
    west, south, east, north = min(span[0], own[0]), min(span[1], own[1]), max(span[2], own[2]), max(span[3], own[3])
    margin = 1 + ((east - west) + (north - south)) / 20
    found = cut(cells(spots, key, (west - margin, south - margin, east + margin, north + margin)))
    step = max(((east - west + 2 * margin) * (north - south + 2 * margin) / max(found.count(), 1)) ** 0.5, overlay.cell_size(boundary) / 4)
    x, y = F.col("x"), F.col("y")
    following = lambda i: F.get("polygon", (i + 1) % F.size("polygon"))
    sides = F.transform("polygon", lambda v, i: F.struct(i.alias("side"), (v["x"] + x).alias("px"), (v["y"] + y).alias("py"), (following(i)["x"] + x).alias("qx"), (following(i)["y"] + y).alias("qy")))
    sided = cut(found.select("id", sides.alias("sides")))
    low = lambda c: F.floor(F.array_min(F.transform("sides", lambda s: s[c])) / step)
    high = lambda c: F.floor(F.array_max(F.transform("sides", lambda s: s[c])) / step)
    posted = sided.withColumn("cx", F.explode(F.sequence(low("px"), high("px")))).withColumn("cy", F.explode(F.sequence(low("py"), high("py"))))
    met = cut(posted.join(walked(boundary, step), ["cx", "cy"]).select("id", "sides", "edge", "ax", "ay", "bx", "by").dropDuplicates(["id", "edge"]))
    # where the edges of the boundary cross a cell's sides
    each = met.select("id", "edge", "ax", "ay", "bx", "by", F.explode("sides").alias("s")).select("*", "s.*").drop("s")
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    cross = rx * sy - ry * sx
    u = ((F.col("px") - F.col("ax")) * sy - (F.col("py") - F.col("ay")) * sx) / F.nullif(cross, F.lit(0.0))
    t = ((F.col("px") - F.col("ax")) * ry - (F.col("py") - F.col("ay")) * rx) / F.nullif(cross, F.lit(0.0))
    hits = each.withColumn("u", u).withColumn("t", t).filter(F.col("u").between(0, 1) & F.col("t").between(0, 1))
    digits = overlay.DIGITS
    hits = cut(hits.select("id", "edge", "side", "u", "t", F.round(F.col("ax") + F.col("u") * rx, digits).alias("x"), F.round(F.col("ay") + F.col("u") * ry, digits).alias("y")))
    # the parts of these edges that lie in the cell
    inside = F.forall("sides", lambda s: (s["qx"] - s["px"]) * (F.col("ay") - s["py"]) - (s["qy"] - s["py"]) * (F.col("ax") - s["px"]) >= 0)
    crossed = hits.groupBy("id", "edge").agg(F.array_sort(F.collect_list(F.struct("u", "x", "y"))).alias("hits"))
    joined = met.withColumn("inside", inside).select("id", "edge", "ax", "ay", "bx", "by", "inside").join(crossed, ["id", "edge"], "left")
    a, b = (F.struct(F.round(f"{c}x", digits).alias("x"), F.round(f"{c}y", digits).alias("y")) for c in "ab")
    first, last = (F.struct(h["x"].alias("x"), h["y"].alias("y")) for h in (F.get("hits", F.lit(0)), F.get("hits", F.size("hits") - 1)))
    many = F.size(F.array_distinct(F.transform(F.coalesce("hits", F.array().cast(crossed.schema["hits"].dataType)), lambda h: F.struct(h["x"], h["y"]))))
    begins = F.when(F.col("inside"), a).when(many > 0, first)
    ends = F.when(many == 0, F.when(F.col("inside"), b)).when(F.col("inside"), last).when(many == 1, b).otherwise(last)
    parts = joined.select("id", begins.alias("p"), ends.alias("q"))
    # and the parts of the cell's sides that lie in the boundary
    cuts = hits.groupBy("id", "side").agg(F.collect_list(F.struct("t", "x", "y")).alias("found"))
    flat = sided.select("id", F.explode("sides").alias("s")).select("id", "s.*").join(cuts, ["id", "side"], "left")
    tip = lambda t, x, y: F.struct(F.lit(t).alias("t"), F.round(x, digits).alias("x"), F.round(y, digits).alias("y"))
    chain = F.array_sort(F.concat(F.array(tip(-1.0, "px", "py")), F.coalesce("found", F.array().cast(cuts.schema["found"].dataType)), F.array(tip(2.0, "qx", "qy"))))
    steps = flat.withColumn("chain", chain).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("chain") - 2), lambda i: F.struct(F.get("chain", i).alias("p"), F.get("chain", i + 1).alias("q")))).alias("e"))
    steps = steps.select("id", *[F.col(f"e.{v}.{c}").alias(n) for n, v, c in (("ax", "p", "x"), ("ay", "p", "y"), ("bx", "q", "x"), ("by", "q", "y"))]).filter("ax <> bx OR ay <> by")
    rims = parts.select("id", *[F.col(f"{v}.{c}").alias(n) for n, v, c in (("ax", "p", "x"), ("ay", "p", "y"), ("bx", "q", "x"), ("by", "q", "y"))]).filter("ax <> bx OR ay <> by")
    numbered = cut(steps.withColumn("n", F.monotonically_increasing_id()))
    middles = numbered.select(F.lit(0).cast("long").alias("plane"), F.col("n").alias("id"), ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    kept = overlay.covered(middles, boundary.withColumn("plane", F.lit(0).cast("long")), step).select(F.col("id").alias("n"))
    columns = [F.col("id").alias("plane"), "ax", "ay", "bx", "by"]
    # a side that lies on the boundary is there once
    return numbered.join(kept, "n", "left_semi").select(*columns).unionByName(rims.select(*columns)).distinct()
