"""Line work to a connected multigraph: numbering, degrees, welding, rings,
dangles, bridges. Lines are arrays of points; a line's number is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.operators.components import connected_components
from netweave.session import cut


def number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows from 1 in an order, without gathering them: rows are ranged
    by the order, counted by range, and numbered within it."""
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()))
    sizes = sorted(ranged.groupBy("__range").count().collect())  # a row for each partition
    start, at = [], 0
    for place, n in sizes:
        start.append((place, at))
        at += n
    offsets = F.create_map(*[F.lit(x) for pair in start for x in pair]) if start else F.create_map().cast("map<int,int>")
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, (within + offsets[F.col("__range")]).cast("long")).drop("__range")


def ends(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node_id): a row for each end of each link."""
    return links.select(F.explode(F.array(src, dst)).alias("node_id"))


def degree_map(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(node_id, degree); parallel links count each, a loop twice."""
    return ends(links, src, dst).groupBy("node_id").agg(F.count("*").alias("degree"))


def node_class(degree: Column) -> Column:
    return F.when(degree == 1, "dead_end").when(degree == 2, "bend").otherwise("junction")


def grid_key(x: Column, y: Column, digits: int = 3) -> tuple[Column, Column]:
    """Coordinates as whole numbers, for joins on equality."""
    scale = 10**digits
    return F.round(x * scale).cast("long"), F.round(y * scale).cast("long")


def first_point(points: str) -> Column:
    return F.element_at(points, 1)


def last_point(points: str) -> Column:
    return F.element_at(points, -1)


def line_length(points: Column) -> Column:
    """Length of a line of points, within a row."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def quantise(points: Column, digits: int = 3) -> Column:
    """Rounded points without repeats in a row; null if fewer than two remain."""
    rounded = F.transform(points, lambda p: F.struct(F.round(p.x, digits).alias("x"), F.round(p.y, digits).alias("y")))
    kept = F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))
    return F.when(F.size(kept) >= 2, kept)


def weld(lines: DataFrame, tolerance: float, line_id: str = "line_id", points: str = "points") -> DataFrame:
    """Ends within tolerance of each other, and of others in turn, move to
    their mean (3 digits); lines that shrink to a point go."""
    from netweave.operators.spatial import radius_pairs

    tips = lines.select(line_id, F.posexplode(F.array(first_point(points), last_point(points))).alias("tip", "p")).select(line_id, "tip", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    spots = cut(number(tips.select("x", "y").distinct(), ["x", "y"], "spot"))
    linked = connected_components(radius_pairs(spots, "spot", tolerance), "a", "b")
    grouped = spots.join(linked, spots["spot"] == linked["node"], "left").select("x", "y", F.coalesce("component", "spot").alias("spot"))
    centres = grouped.groupBy("spot").agg(F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"))
    moved = tips.join(grouped.join(centres, "spot"), ["x", "y"]).groupBy(line_id).agg(F.max(F.when(F.col("tip") == 0, F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))).alias("a"), F.max(F.when(F.col("tip") == 1, F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")))).alias("b"))
    inner = F.slice(F.col(points), F.lit(2), F.greatest(F.size(points) - 2, F.lit(0)))
    joined = lines.join(moved, line_id).withColumn(points, F.concat(F.array("a"), inner, F.array("b"))).drop("a", "b")
    kept = F.filter(F.col(points), lambda p, i: (i == 0) | (p != F.get(F.col(points), i - 1)))
    return joined.withColumn(points, kept).filter(F.size(points) >= 2)


def prune_dangles(links: DataFrame, least: float, rounds: int = 8, src: str = "node1", dst: str = "node2", length: str = "length_m") -> DataFrame:
    """Drops links shorter than least that have a free end, again while any is
    found, at most so many rounds."""
    links = cut(links)
    for _ in range(rounds):
        free = degree_map(links, src, dst).filter("degree = 1").select("node_id")
        tagged = links.join(free.withColumnRenamed("node_id", src).withColumn("free1", F.lit(True)), src, "left").join(free.withColumnRenamed("node_id", dst).withColumn("free2", F.lit(True)), dst, "left")
        kept = cut(tagged.filter((F.col(length) >= least) | (F.col("free1").isNull() & F.col("free2").isNull())).select(*links.columns))
        if kept.count() == links.count():
            return kept
        links = kept
    return links


def merge_short(links: DataFrame, nodes: DataFrame, least: float, src: str = "node1", dst: str = "node2", length: str = "length_m") -> tuple[DataFrame, DataFrame]:
    """Contracts links shorter than least: their ends become one node (the
    smallest id, at the mean place); loops that arise go. (links, nodes)."""
    groups = connected_components(links.filter((F.col(length) < least) & (F.col(src) != F.col(dst))), src, dst)
    to = groups.select(F.col("node").alias("node_id"), F.col("component").alias("to"))
    placed = nodes.join(to, "node_id", "left").withColumn("to", F.coalesce("to", "node_id"))
    merged = placed.groupBy("to").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("to", "node_id")
    for end in (src, dst):
        links = links.join(to.withColumnRenamed("node_id", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return links.filter(F.col(src) != F.col(dst)), merged


def components_by_size(links: DataFrame, src: str = "node1", dst: str = "node2") -> DataFrame:
    """(component, n_nodes), the largest first."""
    return connected_components(links, src, dst).groupBy("component").agg(F.count("*").alias("n_nodes")).orderBy(F.desc("n_nodes"), "component")


def select_cluster(lines: DataFrame, cluster: str, inside: Column | None = None, length: str = "length_m", least: float = 0.05) -> DataFrame:
    """The lines of the cluster with the largest share inside, of equals the
    longest; without a test, or where no cluster has more than least inside, of
    the longest; then of equals the smallest."""
    share = F.avg(F.when(inside, 1.0).otherwise(0.0)) if inside is not None else F.lit(0.0)
    stats = lines.groupBy(cluster).agg(share.alias("share"), F.sum(F.col(length).cast("decimal(28,9)")).alias("total"))
    some = stats.agg((F.max("share") > least).alias("some"))  # one row
    ranked = stats.crossJoin(F.broadcast(some)).orderBy(F.when(F.col("some"), F.col("share")).otherwise(0.0).desc(), F.desc("total"), cluster)
    return lines.join(F.broadcast(ranked.limit(1).select(F.col(cluster).alias("__best"))), F.col(cluster) == F.col("__best"), "left_semi")


def largest_component(links: DataFrame, src: str = "node1", dst: str = "node2") -> DataFrame:
    """The links of the component with most nodes, of equals that with the
    smallest node."""
    found = cut(connected_components(links, src, dst))
    best = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return links.join(found.join(best, "component").select(F.col("node").alias(src)), src, "left_semi")


def bridge_islands(links: DataFrame, nodes: DataFrame, max_gap: float, src: str = "node1", dst: str = "node2") -> DataFrame:
    """(node1, node2, length_m): connectors that join islands to the largest
    component, each time the shortest between any node of it and any other, as
    long as that is at most max_gap.

    Taking the shortest gap first, again and again, grows a minimum spanning
    tree over the components; with ties broken by node ids there is only one.
    It is found by rounds in which every group of components takes its shortest
    gap (Boruvka), a number of rounds that grows with the logarithm of the
    number of components. Connectors of trees without the largest are left out.

    Of the components that meet at one place only the one with the smallest node
    there looks further, and the others at that place are joined to it: any other
    gap is the longest of a circle of gaps, so it is in no minimum spanning tree.
    """
    from netweave.operators.spatial import finite, radius_pairs

    labelled = nodes.join(connected_components(links, src, dst), nodes["node_id"] == F.col("node"), "left")
    found = cut(labelled.select("node_id", "x", "y", F.coalesce("component", "node_id").alias("component")))
    there = found.filter(finite("x", "y")).groupBy("x", "y", "component").agg(F.min("node_id").alias("node_id"))
    first = cut(there.groupBy("x", "y").agg(F.min("node_id").alias("a"), F.min_by("component", "node_id").alias("u")))
    of = first.select("a", "u")
    near = radius_pairs(first, "a", max_gap).join(of, "a").join(of.toDF("b", "v"), "b").filter("u != v").select("a", "b", "distance", "u", "v")
    if max_gap >= 0:
        here = there.join(first, ["x", "y"]).filter("component != u")
        near = near.union(here.select("a", F.col("node_id").alias("b"), F.lit(0.0).alias("distance"), "u", F.col("component").alias("v")))
    gaps = cut(near.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("distance", "a", "b", F.least("u", "v").alias("cu"), F.greatest("u", "v").alias("cv"))).alias("gap")))
    chosen = gaps.limit(0).select("gap")
    while gaps.take(1):
        tips = gaps.select(F.explode(F.array("u", "v")).alias("at"), "gap")
        picked = cut(tips.groupBy("at").agg(F.min("gap").alias("gap")).select("gap").distinct())
        chosen = cut(chosen.union(picked))
        joined = connected_components(gaps.join(picked, "gap", "left_semi"), "u", "v")
        for end in ("u", "v"):
            gaps = gaps.join(joined.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
        gaps = cut(gaps.filter("u != v").groupBy(*pair).agg(F.min("gap").alias("gap")))
    trees = connected_components(chosen.select("gap.cu", "gap.cv"), "cu", "cv")
    largest = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select(F.col("component").alias("node"))
    own = trees.join(trees.join(largest, "node").select("component"), "component", "left_semi").select("node")
    return chosen.select(F.col("gap.a").alias("node1"), F.col("gap.b").alias("node2"), F.col("gap.distance").alias("length_m"), F.col("gap.cu").alias("node")).join(own, "node", "left_semi").drop("node")
