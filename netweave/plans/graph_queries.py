"""Degrees, components, trees, cleaning, sizing and the solve."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.functions import labels
from netweave.operators import cleaning, georeference, hydraulics, noding, spatial, topology, trees, zones
from netweave.operators.components import connected_components
from netweave.plans.fixtures import BASE, LADDER, PIPES, memo, net_links, net_nodes, net_pipes
from netweave.plans.registry import query
from netweave.plans.scalar_queries import LABELS, _snap, read_labels
from netweave.session import table


@query("degree_map", f"WITH {BASE} SELECT node_id, degree FROM deg")
def degree_map(spark, sf_dir):
    return topology.degree_map(net_links(spark, sf_dir), "node1", "node2")


@query("degree_histogram", f"WITH {BASE} SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def degree_histogram(spark, sf_dir):
    return degree_map(spark, sf_dir).groupBy("degree").agg(F.count("*").alias("n"))


@query("node_class", f"WITH {BASE} SELECT node_id, degree, node_type FROM nodes")
def node_class(spark, sf_dir):
    return net_nodes(spark, sf_dir).select("node_id", "degree", topology.node_class(F.col("degree")).alias("node_type"))


@query("endpoint_ids", f"WITH {BASE}, {PIPES}, spots AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS nr FROM (SELECT x1 AS x, y1 AS y FROM pipes UNION SELECT x2, y2 FROM pipes)) SELECT link_id, 'J' || a.nr AS from_id, 'J' || b.nr AS to_id FROM pipes JOIN spots a ON a.x = x1 AND a.y = y1 JOIN spots b ON b.x = x2 AND b.y = y2")
def endpoint_ids(spark, sf_dir):
    pipes = net_pipes(spark, sf_dir)
    tips = pipes.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    spots = topology.number(tips.select("p.x", "p.y").distinct(), ["x", "y"], "nr")
    for end, name in (("1", "from_id"), ("2", "to_id")):
        kx, ky = topology.grid_key(F.col(f"x{end}"), F.col(f"y{end}"))
        sx, sy = topology.grid_key(F.col("x"), F.col("y"))
        own = spots.select(sx.alias("kx"), sy.alias("ky"), F.concat(F.lit("J"), "nr").alias(name))
        pipes = pipes.withColumns({"kx": kx, "ky": ky}).join(own, ["kx", "ky"]).drop("kx", "ky")
    return pipes.select("link_id", "from_id", "to_id")


WALK = f"""WITH RECURSIVE {BASE}, both_ways AS (SELECT node1 AS a, node2 AS b FROM links UNION ALL SELECT node2, node1 FROM links),
  walk AS (SELECT node_id AS node, node_id AS component FROM deg UNION SELECT b, component FROM walk JOIN both_ways ON a = node),
  comp AS (SELECT node, min(component) AS component FROM walk GROUP BY node) """


@query("components", WALK + "SELECT node, component FROM comp")
def components(spark, sf_dir):
    return connected_components(net_links(spark, sf_dir), "node1", "node2")


@query("components_by_size", WALK + "SELECT component, count(*) AS n_nodes FROM comp GROUP BY component")
def components_by_size(spark, sf_dir):
    return topology.components_by_size(net_links(spark, sf_dir))


@query("largest_component", WALK + ", best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT link_id, node1, node2 FROM links JOIN comp ON node = node1 JOIN best USING (component)")
def largest_component(spark, sf_dir):
    return topology.largest_component(net_links(spark, sf_dir)).select("link_id", "node1", "node2")


@query("reachability", f"WITH RECURSIVE {BASE}, both_ways AS (SELECT node1 AS a, node2 AS b FROM links UNION ALL SELECT node2, node1 FROM links), walk AS (SELECT CAST(5 AS BIGINT) AS node_id UNION SELECT b FROM walk JOIN both_ways ON a = node_id) SELECT node_id FROM walk")
def reachability(spark, sf_dir):
    root = spark.createDataFrame([(5,)], "node_id long")
    return trees.reachable(net_links(spark, sf_dir), root)


@query("unreachable_nodes", f"WITH RECURSIVE {BASE}, both_ways AS (SELECT node1 AS a, node2 AS b FROM links UNION ALL SELECT node2, node1 FROM links), walk AS (SELECT CAST(5 AS BIGINT) AS node_id UNION SELECT b FROM walk JOIN both_ways ON a = node_id) SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM walk)")
def unreachable_nodes(spark, sf_dir):
    return net_nodes(spark, sf_dir).select("node_id").join(reachability(spark, sf_dir), "node_id", "left_anti")


_TREE = f"""WITH RECURSIVE {BASE}, both_ways AS (SELECT node1 AS a, node2 AS b, link_id FROM links UNION ALL SELECT node2, node1, link_id FROM links),
  root AS (SELECT min(node_id) AS node_id FROM nodes GROUP BY cluster),
  walk AS (SELECT node_id AS node, 0 AS d FROM root UNION SELECT b, d + 1 FROM walk JOIN both_ways ON a = node WHERE d < 60),
  far AS (SELECT node, CAST(min(d) AS INTEGER) AS depth FROM walk GROUP BY node),
  best AS (SELECT x.node, x.depth, min(struct_pack(link := link_id, up := a)) AS best FROM far x LEFT JOIN (both_ways JOIN far y ON y.node = a) ON b = x.node AND y.depth = x.depth - 1 GROUP BY x.node, x.depth),
  tree AS (SELECT node AS node_id, depth, best.up AS parent, best.link AS link_id FROM best) """


@memo
def node_tree(spark, sf_dir):
    first = net_nodes(spark, sf_dir).groupBy("cluster").agg(F.min("node_id").alias("node_id")).select("node_id")
    return trees.spanning_tree(net_links(spark, sf_dir), first)


@query("spanning_tree", _TREE + "SELECT node_id, depth, parent, link_id FROM tree")
def spanning_tree(spark, sf_dir):
    """Breadth-first trees from each cluster's first node, whatever their size;
    ``bfs_tree`` walks each in a worker, in order of arrival."""
    return node_tree(spark, sf_dir)


@query("tree_flows", _TREE + ", below AS (SELECT node_id AS top, node_id FROM tree UNION ALL SELECT parent, below.node_id FROM below JOIN tree ON tree.node_id = top WHERE parent IS NOT NULL) SELECT tree.node_id, link_id, CAST(sum(CAST(demand_lps AS DECIMAL(28,6))) AS DOUBLE) * 2.5::DOUBLE AS flow FROM below JOIN tree ON tree.node_id = top JOIN nodes ON nodes.node_id = below.node_id WHERE parent IS NOT NULL GROUP BY ALL")
def tree_flows(spark, sf_dir):
    needs = net_nodes(spark, sf_dir).select("node_id", F.col("demand_lps").alias("demand"))
    return trees.tree_flows(node_tree(spark, sf_dir), needs, 2.5)


@query("spatial_clusters")
def spatial_clusters(spark, sf_dir):
    """All nodes, joined where 40 m apart at most; the tests compare all pairs."""
    return spatial.clusters(net_nodes(spark, sf_dir), "node_id", 40.0).withColumnRenamed("cluster", "spatial_cluster")


def roots(spark, sf_dir):
    return net_nodes(spark, sf_dir).groupBy("cluster").agg(F.min("node_id").alias("node_id"))


@memo
def tree(spark, sf_dir):
    nodes, links = net_nodes(spark, sf_dir), net_pipes(spark, sf_dir)
    return hydraulics.network_trees(nodes.select(F.col("cluster").alias("network_id"), "node_id", F.col("demand_lps").alias("demand")), links.select(F.col("cluster").alias("network_id"), "link_id", "node1", "node2"), roots(spark, sf_dir).select(F.col("cluster").alias("network_id"), "node_id"), 2.5)


@query("bfs_tree", f"""WITH RECURSIVE {BASE}, both_ways AS (SELECT node1 AS a, node2 AS b, link_id FROM links UNION ALL SELECT node2, node1, link_id FROM links),
  walk AS (SELECT min(node_id) AS node_id, 0 AS depth FROM nodes GROUP BY cluster UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = node_id WHERE depth < 90)
  SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node_id""")
def bfs_tree(spark, sf_dir):
    return tree(spark, sf_dir).select("node_id", "depth")


@query("bfs_tree_flow")
def bfs_tree_flow(spark, sf_dir):
    """Demand below each tree link; conservation is held in the tests."""
    return tree(spark, sf_dir).filter("depth > 0").select("node_id", "parent", "link_id", "flow")


@query("diameter_assign", f"""WITH {BASE}, {PIPES}, {LABELS}, spots AS (SELECT id, diameter_mm AS mm, material AS m, (id * 7919 % 10007) / CAST(10 AS DOUBLE) AS x, (id * 31 % 1009) * 1.0::DOUBLE AS y FROM read WHERE diameter_mm IS NOT NULL),
  mids AS (SELECT link_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM pipes),
  near AS (SELECT link_id, min(struct_pack(d := sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), id := b.id)) AS best FROM mids a JOIN spots b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60 GROUP BY link_id),
  sized AS (SELECT pipes.link_id, coalesce(mm, 50) AS raw_mm, CASE WHEN best IS NULL THEN 'UNK' ELSE coalesce(m, 'UNK') END AS material, best.d AS label_distance_m, best IS NOT NULL AS diameter_from_cad, a.degree = 1 OR b.degree = 1 AS free
    FROM pipes LEFT JOIN near USING (link_id) LEFT JOIN spots ON spots.id = best.id JOIN deg a ON a.node_id = node1 JOIN deg b ON b.node_id = node2)
  SELECT link_id, material, label_distance_m, diameter_from_cad, CAST(raw_mm AS DOUBLE) AS diameter_raw_mm, CAST(CASE WHEN free THEN least(raw_mm, 50) ELSE raw_mm END AS DOUBLE) AS diameter_capped_mm, {_snap("CASE WHEN free THEN least(raw_mm, 50) ELSE raw_mm END")} AS diameter_mm FROM sized""")
def diameter_assign(spark, sf_dir):
    points = read_labels(spark, sf_dir).select(F.col("id").alias("label_id"), ((F.col("id") * 7919) % 10007 / F.lit(10.0)).alias("x"), (F.col("id") * 31 % 1009).cast("double").alias("y"), "diameter_mm", "material")
    found = hydraulics.assign_diameters(net_pipes(spark, sf_dir), points, LADDER)
    return found.select("link_id", "material", "label_distance_m", "diameter_from_cad", "diameter_raw_mm", "diameter_capped_mm", "diameter_mm")


@query("raise_undersized", f"WITH {BASE}, {PIPES}, need AS (SELECT link_id, diameter_mm AS was_mm, sqrt(4 * (abs(CAST(link_id % 60 AS DOUBLE)) / 1000) / (pi() * 1.5)) * 1000 AS need FROM pipes) SELECT link_id, was_mm, greatest(was_mm, coalesce(list_min(list_filter([{', '.join(f'{v}::DOUBLE' for v in LADDER)}], lambda v: v >= need)), 400)) AS diameter_mm FROM need")
def raise_undersized(spark, sf_dir):
    pipes = net_pipes(spark, sf_dir).withColumn("flow_lps", (F.col("link_id") % 60).cast("double"))
    return pipes.select("link_id", F.col("diameter_mm").alias("was_mm"), hydraulics.raise_undersized(pipes, LADDER).alias("diameter_mm"))


@query("pick_source", f"WITH {BASE}, {PIPES}, w AS (SELECT * FROM pipes WHERE diameter_mm = (SELECT max(diameter_mm) FROM pipes)) SELECT node_id, x, y FROM (SELECT node1 AS node_id, x1 AS x, y1 AS y FROM w UNION ALL SELECT node2, x2, y2 FROM w) ORDER BY y DESC, node_id LIMIT 1")
def pick_source(spark, sf_dir):
    return hydraulics.pick_source(net_pipes(spark, sf_dir))


@memo
def solved(spark, sf_dir):
    nodes = net_nodes(spark, sf_dir).select(F.col("cluster").alias("network_id"), "node_id", (F.col("elevation_m") / 100).alias("elevation_m"), (F.col("demand_lps") / 100).alias("demand_lps"))
    code = F.element_at(F.array(*[F.lit(m) for m in labels.ROUGHNESS]), (F.col("link_id") % len(labels.ROUGHNESS) + 1).cast("int"))
    pipes = net_pipes(spark, sf_dir).select(F.col("cluster").alias("network_id"), "link_id", "node1", "node2", "length_m", "diameter_mm", labels.roughness(code).alias("roughness"))
    return hydraulics.solve(nodes, pipes, roots(spark, sf_dir).select(F.col("cluster").alias("network_id"), "node_id"), peak=2.5)


@query("hydraulic_solve")
def hydraulic_solve(spark, sf_dir):
    """Every nation's network; mass balance and losses are held in the tests."""
    return solved(spark, sf_dir)


@query("source_head_calibration")
def source_head_calibration(spark, sf_dir):
    heads = solved(spark, sf_dir)
    return heads.groupBy("network_id").agg(F.max(F.when(F.col("kind") == "source", F.col("head_m"))).alias("source_head_m"), F.min("pressure_m").alias("least_pressure_m"))


@query("fast_pipes")
def fast_pipes(spark, sf_dir):
    """The eight fastest pipes of all networks."""
    return solved(spark, sf_dir).filter("kind = 'pipe'").orderBy(F.desc("velocity_ms"), "id").limit(8).select("network_id", "id", "velocity_ms")


@query("network_problems", f"WITH {BASE}, {PIPES} SELECT 'length' AS problem, CAST(link_id AS VARCHAR) AS id FROM pipes WHERE length_m <= 0 UNION ALL SELECT 'no pipe', CAST(node_id AS VARCHAR) FROM nodes WHERE node_id NOT IN (SELECT node1 FROM pipes UNION SELECT node2 FROM pipes) UNION ALL SELECT 'diameter', CAST(link_id AS VARCHAR) FROM pipes WHERE diameter_mm <= 0")
def network_problems(spark, sf_dir):
    return hydraulics.check_network(net_nodes(spark, sf_dir), net_pipes(spark, sf_dir))


@query("network_faults", f"""WITH {BASE}, {PIPES}, broken AS (SELECT link_id, node1, CASE WHEN length_m > 1000 THEN -link_id ELSE node2 END AS node2, length_m, CASE WHEN length_m < 100 THEN 0 ELSE diameter_mm END AS diameter_mm FROM pipes),
  every AS (SELECT node_id FROM nodes UNION ALL SELECT -1000000 - s_suppkey FROM supplier)
  SELECT 'diameter' AS problem, CAST(link_id AS VARCHAR) AS id FROM broken WHERE diameter_mm <= 0 UNION ALL SELECT 'length', CAST(link_id AS VARCHAR) FROM broken WHERE length_m <= 0
  UNION ALL SELECT 'loop', CAST(link_id AS VARCHAR) FROM broken WHERE node1 = node2 UNION ALL SELECT 'unknown end', CAST(link_id AS VARCHAR) FROM broken WHERE node2 NOT IN (SELECT node_id FROM every)
  UNION ALL SELECT 'no pipe', CAST(node_id AS VARCHAR) FROM every WHERE node_id NOT IN (SELECT node1 FROM broken UNION SELECT node2 FROM broken)""")
def network_faults(spark, sf_dir):
    """A network with faults of most kinds: short pipes without a diameter, long
    ones to nowhere, nodes without a pipe."""
    pipes = net_pipes(spark, sf_dir)
    pipes = pipes.withColumns({"node2": F.when(F.col("length_m") > 1000, -F.col("link_id")).otherwise(F.col("node2")), "diameter_mm": F.when(F.col("length_m") < 100, 0.0).otherwise(F.col("diameter_mm"))})
    lone = table(spark, sf_dir, "supplier").select((F.lit(-1000000) - F.col("s_suppkey")).alias("node_id"))
    return hydraulics.check_network(net_nodes(spark, sf_dir).select("node_id").union(lone), pipes)


@query("prune_dangles")
def prune_dangles(spark, sf_dir):
    """Free short links go, again and again."""
    return topology.prune_dangles(net_pipes(spark, sf_dir), 400.0).select("link_id", "node1", "node2")


def chords(spark, sf_dir):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return net_pipes(spark, sf_dir).select(F.col("link_id").alias("line_id"), F.array(point("x1", "y1"), point("x2", "y2")).alias("points"))


@query("weld_endpoints")
def weld_endpoints(spark, sf_dir):
    """Ends within 15 m of each other meet."""
    return topology.weld(chords(spark, sf_dir), 15.0)


@query("split_rings", f"""WITH {BASE}, r AS (SELECT x, y, row_number() OVER (ORDER BY node_id) AS nr FROM nodes) SELECT 2 * nr - 1 AS line_id, round(x, 3) AS x1, round(y, 3) AS y1, round(x + 9, 3) AS xm, round(y, 3) AS ym, round(x + 9, 3) AS x2, round(y + 9, 3) AS y2 FROM r UNION ALL SELECT 2 * nr, round(x + 9, 3), round(y + 9, 3), round(x, 3), round(y + 9, 3), round(x, 3), round(y, 3) FROM r""")
def split_rings(spark, sf_dir):
    """A square at each node, as two lines cut at half its length."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    rings = net_nodes(spark, sf_dir).select(F.col("node_id").alias("line_id"), F.array(corner(0, 0), corner(9, 0), corner(9, 9), corner(0, 9), corner(0, 0)).alias("points"))
    halves = cleaning.halved_rings(rings)
    return halves.select("line_id", *[F.round(F.get("points", F.lit(i))[c], 3).alias(f"{c}{n}") for i, n in ((0, "1"), (1, "m"), (2, "2")) for c in "xy"])


@query("network_build")
def network_build(spark, sf_dir):
    """A square drawn around each node, cleaned into one connected network."""
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    drawn = net_nodes(spark, sf_dir).select(F.col("node_id").alias("line_id"), F.array(corner(0, 0), corner(9, 0), corner(9, 9), corner(0, 9), corner(0, 0)).alias("points"))
    links, _, _ = cleaning.build(drawn, size=10.0)
    return links.select("link_id", "node1", "node2", "length_m")


@query("contract_short", f"""WITH RECURSIVE {BASE}, {PIPES}, short AS (SELECT node1 AS a, node2 AS b FROM pipes WHERE length_m < 60 AND node1 <> node2 UNION ALL SELECT node2, node1 FROM pipes WHERE length_m < 60 AND node1 <> node2),
  walk AS (SELECT a AS node_id, a AS c FROM short UNION SELECT b, c FROM walk JOIN short ON a = node_id), moved AS (SELECT node_id, min(c) AS c FROM walk GROUP BY node_id),
  ends AS (SELECT link_id, coalesce(m.c, node1) AS node1, coalesce(n.c, node2) AS node2 FROM pipes LEFT JOIN moved m ON m.node_id = node1 LEFT JOIN moved n ON n.node_id = node2)
  SELECT link_id, node1, node2 FROM ends WHERE node1 <> node2""")
def contract_short(spark, sf_dir):
    links, _ = topology.merge_short(net_pipes(spark, sf_dir), net_nodes(spark, sf_dir), 60.0)
    return links.select("link_id", "node1", "node2")


@query("bridge_islands")
def bridge_islands(spark, sf_dir):
    """Connectors that join the nations' networks; one less than components."""
    return topology.bridge_islands(net_links(spark, sf_dir), net_nodes(spark, sf_dir), 150.0)


@query("node_and_merge")
def node_and_merge(spark, sf_dir):
    """Chords of all nations cut at every crossing, then chains merged."""
    pieces = noding.node(noding.segments(chords(spark, sf_dir)), 100.0)
    spots = pieces.select(F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("p.x", "p.y").distinct()
    spots = topology.number(spots, ["x", "y"], "node_id")
    a, b = spots.toDF("ax", "ay", "node1"), spots.toDF("bx", "by", "node2")
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    return noding.merge_chains(pieces.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).select("link_id", "node1", "node2", length.alias("length_m")))


@query("kmeans_zones")
def kmeans_zones(spark, sf_dir):
    """Five zones; every node is at its nearest centre, which the tests check."""
    zoned, _ = zones.kmeans_zones(net_nodes(spark, sf_dir).select("node_id", "x", "y"), ["x", "y"], k=5, starts=2)
    return zoned.select("node_id", "cluster")


@query("registration_grid")
def registration_grid(spark, sf_dir):
    """Finds the shift between an outline and a boundary of the same shape."""
    shape = [(0.0, 0.0), (900.0, 50.0), (800.0, 700.0), (350.0, 500.0), (60.0, 900.0)]
    moved = [(x + 210.0, y - 135.0) for x, y in shape]
    found = georeference.register(spark, shape, moved, reach=120.0, step=40.0)
    return spark.createDataFrame([(found["dx"], found["dy"], found["iou"], found["contrast"])], "dx double, dy double, iou double, contrast double")


@query("select_cluster", f"WITH {BASE}, {PIPES}, stats AS (SELECT cluster, avg(CASE WHEN x1 < 600 AND y1 < 600 THEN 1.0 ELSE 0.0 END) AS share, sum(CAST(length_m AS DECIMAL(28,9))) AS total FROM pipes GROUP BY cluster), best AS (SELECT cluster FROM stats ORDER BY CASE WHEN (SELECT max(share) FROM stats) > 0.05 THEN share ELSE 0 END DESC, total DESC, cluster LIMIT 1) SELECT link_id, cluster FROM pipes WHERE cluster IN (SELECT cluster FROM best)")
def select_cluster(spark, sf_dir):
    """The pipes of the network that lies most inside a box, else of the longest."""
    return topology.select_cluster(net_pipes(spark, sf_dir), "cluster", (F.col("x1") < 600) & (F.col("y1") < 600)).select("link_id", "cluster")


@query("source_at", f"WITH {BASE} SELECT node_id, x, y FROM nodes ORDER BY (x - 500) * (x - 500) + (y - 250) * (y - 250), node_id LIMIT 1")
def source_at(spark, sf_dir):
    return hydraulics.source_at(net_nodes(spark, sf_dir), 500.0, 250.0)


@query("line_middle", f"WITH {BASE}, {PIPES} SELECT link_id, round((x1 + x2) / 2, 6) AS x, round((y1 + y2) / 2, 6) AS y FROM pipes WHERE length_m > 0")
def line_middle(spark, sf_dir):
    """The point at half of each pipe's length."""
    middle = cleaning.point_along(F.col("points"), F.lit(0.5))
    return chords(spark, sf_dir).select(F.col("line_id").alias("link_id"), middle.alias("p")).filter("p IS NOT NULL").select("link_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("cluster_choice", "SELECT c_mktsegment AS best FROM customer GROUP BY 1 ORDER BY CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*) DESC, count(*) DESC LIMIT 1")
def cluster_choice(spark, sf_dir):
    """The cluster with the largest share inside, of equals the longest."""
    stats = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg((F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("share"), F.count("*").alias("length"))
    return stats.agg(F.max_by("c_mktsegment", F.struct("share", "length")).alias("best"))
