"""A network built from the star tables, for the engine's queries.

One node for each customer, a chain of links within each nation with some
chords, labels from parts, stations from suppliers. ``BASE`` is the same in SQL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.operators import topology
from netweave.session import cut, release, table

LADDER = (40.0, 50.0, 75.0, 100.0, 150.0, 200.0, 250.0, 300.0, 350.0, 400.0)

BASE = """
links0 AS (
  SELECT lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS node1, c_custkey AS node2 FROM customer
  UNION ALL
  SELECT a.node1, a.node2 FROM (SELECT lag(c_custkey, 7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS node1, c_custkey AS node2 FROM customer WHERE c_custkey % 5 = 0) a),
links AS (SELECT node1, node2, row_number() OVER (ORDER BY node2, node1) AS link_id FROM links0 WHERE node1 IS NOT NULL),
deg AS (SELECT node_id, count(*) AS degree FROM (SELECT node1 AS node_id FROM links UNION ALL SELECT node2 FROM links) GROUP BY node_id),
placed AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
nodes AS (
  SELECT c_custkey AS node_id, c_nationkey + 1 AS cluster,
    ((c_custkey * 7919) % 10007) / CAST(10 AS DOUBLE) AS x, ((c_custkey * 104729) % 10007) / CAST(10 AS DOUBLE) AS y,
    c_acctbal AS elevation_m, CAST(coalesce(n, 0) AS DOUBLE) AS demand_lps, CAST((c_custkey * 613) % 1009 AS DOUBLE) AS pressure_m,
    CAST(coalesce(degree, 0) AS BIGINT) AS degree,
    CASE WHEN degree = 1 THEN 'dead_end' WHEN degree = 2 THEN 'bend' ELSE 'junction' END AS node_type
  FROM customer LEFT JOIN placed ON o_custkey = c_custkey LEFT JOIN deg ON deg.node_id = c_custkey)
"""
#: Links with end points, length and a diameter by turns.
PIPES = """
pipes AS (
  SELECT link_id, node1, node2, a.cluster AS cluster, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
    sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length_m,
    list_extract([40.0, 50.0, 75.0, 100.0, 150.0, 200.0, 250.0, 300.0, 350.0, 400.0], CAST(link_id % 10 AS INTEGER) + 1)::DOUBLE AS diameter_mm
  FROM links JOIN nodes a ON a.node_id = node1 JOIN nodes b ON b.node_id = node2)
"""


_HELD: dict = {}


def memo(build, keep=cut):
    """Build a fixture once for a session and folder, kept in the shared folder
    until ``forget`` is called or the application ends."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (build.__module__, build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _HELD:
            _HELD[key] = keep(build(spark, sf_dir))
        return _HELD[key]

    return get


def forget() -> None:
    """Delete what memo has kept: after the tables change, or to time a query whole."""
    for held in _HELD.values():
        release(held)
    _HELD.clear()


@memo
def net_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    by_nation = W.partitionBy("c_nationkey").orderBy("c_custkey")
    chain = customer.select(F.lag("c_custkey").over(by_nation).alias("node1"), F.col("c_custkey").alias("node2"))
    fifth = customer.filter("c_custkey % 5 = 0").select(F.lag("c_custkey", 7).over(by_nation).alias("node1"), F.col("c_custkey").alias("node2"))
    return topology.number(chain.union(fifth).filter("node1 IS NOT NULL"), ["node2", "node1"], "link_id")


@memo
def net_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    degree = topology.degree_map(net_links(spark, sf_dir), "node1", "node2")
    key = F.col("c_custkey")
    return (
        customer.join(orders.groupBy("o_custkey").agg(F.count("*").alias("n")), key == F.col("o_custkey"), "left")
        .join(degree, key == F.col("node_id"), "left")
        .select(
            key.alias("node_id"), (F.col("c_nationkey") + 1).alias("cluster"), ((key * 7919) % 10007 / F.lit(10.0)).alias("x"), ((key * 104729) % 10007 / F.lit(10.0)).alias("y"),
            F.col("c_acctbal").alias("elevation_m"), F.coalesce("n", F.lit(0)).cast("double").alias("demand_lps"), (key * 613 % 1009).cast("double").alias("pressure_m"),
            F.coalesce("degree", F.lit(0)).alias("degree"), topology.node_class(F.col("degree")).alias("node_type"),
        )
    )


@memo
def net_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = net_nodes(spark, sf_dir), net_links(spark, sf_dir)
    a = nodes.select(F.col("node_id").alias("node1"), "cluster", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("node2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = F.element_at(F.array(*map(F.lit, LADDER)), (F.col("link_id") % 10 + 1).cast("int"))
    return links.join(a, "node1").join(b, "node2").select("link_id", "node1", "node2", "cluster", "x1", "y1", "x2", "y2", F.sqrt(dx * dx + dy * dy).alias("length_m"), size.alias("diameter_mm"))


@lru_cache(maxsize=1)
def label_sql() -> str:
    """Texts as they stand on drawings, by turns, from parts."""
    return """CASE p_partkey % 9
      WHEN 0 THEN concat(p_size, '"') WHEN 1 THEN concat('new ', p_size * 10, 'mm') WHEN 2 THEN concat(p_size % 3 + 1, ' 1/2"')
      WHEN 3 THEN concat(p_size, '"G.I.') WHEN 4 THEN CAST(p_size * 45 AS STRING) WHEN 5 THEN concat(' C.I. ', p_size, '.5" ')
      WHEN 6 THEN CASE p_size % 6 WHEN 0 THEN 'A.V.' WHEN 1 THEN 'Non return value' WHEN 2 THEN 'W.O.' WHEN 3 THEN 'Fire hydrant' WHEN 4 THEN 'P/H' ELSE 'dead end' END
      WHEN 7 THEN concat('S.V. ', p_size, ' "') ELSE concat(p_size * 5, ' M.M. HDPE') END"""
