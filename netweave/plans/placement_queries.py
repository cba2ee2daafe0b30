"""Placement, roll-ups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.operators import placement
from netweave.plans.fixtures import BASE, PIPES, net_nodes, net_pipes
from netweave.plans.registry import query

FIGURES = """
figures0 AS (
  SELECT cluster, CAST(sum(CAST(elevation_m AS DECIMAL(28,6))) AS DOUBLE) / count(elevation_m) AS mean_elev, list_sort(list(pressure_m)) AS ps, 0.2::DOUBLE * (count(*) - 1) AS at_lo, 0.8::DOUBLE * (count(*) - 1) AS at_hi,
    CAST(sum(CAST(demand_lps AS DECIMAL(28,6))) AS DOUBLE) / count(demand_lps) AS mean_demand, count(*) AS group_size
  FROM nodes GROUP BY cluster),
figures AS (
  SELECT cluster, mean_elev, mean_demand, group_size,
    CASE WHEN floor(at_lo) = ceil(at_lo) THEN ps[CAST(at_lo AS BIGINT) + 1] ELSE (ceil(at_lo) - at_lo) * ps[CAST(floor(at_lo) AS BIGINT) + 1] + (at_lo - floor(at_lo)) * ps[CAST(ceil(at_lo) AS BIGINT) + 1] END AS p_lo,
    CASE WHEN floor(at_hi) = ceil(at_hi) THEN ps[CAST(at_hi AS BIGINT) + 1] ELSE (ceil(at_hi) - at_hi) * ps[CAST(floor(at_hi) AS BIGINT) + 1] + (at_hi - floor(at_hi)) * ps[CAST(ceil(at_hi) AS BIGINT) + 1] END AS p_hi
  FROM figures0),
flags AS (
  SELECT nodes.*, mean_elev, p_lo, p_hi, mean_demand, node_type IN ('dead_end', 'junction') AS f1_topology, elevation_m > mean_elev AS f2_elevation,
    pressure_m <= p_lo OR pressure_m >= p_hi AS f3_pressure, demand_lps > mean_demand AS f4_demand
  FROM nodes JOIN figures USING (cluster)),
passing AS (SELECT *, f1_topology AND f2_elevation AND f3_pressure AND f4_demand AS passed FROM flags),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cluster, f1_topology AND f2_elevation AND NOT passed ORDER BY demand_lps DESC, node_id) AS nr,
    sum(CAST(passed AS INTEGER)) OVER (PARTITION BY cluster) AS n_passed FROM passing),
chosen AS (SELECT * EXCLUDE (nr, n_passed), passed OR (f1_topology AND f2_elevation AND NOT passed AND nr <= 5 - n_passed) AS selected FROM ranked)
"""
ALL = f"WITH {BASE}, {FIGURES} "
RISKS = """list_filter([CASE WHEN node_type = 'dead_end' THEN 'StagnationRisk' END, CASE WHEN pressure_m <= round(p_lo, 2) THEN 'IntrusionRisk' END,
  CASE WHEN pressure_m >= round(p_hi, 2) THEN 'LeakageRisk' END, CASE WHEN f4_demand THEN 'ServiceLevelRisk' END], lambda x: x IS NOT NULL)"""


def flagged(spark, sf_dir):
    return placement.cascade(net_nodes(spark, sf_dir))


def chosen(spark, sf_dir):
    return placement.top_up(flagged(spark, sf_dir))


@query("placement_cascade", ALL + "SELECT node_id, cluster, mean_elev, p_lo, p_hi, mean_demand, f1_topology, f2_elevation, f3_pressure, f4_demand, passed, selected FROM chosen")
def placement_cascade(spark, sf_dir):
    return chosen(spark, sf_dir).select("node_id", "cluster", "mean_elev", "p_lo", "p_hi", "mean_demand", "f1_topology", "f2_elevation", "f3_pressure", "f4_demand", "passed", "selected")


@query("placement_attrition", ALL + """SELECT count(*) AS all_nodes, count(*) FILTER (f1_topology) AS f1, count(*) FILTER (f1_topology AND f2_elevation) AS f1_f2,
  count(*) FILTER (f1_topology AND f2_elevation AND f3_pressure) AS f1_f2_f3, count(*) FILTER (passed) AS f1_f2_f3_f4, count(*) FILTER (selected AND NOT passed) AS topped_up, count(*) FILTER (selected) AS selected FROM chosen""")
def placement_attrition(spark, sf_dir):
    return placement.attrition(chosen(spark, sf_dir))


@query("placement_topup", ALL + "SELECT node_id, cluster, demand_lps FROM chosen WHERE selected AND NOT passed")
def placement_topup(spark, sf_dir):
    return chosen(spark, sf_dir).filter("selected AND NOT passed").select("node_id", "cluster", "demand_lps")


_FIXED = lambda c, n: f"CAST(round(CAST({c} AS DECIMAL(28,12)), {n}) AS VARCHAR)"  # noqa: E731  half up, as the engine shows figures


@query("placement_reason", ALL + f"""SELECT node_id, concat_ws('; ', CASE WHEN node_type = 'dead_end' THEN 'dead end' ELSE 'junction' END,
  CASE WHEN f2_elevation THEN 'elev ' || {_FIXED("elevation_m", 1)} || ' m > DMA mean ' || {_FIXED("mean_elev", 1)} END,
  CASE WHEN pressure_m <= round(p_lo, 2) THEN 'low pressure ' || {_FIXED("pressure_m", 1)} || ' m (<= P20 ' || CAST(round(p_lo, 2) AS VARCHAR) || ')'
    WHEN pressure_m >= round(p_hi, 2) THEN 'high pressure ' || {_FIXED("pressure_m", 1)} || ' m (>= ' || CAST(round(p_hi, 2) AS VARCHAR) || ')' END,
  CASE WHEN f4_demand THEN 'demand ' || {_FIXED("demand_lps", 4)} || ' L/s > DMA mean ' || {_FIXED("mean_demand", 4)} END) AS reason FROM chosen WHERE selected""")
def placement_reason(spark, sf_dir):
    picked = chosen(spark, sf_dir).filter("selected")
    return picked.select("node_id", placement.reason(picked).alias("reason"))


@query("placement_risk_flags", ALL + f"SELECT node_id, CASE WHEN len({RISKS}) > 0 THEN array_to_string({RISKS}, '|') ELSE 'None' END AS risk_flags FROM chosen WHERE selected")
def placement_risk_flags(spark, sf_dir):
    return chosen(spark, sf_dir).filter("selected").select("node_id", placement.risk_text(placement.risks()).alias("risk_flags"))


@query("risk_flags_exploded", ALL + f"SELECT node_id, unnest({RISKS}) AS risk FROM chosen WHERE selected")
def risk_flags_exploded(spark, sf_dir):
    flags = placement_risk_flags(spark, sf_dir).select("node_id", F.explode(F.split("risk_flags", r"\|")).alias("risk"))
    return flags.filter("risk NOT IN ('', 'None')")


@query("dma_rollup", ALL + "SELECT cluster, count(*) AS node_count, CAST(sum(CAST(elevation_m AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_elevation, CAST(sum(CAST(pressure_m AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS mean_pressure, CAST(sum(CAST(demand_lps AS DECIMAL(28,6))) AS DOUBLE) AS aggregate_demand FROM nodes GROUP BY cluster")
def dma_rollup(spark, sf_dir):
    mean = placement.exact_mean
    return net_nodes(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("node_count"), mean("elevation_m").alias("mean_elevation"), mean("pressure_m").alias("mean_pressure"), F.sum(F.col("demand_lps").cast("decimal(28,6)")).cast("double").alias("aggregate_demand"))


@query("per_group_counts", ALL + "SELECT cluster, count(*) AS nodes, count(*) FILTER (selected) AS stations FROM chosen GROUP BY cluster")
def per_group_counts(spark, sf_dir):
    return chosen(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("nodes"), F.count_if("selected").alias("stations"))


@query("network_summary", f"""WITH {BASE}, {PIPES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM pipes) AS pipes, min(elevation_m) AS elevation_min, median(elevation_m) AS elevation_median, max(elevation_m) AS elevation_max,
  quantile_cont(pressure_m, 0.2) AS pressure_p20, quantile_cont(pressure_m, 0.8) AS pressure_p80, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north, (min(x) + max(x)) / 2 AS centre_x, (min(y) + max(y)) / 2 AS centre_y,
  (SELECT list_sort(list_distinct(list(diameter_mm))) FROM pipes) AS diameters FROM nodes""")
def network_summary(spark, sf_dir):
    nodes, pipes = net_nodes(spark, sf_dir), net_pipes(spark, sf_dir)
    left = nodes.agg(
        F.count("*").alias("nodes"), F.min("elevation_m").alias("elevation_min"), F.percentile("elevation_m", F.lit(0.5)).alias("elevation_median"), F.max("elevation_m").alias("elevation_max"),
        F.percentile("pressure_m", F.lit(0.2)).alias("pressure_p20"), F.percentile("pressure_m", F.lit(0.8)).alias("pressure_p80"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"),
        ((F.min("x") + F.max("x")) / 2).alias("centre_x"), ((F.min("y") + F.max("y")) / 2).alias("centre_y"),
    )
    right = pipes.agg(F.count("*").alias("pipes"), F.sort_array(F.collect_set("diameter_mm")).alias("diameters"))
    return left.crossJoin(right)  # one row each


@query("crosstab", "SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0) AS below, count(*) FILTER (c_acctbal >= 0) AS above FROM customer GROUP BY c_mktsegment")
def crosstab(spark, sf_dir):
    from netweave.session import table

    sided = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") < 0, "below").otherwise("above").alias("side"))
    return sided.groupBy("c_mktsegment").pivot("side", ["below", "above"]).count().fillna(0)


@query("histogram_26", "WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT least(CAST(floor((c_acctbal - lo) / ((hi - lo) / 26)) AS BIGINT), 25) AS bin, count(*) AS n FROM customer, b GROUP BY 1")
def histogram_26(spark, sf_dir):
    from netweave.session import table

    balances = table(spark, sf_dir, "customer").select("c_acctbal")
    edges = balances.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    slot = F.least(F.floor((F.col("c_acctbal") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 26)), F.lit(25))
    return balances.crossJoin(edges).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))  # edges: one row
