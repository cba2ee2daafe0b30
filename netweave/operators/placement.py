"""Monitoring locations: four filters by group, a floor per group, reasons and
risks. Group figures are exact sums and exact percentiles, joined to the rows by
windows; nothing leaves the cluster."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_mean(column: str) -> Column:
    """A mean that does not depend on the order of rows: summed as decimals."""
    return F.sum(F.col(column).cast("decimal(28,6)")).cast("double") / F.count(column)


def group_figures(nodes: DataFrame, group: str = "cluster", low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Per group the means of elevation and demand, and the exact percentiles
    (linear interpolation) of pressure."""
    return nodes.groupBy(group).agg(
        exact_mean("elevation_m").alias("mean_elev"),
        F.percentile("pressure_m", F.lit(low)).alias("p_lo"),
        F.percentile("pressure_m", F.lit(high)).alias("p_hi"),
        exact_mean("demand_lps").alias("mean_demand"),
        F.count("*").alias("group_size"),
    )


def cascade(nodes: DataFrame, group: str = "cluster", classes: Sequence[str] = ("dead_end", "junction"), low: float = 0.2, high: float = 0.8) -> DataFrame:
    """The nodes with f1_topology .. f4_demand and passed: of a class; higher
    than the group's mean; in a pressure tail (inclusive); demand above the
    mean of the whole group."""
    joined = nodes.join(group_figures(nodes, group, low, high), group)
    pressure = F.col("pressure_m")
    flagged = joined.select(
        *nodes.columns, "mean_elev", "p_lo", "p_hi", "mean_demand",
        F.col("node_type").isin(*classes).alias("f1_topology"), (F.col("elevation_m") > F.col("mean_elev")).alias("f2_elevation"),
        ((pressure <= F.col("p_lo")) | (pressure >= F.col("p_hi"))).alias("f3_pressure"), (F.col("demand_lps") > F.col("mean_demand")).alias("f4_demand"),
    )
    return flagged.withColumn("passed", F.expr("f1_topology AND f2_elevation AND f3_pressure AND f4_demand"))


def top_up(flagged: DataFrame, group: str = "cluster", floor: int = 5) -> DataFrame:
    """Adds ``selected``: the passed nodes and, where a group has fewer than
    floor, the best of its f1 and f2 nodes by demand, then id."""
    by_demand = W.partitionBy(group).orderBy(F.desc("demand_lps"), "node_id")
    pool = flagged.filter("f1_topology AND f2_elevation AND NOT passed").select(group, "node_id", "demand_lps")
    best = pool.withColumn("nr", F.row_number().over(by_demand)).filter(F.col("nr") <= floor)  # so many of a group at most leave a task
    passed = flagged.groupBy(group).agg(F.sum(F.col("passed").cast("int")).alias("n_passed"))
    added = best.join(passed, group).filter(F.col("nr") <= F.lit(floor) - F.col("n_passed")).select("node_id", F.lit(True).alias("added"))
    return flagged.join(added, "node_id", "left").withColumn("selected", F.col("passed") | F.coalesce("added", F.lit(False))).select(*flagged.columns, "selected")


def attrition(selected: DataFrame) -> DataFrame:
    """How many nodes are left after each filter, one row."""
    n = lambda condition: F.count_if(F.expr(condition))
    return selected.agg(
        F.count("*").alias("all_nodes"), n("f1_topology").alias("f1"), n("f1_topology AND f2_elevation").alias("f1_f2"), n("f1_topology AND f2_elevation AND f3_pressure").alias("f1_f2_f3"),
        n("passed").alias("f1_f2_f3_f4"), n("selected AND NOT passed").alias("topped_up"), n("selected").alias("selected"),
    )


def _fixed(value: Column, digits: int) -> Column:
    """A figure with that many digits, rounded half up on its first 12 decimals, as
    CAST(x AS DECIMAL(28,12)) has them in the queries' SQL: 8727.05 is a little less
    than it says, so with one digit it is 8727.0. Beyond 9 million 12 decimals say
    nothing, and the shortest decimals of the figure are rounded."""
    units = F.round(value * 1e12).try_cast("long")
    rounded = F.floor((F.abs(units) + 5 * 10 ** (11 - digits)) / F.lit(Decimal(10 ** (12 - digits)))).cast("decimal(18,0)")
    shown = (F.when(units < 0, -rounded).otherwise(rounded) * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(22,{digits})").cast("string")
    return F.when(F.abs(value) < 9e6, shown).otherwise(F.format_string(f"%.{digits}f", value))


def reason(selected: DataFrame, low_percent: int = 20) -> Column:
    """Why a node was taken, in words. Tails are told by thresholds rounded to
    two digits, as they are shown."""
    lo, hi, p = F.round("p_lo", 2), F.round("p_hi", 2), F.col("pressure_m")
    return F.concat_ws(
        "; ",
        F.when(F.col("node_type") == "dead_end", "dead end").otherwise("junction"),
        F.when(F.col("f2_elevation"), F.concat(F.lit("elev "), _fixed(F.col("elevation_m"), 1), F.lit(" m > DMA mean "), _fixed(F.col("mean_elev"), 1))),
        F.when(p <= lo, F.concat(F.lit("low pressure "), _fixed(p, 1), F.lit(f" m (<= P{low_percent} "), lo.cast("string"), F.lit(")"))).when(p >= hi, F.concat(F.lit("high pressure "), _fixed(p, 1), F.lit(" m (>= "), hi.cast("string"), F.lit(")"))),
        F.when(F.col("f4_demand"), F.concat(F.lit("demand "), _fixed(F.col("demand_lps"), 4), F.lit(" L/s > DMA mean "), _fixed(F.col("mean_demand"), 4))),
    )


def risks() -> Column:
    """The risks at a node, an array."""
    lo, hi, p = F.round("p_lo", 2), F.round("p_hi", 2), F.col("pressure_m")
    named = ((F.col("node_type") == "dead_end", "StagnationRisk"), (p <= lo, "IntrusionRisk"), (p >= hi, "LeakageRisk"), (F.col("f4_demand"), "ServiceLevelRisk"))
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in named]))


def risk_text(flags: Column) -> Column:
    return F.when(F.size(flags) > 0, F.array_join(flags, "|")).otherwise("None")
