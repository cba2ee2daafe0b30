"""Runs of neighbouring rows in an order, without a window over a whole group.

Rows are ranged by the order; windows run within a range, and what a range's
first rows must know of the ranges before it is one row for each of them. So a
group of any size is dealt over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.session import cut


def islands(df: DataFrame, order: Sequence[str], breaks: Callable[[Column], Column]) -> DataFrame:
    """df with ``island``, the place in the order of a run's first row, and
    ``at``, a row's place in its run from 0. breaks says of a row, from the row
    before it (a struct of all columns), whether a run starts there; where it says
    null, and at the first row, one does. The order must be unique, or ties are
    taken as they come. No column may be named ``__range``, ``__place``, ``__before``
    or ``__start``."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()))
    row = F.struct(*[F.col(c) for c in df.columns])
    tails = cut(ranged.groupBy("__range").agg(F.count("*").alias("n"), F.max_by(row, F.struct(*order)).alias("__tail")))
    known, at, before = [], 0, None
    for place, n in tails.select("__range", "n").sort("__range").collect():  # a row for each range
        known.append((place, at, before))
        at, before = at + n, place
    offsets = spark.createDataFrame(known, "__range int, __offset long, __previous int")
    carried = offsets.join(F.broadcast(tails.select(F.col("__range").alias("__previous"), "__tail")), "__previous", "left").drop("__previous")
    in_range = W.partitionBy("__range").orderBy(*order)
    seen = ranged.join(F.broadcast(carried), "__range").select(
        *df.columns, "__range", (F.row_number().over(in_range) - 1 + F.col("__offset")).alias("__place"), F.coalesce(F.lag(row).over(in_range), F.col("__tail")).alias("__before")
    )
    first = F.col("__before").isNull() | F.coalesce(breaks(F.col("__before")), F.lit(True))
    started = cut(seen.withColumn("__start", F.when(first, F.col("__place"))).drop("__before"))
    latest, last = [], None
    for r in started.groupBy("__range").agg(F.max("__start").alias("start")).sort("__range").collect():  # a row for each range
        latest.append((r["__range"], last))
        last = r["start"] if r["start"] is not None else last
    latest = spark.createDataFrame(latest, "__range int, __last long")
    island = F.coalesce(F.max("__start").over(in_range.rowsBetween(W.unboundedPreceding, 0)), F.col("__last"))
    return started.join(F.broadcast(latest), "__range").withColumn("island", island).select(*df.columns, "island", (F.col("__place") - F.col("island")).alias("at"))
