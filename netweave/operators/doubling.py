"""Pointer doubling: each round a row looks twice as far, so paths are walked in
a number of rounds that grows with the logarithm of their length. A round is one
equi-join on a key that no two rows share; its result is written, so lineage
stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.session import cut, release


def to_the_end(steps: DataFrame, sums: str | None = None) -> DataFrame:
    """(id, end, n) of (id, next): the last row that the pointers lead to and
    how many steps away it is. A row whose next is null, or leads to no row, is an
    end. With sums, a decimal or whole column of steps, also ``total``: that column
    summed from the row to the end, both counted.

    Pointers must not run in circles; see ``rings``."""
    value = F.col(sums) if sums else F.lit(0)
    rows = steps.select("id", "next", value.alias("total"))
    known = rows.select(F.col("id").alias("next"), F.lit(True).alias("there"))
    rows = cut(rows.join(known, "next", "left").select("id", F.when(F.col("there"), F.col("next")).alias("next"), "total").withColumns({"end": F.coalesce("next", "id"), "n": F.col("next").isNotNull().cast("long")}))
    kind = rows.schema["total"].dataType
    while rows.filter("next IS NOT NULL").take(1):
        ahead = rows.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("end").alias("end2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        done, moved = rows, rows.join(ahead, "next", "left")
        rows = cut(moved.select("id", F.col("next2").alias("next"), (F.col("total") + F.coalesce("total2", F.lit(0))).cast(kind).alias("total"), F.coalesce("end2", "end").alias("end"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
        release(done)
    return rows.select("id", "end", "n", *["total"] * bool(sums))


def rings(steps: DataFrame) -> DataFrame:
    """(id, ring, at) of (id, next), in which every row is the next of exactly one:
    the smallest id of the row's circle, and the row's place in it, from 0 at that id."""
    rows = cut(steps.select("id", "next", F.least("id", "next").alias("low"), F.lit(False).alias("same")))
    while True:
        ahead = rows.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        moved = rows.join(ahead, "next").select("id", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), (F.col("low") <= F.col("low2")).alias("same"))
        done, rows = rows, cut(moved)
        release(done)
        # as many steps ahead as behind nothing smaller was met, by any row
        if not rows.filter("NOT same").take(1):
            break
    ringed = cut(steps.join(rows.select("id", F.col("low").alias("ring")), "id"))
    places = to_the_end(ringed.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next")))
    lengths = places.groupBy("end").agg(F.max("n").alias("length"))
    return ringed.select("id", "ring").join(places.join(lengths, "end").select("id", (F.col("length") - F.col("n")).alias("at")), "id")
