"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents by a hash. A document's virtual finish time
is the running count of its source's words divided by the source's target; the
second and third pass over a source go on counting. Documents of all sources
are ranged by finish time and the range is cut where the total budget is spent,
so every source has then been served up to about its target.

DataFrame operations only. Running sums are taken in two levels (sums of hash
ranges, then rows within a range), so that a source with most of the rows is
never in one task.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own, the last one; repeated rows are separate
documents; copies with equal finish times are taken together or not at all; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges of a source (2 ** RANGE_BITS), and slices of virtual time looked at in one step of the cut.
RANGE_BITS, SLICES = 12, 4096


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], repeat: int) -> DataFrame:
    """Per source its size and target: (source, source_size, target).

    Shares of the total by weight, none above ``repeat`` times its source; what
    is above is shared again by weight. That ends where a level L exists with
    target = min(repeat * size, L * weight), and the sources that are cut are
    those with the smallest repeat * size / weight, so one pass in that order
    finds L. The frame has a row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
    everywhere = W.partitionBy()
    by_need = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(repeat)
    filled = named.select(
        "*",
        (F.sum("source_size").over(everywhere) - F.coalesce(F.sum(cap).over(by_need), F.lit(0))).alias("left"),
        (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(by_need), F.lit(0))).alias("left_weight"),
    ).withColumn("cut", cap * F.col("left_weight") <= F.col("left") * F.col("weight"))
    level = F.max(F.when(~F.col("cut"), F.struct((F.col("left") / F.col("left_weight")).alias("l"), "left", "left_weight"))).over(everywhere)
    target = F.when(F.col("cut"), cap.cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.left_weight"))
    return filled.withColumn("level", level).select("source", "source_size", target.alias("target"))


def schedule(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = (5, 2, 1), repeat: int = 3, seed: int = 0) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, served): served
    counts the words of the source up to and with the document in its shuffle.

    ``text_key`` is a hash of the text; with the id it orders equal hashes.
    """
    text = F.col(text_col)
    base = cut(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text).alias("text_key"),
            F.col(source_col).alias("source"),
            words(text).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("turn"),
        )
    )
    targets = source_targets(base, weights, repeat).withColumnRenamed("source", "__source")
    ranged = base.withColumn("span", F.shiftright("turn", 64 - RANGE_BITS))
    before = W.partitionBy("source").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = (
        ranged.groupBy("source", "span")
        .agg(F.sum("size").alias("span_size"))
        .withColumn("offset", F.coalesce(F.sum("span_size").over(before), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("__source")))
        .select(F.col("source").alias("__source"), F.col("span").alias("__span"), "offset", "source_size", "target")
    )
    within = W.partitionBy("source", "span").orderBy("turn", "text_key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.withColumn("upto", F.sum("size").over(within))
        .join(spans, F.col("source").eqNullSafe(F.col("__source")) & (F.col("span") == F.col("__span")))
        .select("doc_id", "text_key", "source", "size", "source_size", "target", (F.col("offset") + F.col("upto")).alias("served"))
    )


def _finish(turn: Column) -> Column:
    return (turn * F.col("source_size") + F.col("served")) / F.col("target")


def cut_time(scheduled: DataFrame, repeat: int = 3) -> float:
    """The last virtual finish time within the budget, which is all words.

    Virtual time is cut into SLICES ranges whose sums come to the driver (that
    many rows, whatever the input); the range where the budget ends is cut
    again, until it is as narrow as a double can tell.
    """
    served = scheduled.filter("size > 0 AND target > 0")
    copies = served.select("size", F.explode(F.array(*[_finish(F.lit(k)) for k in range(repeat)])).alias("finish"))
    budget = scheduled.agg(F.sum("size")).first()[0] or 0
    low, width, spent, last = 0.0, 2.0 / SLICES, 0, 0.0
    while True:
        slot = F.floor((F.col("finish") - F.lit(low)) / F.lit(width))
        slot = F.greatest(F.lit(0), F.least(slot, F.lit(SLICES))).cast("int")
        sums = copies.filter(F.col("finish") > F.lit(last)).groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.min("finish").alias("first"), F.max("finish").alias("last"))
        for row in sorted(sums.collect()):
            if spent + row["size"] > budget:
                break
            spent, last = spent + row["size"], row["last"]
        else:
            return float("inf")
        if row["first"] == row["last"] or width < 1e-15:
            return last
        low, width = low + row["slot"] * width, width / SLICES if row["slot"] < SLICES else width * SLICES


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = (5, 2, 1), repeat: int = 3, seed: int = 0) -> DataFrame:
    """A row for each document with how often and how much of it the mix takes:
    (doc_id, text_key, source, size, source_size, target, times, taken, finish).

    ``finish`` is the virtual time of its first copy; ordering by it gives the
    order in which the mix serves documents.
    """
    scheduled = cut(schedule(df, id_col, text_col, source_col, weights, repeat, seed))
    limit = F.lit(cut_time(scheduled, repeat))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(F.when(_finish(F.lit(k)) <= limit, 1).otherwise(0) for k in range(repeat))).otherwise(0)
    return scheduled.select(
        "doc_id", "text_key", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        taken.cast("int").alias("times"), (taken * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("target") > 0, _finish(F.lit(0))).alias("finish"),
    )


def serve(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = (5, 2, 1), repeat: int = 3, seed: int = 0) -> DataFrame:
    """The rows of df that the mix takes, as often as it takes them, range-sorted by
    virtual finish time; with the columns ``mix_pass`` and ``mix_finish``, which
    replace any of these names."""
    planned = mix(df, id_col, text_col, source_col, weights, repeat, seed).filter("times > 0")
    planned = planned.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("finish").alias("__finish"), F.col("times").alias("__times"), F.col("source").alias("__source"), (F.col("source_size") / F.col("target")).alias("__pass"))
    planned = planned.withColumn("__nr", F.row_number().over(W.partitionBy("__id", "__key", "__source").orderBy("__finish")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))  # one column, so that its own names cannot clash
    key, text, source = F.col("__row")[id_col], F.col("__row")[text_col], F.col("__row")[source_col]
    rows = rows.withColumns({"__own_id": key, "__own_key": F.xxhash64(text), "__own_source": source})
    rows = rows.withColumn("__own_nr", F.row_number().over(W.partitionBy("__own_id", "__own_key", "__own_source").orderBy(F.xxhash64("__row"))))
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key")) & F.col("__own_source").eqNullSafe(F.col("__source"))
    joined = rows.join(planned, same & (F.col("__own_nr") == F.col("__nr")))
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).withColumn("__at", F.col("__finish") + F.col("__copy") * F.col("__pass"))
    served = copies.repartitionByRange("__at", "__own_id").sortWithinPartitions("__at", "__own_id")
    return served.select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in ("mix_pass", "mix_finish")], F.col("__copy").alias("mix_pass"), F.col("__at").alias("mix_finish"))
