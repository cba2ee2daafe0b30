"""Connected components of an undirected graph, as a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.session import cut, release


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """df as if nothing were known of how its rows lie. A grouped frame that is
    joined on its key keeps its partitions, and adaptive execution cannot split
    the other side where that has very many rows of a key; both sides of an
    exchange of their own it can."""
    return df.withColumn(key, F.array_min(F.array(key)))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of the edges with the smallest node that
    it is connected to. Nodes may be of any type that can be ordered.

    Alternates large stars (each larger neighbour moves to the smallest node
    around) and small stars (a node's smaller neighbours move to the smallest
    of them) until every component is a star around its smallest node; that
    takes a number of rounds that grows with the logarithm of the graph's
    diameter. A round is grouped minima and equi-joins, which adaptive execution
    splits where a node has very many neighbours, and of which none is broadcast, so
    that rounds send nothing of the graph to the driver; a round's result is written
    to the shared folder, so lineage stays short and a lost executor costs one round.

    Edges with a null end and loops link nothing; a node that only has loops is
    not returned. Repeated edges count once.
    """
    a, b = F.col(src), F.col(dst)
    edges = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = cut(edges.distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("at"), F.col("lo").alias("other")).union(edges.select("lo", "hi"))
        lowest = both.groupBy("at").agg(F.min("other").alias("other")).select(F.col("at").alias("lo"), F.least("at", "other").alias("low"))
        large = edges.join(dealt_anew(lowest, "lo").hint("merge"), "lo").select("hi", F.col("low").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(dealt_anew(lowest, "hi").hint("merge"), "hi").filter(F.col("lo") != F.col("low")).select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        done, edges = edges, cut(small.union(lowest.select("hi", "low")).distinct())
        release(done)
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select(F.col("lo").alias("node"), F.col("lo")).distinct())
