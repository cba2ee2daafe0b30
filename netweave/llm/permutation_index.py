"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each shard of the index
posts its vectors in inverted files, one for each pivot, with the pivot's rank.
A query walks the files of its own nearest pivots and adds up the footrule
distance (pivots beyond the first ``prefix`` count as rank ``prefix``); the
nearest by footrule are reranked by the exact distance on the original vectors.

Equal vectors: a query's k nearest hold at most k + 1 of them, those with the
smallest ids, so that many of each distinct vector are indexed and the result
is that of indexing all.

Queries are fetched and sent in blocks of at most ``block`` vectors, one pass
over the index a block: what is broadcast is bounded whatever the input.

Defined results: vectors that are null, empty, zero or with null or non-finite
components take no part, nor do rows without an id; vectors of different
dimensions have no distance, so each dimension is searched by itself, with
pivots of its own; rows that repeat id and vector count once; fewer than k
candidates give all of them; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netweave.session import cut, shared_path

PIVOTS, PREFIX, RERANK, BLOCK, SHARD = 256, 64, 0.2, 8192, 4096
#: A shard reranks at least this many.
LEAST = 200


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, vectors as doubles."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    return rows


def few_of_each(rows: DataFrame, most: int) -> DataFrame:
    """The rows with the ``most`` smallest ids of each distinct vector, in two
    steps so that a vector that many rows share is not in one task."""
    keyed = rows.distinct().select("*", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"), F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt"))
    for key in (["k1", "k2", "salt"], ["k1", "k2"]):
        keyed = keyed.withColumn("nr", F.row_number().over(W.partitionBy(*key).orderBy("vec_id"))).filter(F.col("nr") <= most)
    return keyed.drop("nr", "salt", "k2")


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    distance = (pivots * pivots).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(distance, axis=1, kind="stable")[:, :prefix]


class Shard:
    """Inverted files of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.ids, self.vectors, self.prefix = ids, vectors, min(prefix, len(pivots))
        order = permutations(vectors, pivots, self.prefix)
        rows, ranks = np.divmod(np.arange(order.size), self.prefix)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.rows, self.ranks = rows[by_pivot], ranks[by_pivot]
        self.begins = np.concatenate(([0], np.cumsum(np.bincount(order.ravel(), minlength=len(pivots)))))

    def footrule(self, nearest: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector to a query's permutation, less a
        constant: a shared pivot of ranks i and j saves 2 (prefix - max(i, j))
        against one that only either has."""
        files = [slice(self.begins[p], self.begins[p + 1]) for p in nearest]
        rows = np.concatenate([self.rows[f] for f in files])
        saved = np.concatenate([self.prefix - np.maximum(self.ranks[f], i) for i, f in enumerate(files)])
        return -2.0 * np.bincount(rows, saved, minlength=len(self.ids))

    def search(self, query_id: int, query: np.ndarray, nearest: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact distances of the k nearest found."""
        most = min(len(self.ids), max(LEAST, k + 1, int(share * len(self.ids))))
        far = self.footrule(nearest)
        chosen = np.argpartition(far, most - 1)[:most] if most < len(far) else np.arange(len(far))
        chosen = chosen[self.ids[chosen] != query_id]
        apart = self.vectors[chosen] - query
        distance = np.sqrt((apart * apart).sum(1))
        first = np.lexsort((self.ids[chosen], distance))[:k]
        return self.ids[chosen][first], distance[first]


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of vectors, for each dimension where they are and their matrix."""
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def search(df: DataFrame, id_col: str, vector_col: str, every: int = 100, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose
    id is divisible by ``every``, among all other rows.

    pivots: how many vectors, the first by hash, are pivots; rerank: the share
    of a shard whose exact distances are taken. Rows that share an id are one
    query or candidate, with the smallest distance between any two of theirs.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    indexed = cut(few_of_each(rows, k + 1))
    first = W.partitionBy(F.size("vector")).orderBy("k1")
    chosen = indexed.groupBy("k1").agg(F.first("vector").alias("vector")).withColumn("nr", F.row_number().over(first)).filter(F.col("nr") <= pivots).orderBy("k1").collect()
    out, results = "query_id long, vec_id long, score double", "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], results)
    sizes = {len(row["vector"]) for row in chosen}
    points = spark.sparkContext.broadcast({n: np.array([row["vector"] for row in chosen if len(row["vector"]) == n]) for n in sizes})
    parts = max(1, -(-indexed.count() // shard))
    index = indexed.select("vec_id", "vector", "k1").repartition(parts, "k1").sortWithinPartitions(F.size("vector"), "k1").select("vec_id", "vector")
    index_path, found_path = shared_path(spark, "index"), shared_path(spark, "found")
    index.write.parquet(index_path)
    index = spark.read.schema("vec_id long, vector array<double>").parquet(index_path)
    queries = cut(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).distinct()).toLocalIterator()
    blocks = 0
    while part := list(islice(queries, block)):
        by_size: dict[int, tuple[list, list]] = {}
        for q in part:
            held = by_size.setdefault(len(q["vector"]), ([], []))
            held[0].append(q["vec_id"])
            held[1].append(q["vector"])
        sent = spark.sparkContext.broadcast({n: (np.array(ids), np.array(vectors)) for n, (ids, vectors) in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            nearest = {n: permutations(vectors, points.value[n], prefix) for n, (_, vectors) in sent.value.items()}
            for batch in batches:
                for at, matrix in _by_dimension(batch.column(1)):
                    n = matrix.shape[1]
                    if n not in nearest:
                        continue
                    ids, vectors = sent.value[n]
                    files = Shard(batch.column(0).to_numpy()[at], matrix, points.value[n], prefix)
                    hits = [files.search(i, v, p, k, rerank) for i, v, p in zip(ids, vectors, nearest[n], strict=True)]
                    found = [len(h[0]) for h in hits]
                    columns = (np.repeat(ids, found), np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        best = W.partitionBy("query_id").orderBy("score", "vec_id")
        found = index.mapInArrow(run, out).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        blocks += 1
        found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(found_path)
    return spark.read.schema(results).parquet(found_path) if blocks else spark.createDataFrame([], results)
