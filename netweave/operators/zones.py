"""Zones by k-means, and their polygons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators import outline, overlay


def kmeans_zones(points: DataFrame, columns: Sequence[str], k: int = 5, seed: int = 42, starts: int = 5, name: str = "cluster") -> tuple[DataFrame, list[list[float]]]:
    """The points with a zone from 1, and the centres; of several starts that
    with the least cost. Fewer distinct points than k raise."""
    if points.select(*columns).distinct().limit(k).count() < k:
        raise ValueError(f"fewer than {k} distinct points")
    kept = points.columns
    assembled = VectorAssembler(inputCols=list(columns), outputCol="__v").transform(points)
    vectors = assembled.select("__v").cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="__z", maxIter=60, tol=1e-6).fit(vectors) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    vectors.unpersist()
    return best.transform(assembled).select(*kept, (F.col("__z") + 1).alias(name)), [c.tolist() for c in best.clusterCenters()]


def zone_polygons(centres: DataFrame, ground: DataFrame) -> DataFrame:
    """(cluster, parts, area): of the ground, an area of plane 0, what is nearest
    to each centre (cluster, x, y), as rings."""
    return overlay.shapes(outline.thiessen(centres, "cluster", ground)).withColumnRenamed("plane", "cluster")
