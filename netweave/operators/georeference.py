"""Placing a drawing on the ground: dispatch and registration by overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions import geometry

Ring = list[tuple[float, float]]


def mask(ring: Ring, box: tuple[float, float, float, float], step: float) -> np.ndarray:
    """Cells of a box whose centre is inside a ring (even-odd)."""
    xs, ys = np.arange(box[0] + step / 2, box[2], step), np.arange(box[1] + step / 2, box[3], step)
    inside = np.zeros((len(ys), len(xs)), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay != by:
            rows = (ys < ay) != (ys < by)
            inside[rows] ^= xs[None, :] < ((bx - ax) * (ys[rows] - ay) / (by - ay) + ax)[:, None]
    return inside


def overlap(a: Ring, b: Ring, cells: int = 160) -> float:
    """Intersection over union on a grid of about cells x cells."""
    x, y = [p[0] for p in a + b], [p[1] for p in a + b]
    box = (min(x), min(y), max(x), max(y))
    step = max(box[2] - box[0], box[3] - box[1]) / cells or 1.0
    one, other = mask(a, box, step), mask(b, box, step)
    union = (one | other).sum()
    return float((one & other).sum() / union) if union else 0.0


def _moved(ring: Ring, dx: float, dy: float, theta: float) -> Ring:
    cx, cy = sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    c, s = math.cos(theta), math.sin(theta)
    return [(cx + c * (x - cx) - s * (y - cy) + dx, cy + s * (x - cx) + c * (y - cy) + dy) for x, y in ring]


def _best(spark, outline: Ring, boundary: Ring, centre: tuple[float, float, float], reach: tuple[float, float], step: tuple[float, float]) -> tuple:
    """The candidate of a grid around a placement with most overlap."""
    n, m = int(2 * reach[0] / step[0]) + 1, int(2 * reach[1] / step[1]) + 1 if reach[1] else 1
    at = lambda i, k, size, middle: middle - reach[k] + i * step[k] if size > 1 else F.lit(float(middle))
    i = F.col("id")
    candidates = spark.range(n * n * m).select(at(i % n, 0, n, centre[0]).alias("dx"), at(F.floor(i / n) % n, 0, n, centre[1]).alias("dy"), at(F.floor(i / (n * n)), 1, m, centre[2]).alias("theta"))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for dx, dy, theta in parts:
            yield pd.Series([overlap(_moved(outline, *p), boundary) for p in zip(dx, dy, theta, strict=True)])

    row = candidates.withColumn("iou", score("dx", "dy", "theta")).orderBy(F.desc("iou"), F.abs(F.col("dx") - centre[0]) + F.abs(F.col("dy") - centre[1]), "dx", "dy", "theta").first()
    return row["dx"], row["dy"], row["theta"], row["iou"]


def register(spark, outline: Ring, boundary: Ring, reach: float = 600.0, step: float = 40.0, turn_deg: float = 0.0, turn_step_deg: float = 1.0, finest: float = 0.25) -> dict:
    """The shift (and turn) that lays an outline over a boundary best: from
    centre on centre, a grid of candidates scored in parallel, then ever finer
    grids around the best. With the overlap at offsets of 25, 50 and 100 m (mean
    of four directions) and the contrast that tells a sharp fit from a flat one.
    """
    mean = lambda ring: (sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring))
    (ox, oy), (bx, by) = mean(outline), mean(boundary)
    best = (bx - ox, by - oy, 0.0, overlap(outline, boundary))
    first = overlap(_moved(outline, *best[:3]), boundary)
    turn, turn_step = math.radians(turn_deg), math.radians(turn_step_deg)
    while True:
        best = _best(spark, outline, boundary, best[:3], (reach, turn), (step, turn_step))
        if step <= finest:
            break
        reach, step, turn, turn_step = step, max(step / 5, finest), turn_step if turn else 0.0, turn_step / 5
    around = {d: sum(overlap(_moved(outline, best[0] + i * d, best[1] + j * d, best[2]), boundary) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))) / 4 for d in (25, 50, 100)}
    return {"dx": best[0], "dy": best[1], "theta": best[2], "iou": best[3], "iou_centred": first, "iou_at": around, "contrast": best[3] - around[100]}


def georeference(points: DataFrame, mode: str, **how) -> DataFrame:
    """points (x, y) by ``identity``, ``control_points`` (pairs), ``auto_register``
    (outline, boundary) or ``fit_to_boundary`` (box); other modes raise."""
    if mode == "identity":
        return points
    if mode == "control_points":
        m = geometry.similarity_fit(how["pairs"], how.get("rotate", True), how.get("scale", True))["matrix"]
    elif mode == "auto_register":
        found = register(points.sparkSession, how["outline"], how["boundary"], **how.get("search", {}))
        cx, cy = (sum(p[k] for p in how["outline"]) / len(how["outline"]) for k in (0, 1))
        a, b, d, e, _, _ = geometry.matrix(0, 0, found["theta"])
        m = (a, b, d, e, cx + found["dx"] - a * cx - b * cy, cy + found["dy"] - d * cx - e * cy)
    elif mode == "fit_to_boundary":
        m = geometry.extent_fit(points, how["box"], how.get("scale", False))
    else:
        raise ValueError(f"no such georeference mode: {mode}")
    x, y = geometry.affine(*m, F.col("x"), F.col("y"))
    return points.withColumn("__x", x).withColumn("y", y).withColumn("x", F.col("__x")).drop("__x")
