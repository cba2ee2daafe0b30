"""A service boundary: polygons read, reprojected and dissolved into one area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.geometry import to_utm
from netweave.operators import overlay
from netweave.operators.demand import segment_distance
from netweave.operators.spatial import finite, on_or_in
from netweave.session import cut

#: Vertices of a boundary that is a literal of the expressions that test it.
MOST = 20_000


def load_boundary(features: DataFrame, zone: int | None = None, south: bool = False, buffer: float = 0.0) -> DataFrame:
    """The ground that the polygons of (geom_type, parts) cover, such as
    read_geojson gives, as one area (see ``overlay``) of plane 0; with a zone from
    degrees to metres, with a buffer so much wider. Within a feature rings are holes
    and islands by the even-odd rule; where features overlap the ground counts once."""
    polygons = features.filter("parts IS NOT NULL AND lower(geom_type) LIKE '%polygon'").select("parts")
    if zone is not None:
        placed = lambda p: F.struct(*[c.alias(k) for c, k in zip(to_utm(p.x, p.y, zone, south), "xy", strict=True)])
        polygons = polygons.select(F.transform("parts", lambda ring: F.transform(ring, placed)).alias("parts"))
    numbered = cut(polygons.withColumn("feature", F.monotonically_increasing_id()))
    edges = cut(overlay.edges_of(numbered, "feature").filter(finite("ax", "ay", "bx", "by")))
    size = overlay.cell_size(edges)
    whole = overlay.dissolve(overlay.even_odd(edges, size).withColumn("plane", F.lit(0).cast("long")), size)
    return overlay.buffered(whole, buffer) if buffer > 0 else whole


def rings(boundary: DataFrame) -> list[list[tuple[float, float]]]:
    """The rings of a boundary, for ``covers``. Raises for more than MOST vertices;
    ``overlay.covered`` tests points against any number."""
    boundary = cut(boundary)
    if boundary.count() > MOST:
        raise ValueError(f"the boundary has more than {MOST} vertices: use overlay.covered")
    return [[(p["x"], p["y"]) for p in row["points"]] for row in overlay.outlines(boundary).collect()]


def covers(x: Column, y: Column, rings: list[list[tuple[float, float]]], buffer: float = 0.0) -> Column:
    """Inside an odd number of the rings, so that holes are outside and edges
    too; or with a buffer at most that far from an edge as well."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for ring in rings:
        odd, edge = on_or_in(x, y, ring)
        crossings, on_edge = crossings + odd, on_edge | edge
    inside = (crossings % 2 == 1) & ~on_edge
    if buffer > 0:
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                inside = inside | (segment_distance(x, y, F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by)) <= buffer)
    return inside
