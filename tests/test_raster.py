"""Rasters in tiles against the flat table and plain loops."""

import math
import random
from pathlib import Path

import pytest

from netweave.sources import layers, raster

FLAT = "row int, col int, z double"
SHAPES = "geom_type string, parts array<array<struct<x:double,y:double>>>"
GRID = raster.Grid(100.0, 500.0, 10.0, 5.0, 8)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_round_trip(spark, tmp_path):
    """Negative cells, no data, repeated cells, rows without a place."""
    flat = {(r, c): float(r * 100 + c) for r in range(-9, 20) for c in range(-3, 30) if (r + c) % 3}
    rows = [(r, c, z) for (r, c), z in flat.items()] + [(0, 1, 7e9), (40, 40, None), (41, 41, float("nan")), (42, 42, float("inf")), (None, 1, 1.0), (1, None, 1.0)]
    path = str(tmp_path / "tiles")
    raster.write_tiles(spark.createDataFrame(rows, FLAT), path, GRID)
    assert rows_of(raster.read_tiles(spark, path, GRID)) == sorted((r, c, z) for (r, c), z in flat.items())
    found = raster.tiles(spark, path, GRID).filter("tile_row = -2 AND tile_col = -1").first()
    inside = [z for (r, c), z in flat.items() if r // 8 == -2 and c // 8 == -1]
    assert (found.n, found.low, found.high) == (len(inside), min(inside), max(inside))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "tiles")
    raster.write_tiles(spark.createDataFrame([], FLAT), path, GRID)
    assert raster.read_tiles(spark, path, GRID, (0.0, 0.0, 1.0, 1.0)).count() == 0
    assert raster.prepare(spark.createDataFrame([], SHAPES), path, GRID, 5.0).count() == 0
    with pytest.raises(ValueError):
        raster.sample_tiles(spark.createDataFrame([(1, float("nan"), None)], "id long, x double, y double"), path, GRID, "id")


def test_reads_only_touched_tiles(spark, tmp_path):
    """A box is read although the files of all other rows of tiles are broken."""
    path = tmp_path / "tiles"
    flat = [(r, c, float(r * c)) for r in range(40) for c in range(40)]
    raster.write_tiles(spark.createDataFrame(flat, FLAT), str(path), GRID)
    broken = [f for d in path.glob("tile_row=*") if d.name != "tile_row=1" for f in d.glob("*.parquet")]
    for file in broken:
        Path(file).write_bytes(b"no table")
        Path(file).with_name(f".{file.name}.crc").unlink()
    box = (135.0, 500.0 - 5 * 15.5, 205.0, 500.0 - 5 * 8.5)
    assert broken
    assert rows_of(raster.read_tiles(spark, str(path), GRID, box)) == sorted((r, c, z) for r, c, z in flat if 8 <= r <= 15 and 3 <= c <= 10)
    plan = raster.read_tiles(spark, str(path), GRID, box)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(tile_col,0)" in plan and "tile_row" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_sample_equals_flat(spark, tmp_path):
    draw = random.Random(3)
    cells = spark.createDataFrame([(r, c, float(draw.randrange(100))) for r in range(30) for c in range(30) if draw.random() < 0.8], FLAT)
    points = spark.createDataFrame([(i, draw.uniform(90, 410), draw.uniform(340, 510)) for i in range(200)], "id long, x double, y double")
    path = str(tmp_path / "tiles")
    raster.write_tiles(cells, path, GRID)
    for fill in ("idw", "mean", "constant"):
        want = layers.sample_raster(points, cells, "id", (100.0, 500.0), (10.0, 5.0), fill, 3.0, 1.5)
        got = raster.sample_tiles(points, path, GRID, "id", fill, 3.0, 1.5)
        assert [(i, pytest.approx(z), f) for i, z, f in rows_of(want)] == rows_of(got)


@pytest.mark.parametrize("buffer", [0.0, 13.0])
def test_prepare(spark, tmp_path, buffer):
    """Two polygons, one with a hole, against distances to all edges."""
    shapes = [("Polygon", [[(140.0, 400.0), (240.0, 410.0), (230.0, 480.0), (150.0, 470.0)], [(170.0, 425.0), (210.0, 425.0), (210.0, 455.0), (170.0, 455.0)]]), ("MultiPolygon", [[(300.0, 390.0), (340.0, 392.0), (322.0, 430.0)]]), ("Point", [[(120.0, 490.0)]])]
    path = str(tmp_path / "tiles")
    raster.write_tiles(spark.createDataFrame([(r, c, float(r + c)) for r in range(40) for c in range(40)], FLAT), path, GRID)
    rings = [ring for kind, parts in shapes if "olygon" in kind for ring in parts]

    def kept(x, y):
        odd, near = 0, math.inf
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                odd += (y < ay) != (y < by) and x < (bx - ax) * (y - ay) / (by - ay) + ax
                t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                near = min(near, math.dist((x, y), (ax + t * (bx - ax), ay + t * (by - ay))))
        return odd % 2 == 1 or near <= buffer

    want = sorted((r, c, float(r + c)) for r in range(40) for c in range(40) if kept(105.0 + 10 * c, 497.5 - 5 * r))
    assert rows_of(raster.prepare(spark.createDataFrame(shapes, SHAPES), path, GRID, buffer)) == want
