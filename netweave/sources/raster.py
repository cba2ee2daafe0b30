"""Rasters in tiles, and what is cut out of them for an area.

A raster is rows of (row, col, z) on a grid; cells without data are absent. On
disk a row is a tile: its cells that have data, in order. Tiles are in folders by
their row and sorted by column within, so that a box is read from the folders
and row groups that it touches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators import overlay
from netweave.session import cut
from netweave.sources.boundary import load_boundary
from netweave.sources.layers import sample_raster

TILES = "tile_col int, n int, low double, high double, cells array<struct<at:int,z:double>>, tile_row int"
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Grid:
    """Cells from a north-west corner: their width and height, and how many a
    tile has along a side."""

    west: float
    north: float
    width: float
    height: float
    side: int = 256

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of the cell that holds a point."""
        return F.floor((F.lit(self.north) - y) / self.height).cast("int"), F.floor((x - self.west) / self.width).cast("int")

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return self.west + (col + 0.5) * self.width, self.north - (row + 0.5) * self.height

    def span(self, box: Box) -> tuple[int, int, int, int]:
        """First and last row, first and last column of a box (west, south, east, north)."""
        rows = [math.floor((self.north - y) / self.height) for y in (box[3], box[1])]
        cols = [math.floor((x - self.west) / self.width) for x in (box[0], box[2])]
        return *rows, *cols


def _tile(cell: Column, side: int) -> Column:
    return F.floor(cell / side).cast("int")


def write_tiles(raster: DataFrame, path: str, grid: Grid) -> None:
    """Null and infinite values and NaN are no data; of a cell that is there
    more than once the smallest value counts. Cells without a place vanish."""
    z = F.col("z").cast("double")
    known = raster.filter(F.col("row").isNotNull() & F.col("col").isNotNull() & z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")))
    once = known.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.min(z).alias("z"))
    at = F.pmod("row", F.lit(grid.side)) * grid.side + F.pmod("col", F.lit(grid.side))
    placed = once.select(_tile(F.col("row"), grid.side).alias("tile_row"), _tile(F.col("col"), grid.side).alias("tile_col"), F.struct(at.cast("int").alias("at"), "z").alias("cell"))
    tiles = placed.groupBy("tile_row", "tile_col").agg(F.count("*").cast("int").alias("n"), F.min("cell.z").alias("low"), F.max("cell.z").alias("high"), F.array_sort(F.collect_list("cell")).alias("cells"))  # side x side cells at most
    tiles.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").write.partitionBy("tile_row").option("compression", "zstd").parquet(path)


def tiles(spark: SparkSession, path: str, grid: Grid, box: Box | None = None) -> DataFrame:
    """The tiles that a box touches, or all."""
    found = spark.read.schema(TILES).parquet(path)
    if box is None:
        return found
    top, bottom, left, right = (math.floor(c / grid.side) for c in grid.span(box))
    return found.filter(F.col("tile_row").between(top, bottom) & F.col("tile_col").between(left, right))


def read_tiles(spark: SparkSession, path: str, grid: Grid, box: Box | None = None) -> DataFrame:
    """(row, col, z): the cells that a box touches, or all."""
    cells = tiles(spark, path, grid, box).select("tile_row", "tile_col", F.explode("cells").alias("c"))
    row, col = (F.col(t) * grid.side + p for t, p in (("tile_row", F.floor(F.col("c.at") / grid.side)), ("tile_col", F.col("c.at") % grid.side)))
    found = cells.select(row.cast("int").alias("row"), col.cast("int").alias("col"), F.col("c.z").alias("z"))
    if box is None:
        return found
    top, bottom, left, right = grid.span(box)
    return found.filter(F.col("row").between(top, bottom) & F.col("col").between(left, right))


def _box(df: DataFrame, xs: tuple[str, ...], ys: tuple[str, ...]) -> Box | None:
    """The box of a frame's finite coordinates; none if there are none."""
    ends = []
    for columns in (xs, ys):
        places = F.array(*[F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns])
        ends.append((F.min(F.array_min(places)), F.max(F.array_max(places))))
    (west, east), (south, north) = ends
    found = tuple(df.agg(west, south, east, north).first())
    return None if None in found else found


def sample_tiles(points: DataFrame, path: str, grid: Grid, key: str, fill: str = "idw", constant: float = 0.0, offset: float = 0.0) -> DataFrame:
    """``sample_raster`` from tiles: only those in the points' box are read.
    Raises if no point has a value."""
    box = _box(points, ("x",), ("y",))
    if box is None:
        raise ValueError("the raster covers none of the points")
    raster = read_tiles(points.sparkSession, path, grid, box)
    return sample_raster(points, raster, key, (grid.west, grid.north), (grid.width, grid.height), fill, constant, offset)


def prepare(features: DataFrame, path: str, grid: Grid, buffer: float = 0.0, zone: int | None = None, south: bool = False) -> DataFrame:
    """(row, col, z): the cells of a raster in tiles whose centre lies in the
    polygons of features (see ``load_boundary``) or within the buffer around them;
    the raster is cropped to their box first. Without polygons there are none."""
    area = cut(load_boundary(features, zone, south, buffer))
    spark = features.sparkSession
    box = _box(area, ("ax", "bx"), ("ay", "by"))
    if box is None:
        return read_tiles(spark, path, grid).limit(0)
    cells = read_tiles(spark, path, grid, box)
    x, y = grid.centre(F.col("row"), F.col("col"))
    number = F.col("row").cast("long") * (1 << 32) + F.col("col")
    centres = cells.select(F.lit(0).cast("long").alias("plane"), number.alias("id"), x.alias("x"), y.alias("y"), "row", "col", "z")
    return overlay.covered(centres, area, overlay.cell_size(area)).select("row", "col", "z")
