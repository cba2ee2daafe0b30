"""Drawing layers: which to read, and reading lines and texts from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that tell what a layer holds.
PIPE_HINTS = ("water", "supply", "pipe", "main", "wdn", "distribution", "line")
PIPE_VETO = ("text", "label", "annot", "dia text", "meter", "hydrant", "fh", "valve", "symbol", "block", "legend", "note")
LABEL_HINTS = ("text", "dia", "label", "annot", "size")
EXCLUDED = ("building", "road", "contour", "tree", "boundary", "grid", "hatch", "dim", "titleblock", "border")
TEXT_COLUMNS = ("text", "Text", "TEXT", "label", "Contents")

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINES = T.StructType([T.StructField("layer", T.StringType()), T.StructField("geom_type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(POINT)))])


def score(name: Column, hints: Sequence[str], veto: Sequence[str] = EXCLUDED) -> Column:
    """How many hints a name holds; -1 if it holds a vetoed word."""
    low = F.lower(name)
    count = sum((F.when(low.contains(h), 1).otherwise(0) for h in hints), F.lit(0))
    vetoed = F.lit(False)
    for word in veto:
        vetoed = vetoed | low.contains(word)
    return F.when(vetoed, -1).otherwise(count)


def list_layers(features: DataFrame) -> DataFrame:
    return features.select("layer").distinct()


def pick_layers(features: DataFrame, want: str = "pipe", named: Sequence[str] | None = None) -> DataFrame:
    """(layer): those named, else those whose score is above 0; for pipes, if
    there is none, the layer with most lines (ties by name)."""
    layers = list_layers(features)
    if named:
        return layers.filter(F.col("layer").isin(*named))
    hints, veto = (PIPE_HINTS, PIPE_VETO + EXCLUDED) if want == "pipe" else (LABEL_HINTS, EXCLUDED)
    chosen = layers.filter(score(F.col("layer"), hints, veto) > 0)
    if want != "pipe":
        return chosen
    most = features.filter(F.lower("geom_type").contains("line")).groupBy("layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer").limit(1)
    found = chosen.agg(F.count("*").alias("found"))
    return chosen.union(most.crossJoin(found).filter("found = 0").select("layer"))  # one row each


def read_lines(features: DataFrame, extent: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(layer, points): the parts of lines with two points or more, all of them
    inside the extent where one is given."""
    lines = features.filter("parts IS NOT NULL AND lower(geom_type) LIKE '%line%'").select("layer", F.explode("parts").alias("points")).filter("size(points) >= 2")
    if extent:
        xs, ys = F.transform("points", lambda p: p.x), F.transform("points", lambda p: p.y)
        lines = lines.filter((F.array_min(xs) >= extent[0]) & (F.array_min(ys) >= extent[1]) & (F.array_max(xs) <= extent[2]) & (F.array_max(ys) <= extent[3]))
    return lines


def read_texts(features: DataFrame) -> DataFrame:
    """(layer, raw, x, y): the first text column that has one, at the middle of
    the feature's points; without points the place is null."""
    known = [c for c in TEXT_COLUMNS if c in features.columns]
    points = F.flatten("parts")
    middle = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]) / F.nullif(F.size(points), F.lit(0))
    return features.select("layer", F.coalesce(*known).alias("raw") if known else F.lit(None).cast("string").alias("raw"), middle("x").alias("x"), middle("y").alias("y")).filter("raw IS NOT NULL")


def read_geojson(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """A row for each feature: its properties, geom_type and rings or lines as
    ``parts``; points are one part of one point."""
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
    feature = T.StructType([T.StructField("properties", properties), T.StructField("geometry", geometry)])
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    found = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("c"))
    pairs = lambda depth: F.from_json("c", "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    parts = (
        F.when(F.col("geom_type") == "Point", F.array(F.array(point(pairs(0)))))
        .when(F.col("geom_type").isin("LineString", "MultiPoint"), F.array(F.transform(pairs(1), point)))
        .when(F.col("geom_type").isin("Polygon", "MultiLineString"), F.transform(pairs(2), lambda ring: F.transform(ring, point)))
        .when(F.col("geom_type") == "MultiPolygon", F.flatten(F.transform(pairs(3), lambda poly: F.transform(poly, lambda ring: F.transform(ring, point)))))
    )
    return found.withColumn("parts", parts).drop("c")


def sample_raster(points: DataFrame, raster: DataFrame, key: str, origin: tuple[float, float], step: tuple[float, float], fill: str = "idw", constant: float = 0.0, offset: float = 0.0) -> DataFrame:
    """(key, z, filled): the value of the raster cell (row, col, z; null is no
    data) under each point, from the north-west corner. Points without one are
    filled by ``idw`` (six nearest), ``mean`` or ``constant``. Raises if no
    point has a value."""
    from netweave.operators.spatial import inverse_distance_mean, k_nearest

    col, row = F.floor((F.col("x") - origin[0]) / step[0]), F.floor((origin[1] - F.col("y")) / step[1])
    placed = points.select(F.col(key).alias("id"), "x", "y", col.cast("int").alias("col"), row.cast("int").alias("row"))
    found = placed.join(raster.select("row", "col", F.col("z").cast("double").alias("z")), ["row", "col"], "left").select("id", "x", "y", "z")
    known = found.filter("z IS NOT NULL AND NOT isnan(z)")
    if not known.take(1):
        raise ValueError("the raster covers none of the points")
    missing = found.join(known.select("id"), "id", "left_anti")
    if fill == "idw":
        near = k_nearest(missing, known, "id", "id", 6)
        filled = inverse_distance_mean(near, known, "id", "z").select(F.col("query").alias("id"), F.col("mean").alias("z"))
    elif fill == "mean":
        filled = missing.select("id").crossJoin(known.agg(F.avg("z").alias("z")))  # one row
    else:
        filled = missing.select("id", F.lit(float(constant)).alias("z"))
    return known.select(F.col("id").alias(key), (F.col("z") + offset).alias("z"), F.lit(False).alias("filled")).union(filled.select("id", F.col("z") + offset, F.lit(True)))


def clip_raster(raster: DataFrame, ring: list[tuple[float, float]], origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """The cells whose centre is inside a ring."""
    from netweave.operators.spatial import in_polygon

    x, y = origin[0] + (F.col("col") + 0.5) * step[0], origin[1] - (F.col("row") + 0.5) * step[1]
    return raster.filter(in_polygon(x, y, ring))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a given schema; only empty fields are null,
    so words like ``None`` stay words."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="")
