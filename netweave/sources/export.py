"""What is written: GeoJSON, EPANET input text, CSV, JSON summaries, tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions import geometry


def tidy(df: DataFrame, keep: Sequence[str]) -> list[Column]:
    """Those of the columns that there are: fractions to 4 digits, flags as 0
    and 1."""
    out = []
    for c in keep:
        if c in df.columns:
            kind = df.schema[c].dataType.simpleString()
            out.append((F.round(F.col(c), 4) if kind in ("double", "float") else F.col(c).cast("int") if kind == "boolean" else F.col(c)).alias(c))
    return out


def geojson_points(df: DataFrame, keep: Sequence[str], lon: Column, lat: Column) -> DataFrame:
    """(feature): a GeoJSON point a row, places to 6 digits."""
    place = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*tidy(df, keep)).alias("properties"), place.alias("geometry"))).alias("feature"))


def geojson_shapes(df: DataFrame, keep: Sequence[str], parts: Column, kind: str) -> DataFrame:
    """(feature): a GeoJSON line (``LineString``: the first of parts) or polygon
    (``Polygon``: rings, closed where they are not) a row, of arrays of points
    x, y in degrees; places to 6 digits."""
    pairs = lambda line: F.transform(line, lambda p: F.array(F.round(p.x, 6), F.round(p.y, 6)))
    closed = lambda ring: F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    shape = pairs(F.element_at(parts, 1)) if kind == "LineString" else F.transform(parts, lambda ring: pairs(closed(ring)))
    geometry_ = F.struct(F.lit(kind).alias("type"), shape.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*tidy(df, keep)).alias("properties"), geometry_.alias("geometry"))).alias("feature"))


def control_points_yaml(points: Sequence[tuple[float, float, float, float]]) -> str:
    """The settings of a registration by control points (drawing x, y, world x, y)."""
    head = ["georeference:", "  mode: control_points", "  allow_rotation: false", "  allow_scale: false", "  control_points:"]
    return "\n".join(head + [line for x, y, e, n in points for line in (f"    - cad:   [{x:.1f}, {y:.1f}]", f"      world: [{e:.2f}, {n:.2f}]")]) + "\n"


def geojson_utm(df: DataFrame, keep: Sequence[str], zone: int, south: bool = False) -> DataFrame:
    """As geojson_points, from x and y in a UTM zone."""
    return geojson_points(df, keep, *geometry.from_utm(F.col("x"), F.col("y"), zone, south))


def write_geojson(features: DataFrame, path: str) -> None:
    """One feature a line (GeoJSON text sequence without marks)."""
    features.select("feature").write.text(path)


def inp_lines(nodes: DataFrame, pipes: DataFrame, source: DataFrame, peak: float, head: float) -> DataFrame:
    """(section, nr, line): an EPANET input file, in order of section and nr.
    nodes: node_id, elevation_m, demand_lps, x, y; pipes: link_id, node1, node2,
    length_m, diameter_mm, roughness; source: node_id, one row."""
    text = lambda name: F.format_string("%s", F.col(name).cast("string"))
    row = lambda df, section, nr, *parts: df.select(F.lit(section).alias("section"), nr.cast("long").alias("nr"), F.concat_ws("\t", *parts).alias("line"))
    number = lambda c, digits: F.col(c).cast(f"decimal(28,{digits})").cast("string")
    order = ("JUNCTIONS", "RESERVOIRS", "PIPES", "PATTERNS", "TIMES", "OPTIONS", "COORDINATES", "END")
    spark = nodes.sparkSession
    fixed = [("JUNCTIONS", -1, "[JUNCTIONS]"), ("RESERVOIRS", -1, "[RESERVOIRS]"), ("RESERVOIRS", 0, f"R1\t{head:.4f}"), ("PIPES", -1, "[PIPES]"), ("PATTERNS", -1, "[PATTERNS]"), ("PATTERNS", 0, f"PEAK\t{peak:g}"), ("TIMES", -1, "[TIMES]"), ("TIMES", 0, "DURATION\t0"), ("OPTIONS", -1, "[OPTIONS]"), ("OPTIONS", 0, "UNITS\tLPS"), ("OPTIONS", 1, "HEADLOSS\tH-W"), ("OPTIONS", 2, "ACCURACY\t0.001"), ("COORDINATES", -1, "[COORDINATES]"), ("END", 0, "[END]")]
    out = spark.createDataFrame(fixed, "section string, nr long, line string")
    out = out.union(row(nodes, "JUNCTIONS", F.col("node_id"), F.concat(F.lit("J"), text("node_id")), number("elevation_m", 4), number("demand_lps", 6), F.lit("PEAK")))
    out = out.union(row(pipes, "PIPES", F.col("link_id"), F.concat(F.lit("P"), text("link_id")), F.concat(F.lit("J"), text("node1")), F.concat(F.lit("J"), text("node2")), number("length_m", 3), number("diameter_mm", 2), number("roughness", 1), F.lit("0"), F.lit("OPEN")))
    out = out.union(row(source.limit(1), "PIPES", F.lit(1 << 62), F.lit("P_SRC\tR1"), F.concat(F.lit("J"), text("node_id")), F.lit("25\t300\t130\t0\tOPEN")))
    out = out.union(row(nodes, "COORDINATES", F.col("node_id"), F.concat(F.lit("J"), text("node_id")), number("x", 3), number("y", 3)))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("section"))
    return out.withColumn("place", rank)


def write_inp(lines: DataFrame, path: str) -> None:
    """The lines as text files in order."""
    lines.orderBy("place", "nr").select("line").write.text(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    (df.orderBy(*order) if order else df).write.csv(path, header=True)


def write_tables(layers: dict[str, DataFrame], path: str) -> None:
    """A Parquet table for each layer."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def summary_json(row: DataFrame) -> DataFrame:
    """(json): a one-row frame as a document."""
    return row.select(F.to_json(F.struct("*")).alias("json"))
