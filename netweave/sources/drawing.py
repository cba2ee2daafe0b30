"""Drawings: ASCII exchange files of CAD programs as a Spark data source, and
shapes as well-known text.

    spark.dataSource.register(DrawingSource)
    spark.read.format("drawing").load(path)

A file is read in ranges of bytes, a task each. A task starts at the first entity
that begins in its range and ends with the last one, vertices included, so a
range needs nothing of the others. Which section and block its first entities
belong to stands in an earlier range: ``read_drawing`` fills that in from the
markers, of which there are few, and puts blocks where they are inserted.

Defined results: an entity without a coordinate that it needs, or with one that is
no number, is a row without parts and says why in ``problem``, as does one of a
kind that is not read; a group code that is no number ends its entity. Curves are
chords: circles and arcs of five degrees, bulges straight. A file without sections
holds entities. Blocks in blocks are followed ``NESTED`` deep; deeper ones, and
blocks that are not there, say so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netweave.session import cut

SCHEMA = (
    "file string, split int, place long, section string, block string, kind string, layer string, geom_type string, "
    "parts array<array<struct<x: double, y: double>>>, Text string, name string, scale_x double, scale_y double, turn double, problem string"
)
SPLIT, NESTED = 16 << 20, 8
_NAME = re.compile(r"[A-Z][A-Z0-9_]*$")
Pair = tuple[int, str]


def opened(path: str) -> tuple[FileSystem, str]:
    """The file system of a path, with or without a scheme, and the path in it."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


class Range(InputPartition):
    def __init__(self, file: str, split: int, begin: int, end: int):
        self.file, self.split, self.begin, self.end = file, split, begin, end


class DrawingSource(DataSource):
    """Options: ``split_bytes``, ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "drawing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return DrawingReader(self.options["path"], int(self.options.get("split_bytes", SPLIT)), self.options.get("encoding", "utf-8"))


class DrawingReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, encoding: str):
        self.path, self.split_bytes, self.encoding = path, max(1, split_bytes), encoding

    def partitions(self) -> list[Range]:
        files, inside = opened(self.path)
        info = files.get_file_info(inside)
        found = [info] if info.type == FileType.File else [f for f in files.get_file_info(FileSelector(inside, recursive=True)) if f.type == FileType.File and f.base_name[0] not in "._"]
        return [Range(f.path, i, at, min(f.size, at + self.split_bytes)) for f in sorted(found, key=lambda f: f.path) for i, at in enumerate(range(0, f.size, self.split_bytes))]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:  # there is no file, or only empty ones
            return
        files, _ = opened(self.path)
        with files.open_input_file(partition.file) as file:
            begin = max(0, partition.begin - 1)  # a line that begins with the range is its own
            file.seek(begin)
            lines = _lines(file, begin, partition.begin > 0, self.encoding)
            section = block = None
            for place, kind, pairs, inner, problem in _entities(lines, partition.end):
                if kind in ("SECTION", "ENDSEC", "BLOCK", "ENDBLK"):
                    name = _first(pairs, 2)
                    section, block = {"SECTION": (name or "", ""), "ENDSEC": ("", ""), "BLOCK": ("BLOCKS", name or ""), "ENDBLK": ("BLOCKS", "")}[kind]
                yield (partition.file, partition.split, place, section, block, kind, *_row(kind, pairs, inner, problem))


def _lines(file, at: int, inside: bool, encoding: str) -> Iterator[tuple[int, str]]:
    """(place, line); inside: the first line began before."""
    rest = b""
    while True:
        chunk = file.read(1 << 20)
        data = rest + chunk
        *whole, rest = data.split(b"\n")
        if not chunk and rest:
            whole, rest = [*whole, rest], b""
        for line in whole:
            if not inside:
                yield at, line.decode(encoding, "replace").rstrip("\r")
            inside, at = False, at + len(line) + 1
        if not chunk:
            return


def _entities(lines: Iterator[tuple[int, str]], end: int) -> Iterator[tuple[int, str, list[Pair], list[list[Pair]], str | None]]:
    """(place, kind, pairs, pairs of what belongs to it, problem) of the entities
    that begin before ``end``, from the first one on."""
    held: tuple | None = None
    ahead = next(lines, None)

    def finished() -> Iterator[tuple]:
        if held is not None and held[1] not in ("VERTEX", "SEQEND", "ATTRIB"):  # those of a range before
            yield held

    while ahead is not None:
        place, line = ahead
        ahead = next(lines, None)
        if line.strip() == "0" and ahead is not None and _NAME.match(ahead[1].strip()):
            kind = ahead[1].strip()
            ahead = next(lines, None)
            if held is not None and held[1] in ("POLYLINE", "INSERT") and kind in ("VERTEX", "ATTRIB", "SEQEND"):
                held[3].append([(0, kind)])
                continue
            yield from finished()
            held = None
            if place >= end or kind == "EOF":
                return
            held = (place, kind, [], [], None)
            continue
        if held is None:
            continue  # before the first entity of the range, or after a fault
        try:
            code = int(line)
        except ValueError:
            yield from finished() if held[4] else [(*held[:4], f"no group code: {line.strip()[:40]!r}")]
            held = None
            continue
        if ahead is None:
            break
        (held[3][-1] if held[3] else held[2]).append((code, ahead[1]))
        ahead = next(lines, None)
    yield from finished()


def _first(pairs: list[Pair], code: int) -> str | None:
    return next((v.strip() for c, v in pairs if c == code), None)


def _number(pairs: list[Pair], code: int, default: float | None = None) -> float:
    found = _first(pairs, code)
    if found is None:
        if default is None:
            raise ValueError(f"no value of group {code}")
        return default
    value = float(found)
    if not math.isfinite(value):
        raise ValueError(f"group {code} is not finite")
    return value


def _points(pairs: list[Pair]) -> list[tuple[float, float]]:
    xs, ys = [float(v) for c, v in pairs if c == 10], [float(v) for c, v in pairs if c == 20]
    if len(xs) != len(ys) or not all(map(math.isfinite, xs + ys)):
        raise ValueError("corners without a place")
    return list(zip(xs, ys, strict=True))


def _text(pairs: list[Pair]) -> str:
    """The text of TEXT, ATTRIB or MTEXT without its formatting."""
    text = "".join(v for c, v in pairs if c == 3) + "".join(v for c, v in pairs if c == 1)
    text = text.replace(r"\P", "\n").replace("%%c", "Ø").replace("%%d", "°").replace("%%p", "±")
    return re.sub(r"\\[A-Za-z][^;\\]*;|[{}]", "", text)


def _shape(kind: str, pairs: list[Pair], inner: list[list[Pair]]) -> tuple[str, list, str | None]:
    """(geom_type, parts, text)."""
    place = lambda: (_number(pairs, 10), _number(pairs, 20))
    if kind == "LINE":
        return "LineString", [[place(), (_number(pairs, 11), _number(pairs, 21))]], None
    if kind in ("LWPOLYLINE", "POLYLINE"):
        points = _points(pairs) if kind == "LWPOLYLINE" else [p for v in inner if v[0][1] == "VERTEX" for p in _points(v)]
        if len(points) < 2:
            raise ValueError("fewer than two corners")
        return "LineString", [points + points[:1] if int(_number(pairs, 70, 0)) & 1 else points], None
    if kind in ("CIRCLE", "ARC"):
        (x, y), radius = place(), _number(pairs, 40)
        start, stop = (_number(pairs, 50, 0), _number(pairs, 51, 360)) if kind == "ARC" else (0.0, 360.0)
        span = (stop - start) % 360 or 360.0
        steps = max(1, math.ceil(span / 5))
        angles = [math.radians(start + span * i / steps) for i in range(steps + 1)]
        return "LineString", [[(x + radius * math.cos(a), y + radius * math.sin(a)) for a in angles]], None
    if kind in ("TEXT", "MTEXT", "ATTRIB"):
        return "Point", [[place()]], _text(pairs)
    if kind in ("POINT", "INSERT", "BLOCK"):
        return "Point", [[place()]], None
    raise ValueError("not read")


def _row(kind: str, pairs: list[Pair], inner: list[list[Pair]], problem: str | None) -> tuple:
    layer, name = _first(pairs, 8), _first(pairs, 2)
    scale_x = scale_y = turn = text = geom = parts = None
    if kind in ("SECTION", "ENDSEC", "ENDBLK"):
        return layer, None, None, None, name, None, None, None, problem
    if problem is None:
        try:
            geom, parts, text = _shape(kind, pairs, inner)
            if kind == "INSERT":
                scale_x, scale_y, turn = _number(pairs, 41, 1), _number(pairs, 42, 1), _number(pairs, 50, 0)
                text = "\n".join(_text(v) for v in inner if v[0][1] == "ATTRIB") or None
        except ValueError as e:
            geom, parts, problem = None, None, f"{kind}: {e}"
    return layer, geom, parts, text, name, scale_x, scale_y, turn, problem


def read_drawing(spark: SparkSession, path: str, split_bytes: int = SPLIT, encoding: str = "utf-8") -> DataFrame:
    """(layer, kind, geom_type, parts, Text, problem): what is drawn, blocks in
    their places; the columns that ``layers`` reads lines and texts from."""
    spark.dataSource.register(DrawingSource)
    raw = cut(spark.read.format("drawing").option("split_bytes", split_bytes).option("encoding", encoding).load(path))
    # the section and block that a range begins in: those of the last marker before it
    ends = raw.filter("kind IN ('SECTION', 'ENDSEC', 'BLOCK', 'ENDBLK')").groupBy("file", "split").agg(F.max_by(F.struct("section", "block"), "place").alias("last"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    begun = raw.select("file", "split").distinct().join(ends, ["file", "split"], "left").select("file", "split", F.last("last", ignorenulls=True).over(before).alias("begun"))
    known = raw.join(begun, ["file", "split"]).withColumn("block", F.when(F.col("section").isNotNull(), F.col("block")).otherwise(F.coalesce("begun.block", F.lit(""))))
    known = known.withColumn("section", F.coalesce("section", "begun.section", F.lit("ENTITIES"))).filter("kind NOT IN ('SECTION', 'ENDSEC', 'ENDBLK')")
    blocks = known.filter("section = 'BLOCKS' AND kind = 'BLOCK'").select("file", F.col("name").alias("of"), F.coalesce(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))).alias("base")).dropDuplicates(["file", "of"])
    inner = known.filter("section = 'BLOCKS' AND kind <> 'BLOCK' AND block <> ''").join(blocks.withColumnRenamed("of", "block"), ["file", "block"]).select("file", F.col("block").alias("of"), "base", *[F.col(c).alias(f"i_{c}") for c in ("kind", "layer", "geom_type", "parts", "Text", "name", "scale_x", "scale_y", "turn", "problem")])
    inner = cut(inner)
    columns = ["file", "kind", "layer", "geom_type", "parts", "Text", "name", "scale_x", "scale_y", "turn", "problem"]
    drawn = cut(known.filter("section = 'ENTITIES'").select(*columns))
    named = cut(blocks.select("file", F.col("of").alias("name")))
    out = drawn.filter("kind <> 'INSERT'")
    left = drawn.filter("kind = 'INSERT'")
    for _ in range(NESTED):
        left = cut(left)
        if not left.take(1):
            break
        there = left.filter("parts IS NOT NULL").join(named, ["file", "name"], "left_semi")
        lost = left.join(named, ["file", "name"], "left_anti").filter("problem IS NULL").withColumn("problem", F.concat(F.lit("INSERT: no block "), F.coalesce("name", F.lit("?"))))
        out = out.unionByName(lost).unionByName(left.filter("parts IS NULL AND problem IS NOT NULL"))
        texts = there.filter("Text IS NOT NULL").withColumn("kind", F.lit("ATTRIB"))
        placed = cut(_inserted(there, inner).select(*columns))
        out = out.unionByName(texts).unionByName(placed.filter("kind <> 'INSERT'"))
        left = placed.filter("kind = 'INSERT'")
    out = out.unionByName(left.withColumn("problem", F.lit("INSERT: blocks nested too deep")).withColumn("parts", F.lit(None).cast(drawn.schema["parts"].dataType)))
    return out.select("layer", "kind", "geom_type", "parts", "Text", "problem")


def _inserted(inserts: DataFrame, inner: DataFrame) -> DataFrame:
    """The entities of the inserted blocks, scaled, turned and moved; those of
    layer 0 take the layer of the insert."""
    joined = inserts.select("file", F.col("name").alias("of"), F.col("layer").alias("o_layer"), F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("at"), "scale_x", "scale_y", "turn").join(inner, ["file", "of"])
    angle = F.radians("turn")

    def moved(p: Column) -> Column:
        x, y = (p["x"] - F.col("base.x")) * F.col("scale_x"), (p["y"] - F.col("base.y")) * F.col("scale_y")
        return F.struct((F.col("at.x") + x * F.cos(angle) - y * F.sin(angle)).alias("x"), (F.col("at.y") + x * F.sin(angle) + y * F.cos(angle)).alias("y"))

    return joined.select(
        "file", F.col("i_kind").alias("kind"), F.when(F.coalesce("i_layer", F.lit("0")) == "0", F.col("o_layer")).otherwise(F.col("i_layer")).alias("layer"), F.col("i_geom_type").alias("geom_type"),
        F.transform("i_parts", lambda part: F.transform(part, moved)).alias("parts"), F.col("i_Text").alias("Text"), F.col("i_name").alias("name"),
        (F.col("i_scale_x") * F.col("scale_x")).alias("scale_x"), (F.col("i_scale_y") * F.col("scale_y")).alias("scale_y"), (F.col("i_turn") + F.col("turn")).alias("turn"), F.col("i_problem").alias("problem"),
    )


def drawing_text(lines: DataFrame) -> DataFrame:
    """(value): an entity a row, of (layer, parts, Text): a line for each part of
    two points or more, a text where there is one. Written as text files they are
    drawings without sections."""
    group = lambda code, value: F.concat(F.lit(f"{code}\n"), value, F.lit("\n"))
    number = lambda c: F.format_string("%s", c.cast("double"))
    head = lambda kind: F.concat(F.lit(f"0\n{kind}\n"), group(8, F.coalesce("layer", F.lit("0"))))
    corners = lambda part: F.array_join(F.transform(part, lambda p: F.concat(group(10, number(p["x"])), group(20, number(p["y"])))), "")
    part = lines.select("layer", "Text", F.explode("parts").alias("part"))
    line = F.concat(head("LWPOLYLINE"), group(90, F.size("part").cast("string")), group(70, F.lit("0")), corners(F.col("part")))
    one = F.get("part", F.lit(0))
    text = F.concat(head("TEXT"), group(10, number(one["x"])), group(20, number(one["y"])), group(40, F.lit("1")), group(1, F.replace(F.col("Text"), F.lit("\n"), F.lit("\\P"))))
    return part.select(F.rtrim(F.when(F.col("Text").isNotNull(), text).when(F.size("part") > 1, line), F.lit("\n")).alias("value")).filter("value IS NOT NULL")


# ---- well-known text ----------------------------------------------------
_WKT = r"(?is)^\s*(?:SRID=\d+;)?\s*([A-Z]+)\s*(?:ZM|Z|M)?\s*(\(.*\)|EMPTY)\s*$"
_KINDS = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}


def from_wkt(text: Column) -> tuple[Column, Column]:
    """(geom_type, parts) of well-known text, further coordinates left out; null
    for text that is none, or of a kind that is not read. Empty shapes have no parts."""
    kind = F.upper(F.regexp_extract(text, _WKT, 1))
    name = F.element_at(F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair]), F.nullif(kind, F.lit("")))
    groups = F.regexp_extract_all(F.regexp_extract(text, _WKT, 2), F.lit(r"\(([^()]+)\)"), F.lit(1))
    numbers = lambda pair: F.split(F.trim(pair), r"\s+")
    point = lambda pair: F.struct(F.get(numbers(pair), F.lit(0)).try_cast("double").alias("x"), F.get(numbers(pair), F.lit(1)).try_cast("double").alias("y"))
    parts = F.transform(groups, lambda group: F.transform(F.split(group, ","), point))
    whole = F.when(kind == "MULTIPOINT", F.when(F.size(parts) > 0, F.array(F.flatten(parts))).otherwise(parts)).otherwise(parts)
    sound = F.forall(F.flatten(whole), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(sound, name), F.when(name.isNotNull() & sound, whole)


def to_wkt(geom_type: Column, parts: Column) -> Column:
    """Well-known text of a point, points, lines or a polygon with its holes; null
    without parts."""
    number = lambda c: F.regexp_replace(F.format_string("%s", c), r"\.0$", "")
    chain = lambda part: F.array_join(F.transform(part, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", ")
    closed = lambda ring: F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    many = lambda turned: F.concat(F.lit("("), F.array_join(F.transform(parts, lambda part: F.concat(F.lit("("), chain(turned(part)), F.lit(")"))), ", "), F.lit(")"))
    single = F.concat(F.lit("("), chain(F.element_at(parts, 1)), F.lit(")"))
    body = F.when(F.size(parts) == 0, "EMPTY").when(geom_type.isin("Point", "LineString", "MultiPoint"), single).when(geom_type == "Polygon", many(closed)).when(geom_type == "MultiLineString", many(lambda p: p))
    return F.when(parts.isNotNull(), F.concat(F.upper(geom_type), F.lit(" "), body))
