"""Drawings and well-known text."""

import math

import pytest
from pyspark.sql import functions as F

from netweave.sources import drawing, layers

DRAWING = """0
SECTION
2
HEADER
9
$ACADVER
1
AC1015
0
ENDSEC
0
SECTION
2
BLOCKS
0
BLOCK
8
0
2
VALVE
10
1.0
20
1.0
0
LINE
8
0
10
1
20
1
11
3
21
1
0
TEXT
8
notes
10
2
20
2
1
A.V.
0
ENDBLK
0
BLOCK
2
PAIR
10
0
20
0
0
INSERT
8
0
2
VALVE
10
10
20
0
50
90
0
ENDBLK
0
ENDSEC
0
SECTION
2
ENTITIES
0
LINE
8
pipes
10
0
20
0
11
5.5
21
-2
0
LWPOLYLINE
8
pipes
90
3
70
1
10
0
20
0
10
4
20
0
10
4
20
3
0
POLYLINE
8
old
66
1
0
VERTEX
8
old
10
1
20
1
0
VERTEX
8
old
10
2
20
2
0
SEQEND
0
TEXT
8
0
10
7
20
8
1
6" C.I.
0
MTEXT
8
labels
10
1
20
2
3
{\\fArial|b0;new 
1
100mm\\Pline}
0
INSERT
8
fittings
2
VALVE
10
100
20
50
41
2
42
2
0
INSERT
8
fittings
2
PAIR
10
0
20
0
0
INSERT
8
fittings
2
NOWHERE
10
0
20
0
0
LINE
8
pipes
10
zero
20
0
11
1
21
1
0
LINE
8
pipes
10
1
20
1
0
HATCH
8
fill
0
CIRCLE
8
tanks
10
0
20
0
40
2
0
LINE
8
pipes
10
9
oops
20
9
0
LINE
8
last
10
1
20
2
11
3
21
4
0
ENDSEC
0
EOF
"""


def seen(df):
    rounded = lambda parts: None if parts is None else tuple(tuple((round(p.x, 6), round(p.y, 6)) for p in part) for part in parts)
    return sorted(((r.layer, r.kind, rounded(r.parts), r.Text, r.problem) for r in df.collect()), key=str)


@pytest.mark.parametrize("split", [1 << 20, 150, 37])
def test_drawing(spark, tmp_path, split):
    path = tmp_path / "plan.dxf"
    path.write_bytes(DRAWING.replace("\n", "\r\n").encode())
    got = seen(drawing.read_drawing(spark, str(path), split_bytes=split))
    circle = tuple((round(2 * math.cos(math.radians(5 * i)), 6), round(2 * math.sin(math.radians(5 * i)), 6)) for i in range(73))
    want = [
        ("pipes", "LINE", (((0, 0), (5.5, -2)),), None, None), ("pipes", "LWPOLYLINE", (((0, 0), (4, 0), (4, 3), (0, 0)),), None, None), ("old", "POLYLINE", (((1, 1), (2, 2)),), None, None),
        ("0", "TEXT", (((7, 8),),), '6" C.I.', None), ("labels", "MTEXT", (((1, 2),),), "new 100mm\nline", None),
        ("fittings", "LINE", (((100, 50), (104, 50)),), None, None), ("notes", "TEXT", (((102, 52),),), "A.V.", None),
        ("fittings", "LINE", (((10, 0), (10, 2)),), None, None), ("notes", "TEXT", (((9, 1),),), "A.V.", None),
        ("fittings", "INSERT", (((0, 0),),), None, "INSERT: no block NOWHERE"), ("pipes", "LINE", None, None, "LINE: could not convert string to float: 'zero'"), ("pipes", "LINE", None, None, "LINE: no value of group 11"),
        ("fill", "HATCH", None, None, "HATCH: not read"), ("tanks", "CIRCLE", (circle,), None, None), ("pipes", "LINE", None, None, "no group code: 'oops'"), ("last", "LINE", (((1, 2), (3, 4)),), None, None),
    ]
    assert got == sorted(want, key=str)


def test_drawing_feeds_the_layers(spark, tmp_path):
    path = tmp_path / "plan.dxf"
    path.write_text(DRAWING)
    features = drawing.read_drawing(spark, str(path))
    assert sorted(r.layer for r in layers.read_lines(features).collect()) == ["fittings", "fittings", "last", "old", "pipes", "pipes", "tanks"]
    assert ("0", '6" C.I.', 7.0, 8.0) in {(r.layer, r.raw, r.x, r.y) for r in layers.read_texts(features).collect()}
    (tmp_path / "empty.dxf").write_text("")
    assert drawing.read_drawing(spark, str(tmp_path / "empty.dxf")).count() == 0


def test_many_files_in_many_tasks(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('l', id % 3) AS layer", "CASE WHEN id % 5 = 0 THEN concat('t', id) END AS Text", "array(array(named_struct('x', id * 0.1D, 'y', -id * 1D), named_struct('x', id + 0.25D, 'y', 1e-7D))) AS parts")
    path = str(tmp_path / "drawn")
    drawing.drawing_text(rows.repartition(3)).write.text(path)
    found = drawing.read_drawing(spark, path, split_bytes=20_000)
    want = sorted(((r.layer, "TEXT" if r.Text else "LWPOLYLINE", tuple((p.x, p.y) for p in r.parts[0][: 1 if r.Text else 2]), r.Text) for r in rows.collect()), key=str)
    assert sorted(((r.layer, r.kind, tuple((p.x, p.y) for p in r.parts[0]), r.Text) for r in found.collect()), key=str) == want
    spark.dataSource.register(drawing.DrawingSource)
    raw = spark.read.format("drawing").option("split_bytes", 20_000).load(path)
    assert raw.select("file", "split").distinct().count() > 6


def test_wkt(spark):
    texts = ["POINT (1 2.5)", "point z(1 2 3)", "SRID=4326;LINESTRING(0 0,1 1 , 2 -1e3)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOINT (1 2, 3 4)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POLYGON EMPTY", "CIRCLE (0 0)", "LINESTRING (a b)", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    kind, parts = drawing.from_wkt(F.col("t"))
    got = df.select("id", kind.alias("k"), parts.alias("p")).orderBy("id").collect()
    flat = lambda p: None if p is None else [[(q.x, q.y) for q in part] for part in p]
    assert [(r.k, flat(r.p)) for r in got[:3]] == [("Point", [[(1.0, 2.5)]]), ("Point", [[(1.0, 2.0)]]), ("LineString", [[(0.0, 0.0), (1.0, 1.0), (2.0, -1000.0)]])]
    assert len(got[3].p) == 2 and flat(got[4].p) == flat(got[5].p) == [[(1.0, 2.0), (3.0, 4.0)]] and [len(x) for x in got[6].p] == [4, 4]
    assert (got[7].k, got[7].p) == ("Polygon", []) and all((r.k, r.p) == (None, None) for r in got[8:])
    back = df.select("id", kind.alias("k"), parts.alias("p")).select("id", drawing.to_wkt(F.col("k"), F.col("p")).alias("w")).orderBy("id").collect()
    assert [r.w for r in back[:4]] == ["POINT (1 2.5)", "POINT (1 2)", "LINESTRING (0 0, 1 1, 2 -1000)", texts[3]] and back[7].w == "POLYGON EMPTY" and back[8].w is None
