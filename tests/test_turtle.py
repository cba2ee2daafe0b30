"""Turtle read in ranges gives what it gives read whole."""

import random

import pytest
from pyspark.sql import functions as F

from netweave.rdf import turtle

HARD = '''# a comment with "quotes' and a dot .
@prefix ex: <http://e.org/a#> . @base <http://base.org/> .
ex:one ex:p "dots. and\\nmore. \\"quoted\\" # no comment" ; ex:q 1.5 , 2. ex:two ex:p ex:three.
ex:long ex:text """first line .
ex:not ex:a ex:triple .
"inner" and ""two"" \\""" still .
""" ; ex:other \'\'\'single ' and \'\' .
@prefix ex: <http://wrong/> .
# no comment .
\'\'\' .
<rel> a ex:Thing ; ex:with [ ex:p [ ex:q ex:deep ] ; ex:r "x" ] .
_:b1 ex:near _:b2 . _:b2 ex:near _:b1 .
PREFIX other: <http://other.org/>
other:x other:y "zwei"@de, true , -3 , 1e5 .
@prefix ex: <http://new.org/#> .
ex:one ex:p 'last' .
'''


def seen(triples):
    """Blank nodes by what hangs on them, as their names are of no matter."""
    rows = [tuple(r) for r in triples]
    names = {}
    for _ in range(3):
        for node in {x for r in rows for x in (r[0], r[2]) if x.startswith("_:")}:
            names[node] = str(sorted((r[1], names.get(r[2], "b") if r[2].startswith("_:") else r[2]) for r in rows if r[0] == node))
    return sorted((names.get(s, s), p, names.get(o, o)) for s, p, o in rows)


def test_whole():
    found = list(turtle.parse_turtle(HARD))
    at = lambda s, p: [o for a, b, o in found if (a, b) == (s, p)]
    assert at("<http://e.org/a#one>", "<http://e.org/a#p>") == ['"dots. and\\nmore. \\"quoted\\" # no comment"']
    assert at("<http://e.org/a#one>", "<http://e.org/a#q>") == ['"1.5"^^<http://www.w3.org/2001/XMLSchema#decimal>', '"2"^^<http://www.w3.org/2001/XMLSchema#integer>']
    assert at("<http://e.org/a#long>", "<http://e.org/a#text>") == ['"first line .\\nex:not ex:a ex:triple .\\n\\"inner\\" and \\"\\"two\\"\\" \\"\\"\\" still .\\n"']
    assert at("<http://base.org/rel>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>") == ["<http://e.org/a#Thing>"]
    assert at("<http://new.org/#one>", "<http://new.org/#p>") == ['"last"'] and len(at("<http://other.org/x>", "<http://other.org/y>")) == 4
    assert len(found) == 18


@pytest.mark.parametrize("split", [1 << 20, 400, 90, 23])
def test_ranges(spark, tmp_path, split):
    (tmp_path / "t.ttl").write_text(HARD)
    got = turtle.read_turtle(spark, str(tmp_path / "t.ttl"), split_bytes=split)
    assert seen(got.collect()) == seen(turtle.parse_turtle(HARD))


def test_many_ranges_and_files(spark, tmp_path):
    r = random.Random(2)
    parts = ["@prefix a: <http://one/> .\n"]
    for i in range(900):
        if i % 120 == 60:
            parts.append(f"@prefix a: <http://p{i}/> .\n")
        text = "".join(r.choice(["x", ". ", "é", "#", "'", "\n", '\\"', " "]) for _ in range(r.randrange(30)))
        parts.append(f'a:s{i} a:p """{text} """ ;\n  a:q [ a:n {i} ] , _:m{i % 9} .{r.choice([" ", chr(10), " # . " + chr(10)])}')
    text = "".join(parts)
    for name in ("a.ttl", "b.ttl"):
        (tmp_path / name).write_text(text, encoding="utf-8")
    whole = list(turtle.parse_turtle(text))
    got = turtle.read_turtle(spark, str(tmp_path), split_bytes=3000)
    assert got.count() == sum(2 if any(x.startswith("_:") for x in (s, o)) else 1 for s, p, o in set(whole))  # blank nodes by file
    own = turtle.read_turtle(spark, str(tmp_path / "a.ttl"), split_bytes=3000).collect()
    plain = lambda rows: {tuple(t) for t in rows if not t[0].startswith("_:") and not t[2].startswith("_:")}
    assert plain(own) == plain(whole) and len(own) == len(set(whole))
    (tmp_path / "none.ttl").write_text("")
    assert turtle.read_turtle(spark, str(tmp_path / "none.ttl")).count() == 0
    back = str(tmp_path / "back")
    turtle.write_turtle(spark.createDataFrame(own, "s string, p string, o string"), back)
    again = turtle.read_turtle(spark, back, split_bytes=2000)
    assert again.filter(~F.col("o").startswith("_:") & ~F.col("s").startswith("_:")).count() == len(plain(own))
