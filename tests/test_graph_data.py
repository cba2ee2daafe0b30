"""Turtle, SPARQL and streams on small graphs."""

import pytest
from pyspark.sql import functions as F

from netweave.rdf import profile, turtle
from netweave.rdf.sparql import sparql
from netweave.rdf.sparql_parser import SparqlError
from netweave.streaming import readings

TEXT = '''@prefix : <http://example.org/net#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# two nodes
:a a :DeadEnd ; :elevation "50.0"^^xsd:decimal ; :label "a \\"quoted\\" one"@en , "zwei"@de .
:b a :Junction ; :elevation 50 ; :near :a , :c ; :note "x;y.z" .
:c :near :d . :d :near :a .
:b :part [ :size 3 ; a :Thing ] .
'''


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(list(turtle.parse_turtle(TEXT)), "s string, p string, o string")


def ask(graph, text):
    found = sparql(graph, "PREFIX : <http://example.org/net#> " + text)
    return sorted((tuple(v.replace("http://example.org/net#", "") if isinstance(v, str) else v for v in r) for r in found.collect()), key=str)


def test_turtle(spark, graph, tmp_path):
    assert graph.count() == 14
    turtle.write_turtle(graph.union(graph), str(tmp_path / "t"))
    again = turtle.read_turtle(spark, str(tmp_path / "t"))
    plain = lambda df: {tuple(r) for r in df.filter(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:")).collect()}
    assert plain(again) == plain(graph) and again.count() == 14
    assert turtle.merge(graph, graph).count() == 14
    assert all("<rdf:Description" in r.line for r in turtle.rdf_xml_lines(graph).collect())


@pytest.mark.parametrize("text, want", [
    ("SELECT ?x WHERE { ?x :elevation 50 }", [("b",)]),
    ("SELECT ?x WHERE { ?x :elevation ?e FILTER (?e = 50) }", [("a",), ("b",)]),
    ("SELECT ?x ?l WHERE { ?x a ?t . OPTIONAL { ?x :label ?l FILTER (LANG(?l) = 'en') } FILTER (isIRI(?x)) }", [("a", 'a "quoted" one'), ("b", None)]),
    ("SELECT ?x WHERE { ?x :near+ :a }", [("b",), ("c",), ("d",)]),
    ("SELECT ?y WHERE { :b :near/:near ?y }", [("d",)]),
    ("SELECT ?y WHERE { :c :near* ?y }", [("a",), ("c",), ("d",)]),
    ("SELECT ?y WHERE { :b (:near|:part/:size) ?y }", [("3",), ("a",), ("c",)]),
    ("SELECT ?y WHERE { :a ^:near ?y }", [("b",), ("d",)]),
    ("SELECT ?y WHERE { :c :near? ?y }", [("c",), ("d",)]),
    ("SELECT ?y WHERE { :b !(:near|:elevation|:note|:part) ?y }", [("Junction",)]),
    ("SELECT (COUNT(*) AS ?n) (SUM(?e) AS ?s) (GROUP_CONCAT(DISTINCT ?t; SEPARATOR=',') AS ?g) WHERE { ?x :elevation ?e BIND (STRAFTER(STR(?x), '#') AS ?t) }", [(2, 100.0, "a,b")]),
    ("SELECT ?x WHERE { ?x a ?t MINUS { ?x :near ?y } FILTER (!isBlank(?x)) }", [("a",)]),
    ("SELECT ?x ?v WHERE { VALUES (?x ?v) { (:a 1) (:zz UNDEF) } ?x a ?t }", [("a", "1")]),
    ("SELECT ?x WHERE { { ?x a :DeadEnd } UNION { ?x a :Junction } FILTER EXISTS { ?x :near ?y } }", [("b",)]),
    ("SELECT DISTINCT ?t WHERE { ?x a ?t } ORDER BY DESC(?t) LIMIT 1 OFFSET 1", [("Junction",)]),
    ("SELECT ?x ?n WHERE { ?x a ?t . { SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x :near ?y } GROUP BY ?x HAVING (COUNT(?y) > 1) } }", [("b", 2)]),
    ("SELECT ?x (IF(?e > 49, UCASE('hi'), 'lo') AS ?w) WHERE { ?x :elevation ?e FILTER (?e IN (50, 51) && REGEX(STR(?x), '#A$', 'i')) }", [("a", "HI")]),
    ("SELECT ?x WHERE { ?x :note ?n FILTER (CONTAINS(?n, ';') && STRLEN(?n) = 5 && STRSTARTS(?n, 'x')) }", [("b",)]),
    ("SELECT ?x ?z WHERE { ?x a :DeadEnd OPTIONAL { ?x :near ?y } OPTIONAL { ?z :near ?x . ?z a :Junction } }", [("a", "b")]),
    ("SELECT ?x WHERE { ?x :nothing ?y }", []),
    ("SELECT ?x WHERE { ?x :part [ a :Thing ; :size ?s ] FILTER (?s * 2 >= 6) }", [("b",)]),
])
def test_sparql(graph, text, want):
    assert ask(graph, text) == sorted(want, key=str)


def test_other_forms(graph):
    assert ask(graph, "ASK { :a a :DeadEnd }") == [(True,)] and ask(graph, "ASK { :a a :Junction }") == [(False,)]
    assert ask(graph, "CONSTRUCT { ?y :nearBy ?x } WHERE { ?x :near ?y FILTER (?x = :b) }") == [("<a>", "<nearBy>", "<b>"), ("<c>", "<nearBy>", "<b>")]
    assert len(ask(graph, "DESCRIBE :a")) == 4 and len(ask(graph, "DESCRIBE ?x WHERE { ?x a :Junction }")) == 6
    assert ask(graph.union(graph), "SELECT ?x WHERE { ?x a :DeadEnd }") == [("a",)]
    for bad in ("SELECT WHERE { ?x ?p ?o }", "SELECT ?x WHERE { ?x zz:p ?o }", "SELECT ?x { ?x :p ", "FROB ?x"):
        with pytest.raises(SparqlError):
            ask(graph, bad)


def test_rules(spark):
    name = lambda x: f"<http://example.org/net#{x}>"
    rows = [(name("a"), profile.RDF_TYPE, name("DeadEnd")), (name("a"), profile.RDF_TYPE, name("Junction")), (name("a"), name("nodeIdentifier"), '"a"'), (name("s"), name("deployedAt"), name("a")), (name("s"), name("deployedAt"), name("b"))]
    rows += [(name("a"), name("satisfiesCriterion"), name(c)) for c in ("TopologyCriterion", "ElevationCriterion", "PressureCriterion", "DemandCriterion")]
    g = spark.createDataFrame(rows, "s string, p string, o string")
    got = {(r.s, r.o) for r in profile.infer(g).collect()}
    assert {(name("a"), name("CandidateSensorNode")), (name("b"), name("InstrumentedNode")), (name("a"), name("QualityCriticalNode")), (name("a"), name("NetworkElement"))} <= got
    assert {(r.rule, r.s) for r in profile.violations(g).collect()} == {("disjoint classes", name("a")), ("more than one value", name("s"))}


def test_stream(spark, tmp_path):
    rows = [('{"station":"S1","ts":"2024-01-01T00:00:%02d","pH":%s}' % (i, v),) for i, v in enumerate((9.0, 9.2, 3.0))] + [("rubbish",), ('{"station":"S1","ts":"2024-01-01T00:05:00","turbidity":0.2}',)]
    spark.createDataFrame(rows, "payload string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("payload string").json(str(tmp_path / "in"))
    found = readings.breaches(readings.medians(readings.parse_payload(stream), watermark="10 minutes"), readings.permissible(spark))
    q = found.writeStream.outputMode("complete").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.station, r.property, r["median"], r.n, r.side) for r in spark.sql("select * from found").collect()] == [("S1", "pH", 9.0, 3, "high")]
    batch = readings.breaches(readings.medians(readings.parse_payload(spark.createDataFrame(rows, "payload string"))), readings.permissible(spark))
    assert batch.count() == 1


def test_lost_probes_by_name(spark):
    """Every 17th station's probe and no other term, and no number is cut out of
    terms that are no probe: a cast of nothing cost more than making a triple."""
    from netweave.plans.graph_data_queries import lost_probe, triples

    terms = {"<http://example.org/net#S34_Temperature>": True, "<http://example.org/net#S0_Temperature>": True, "<http://example.org/net#S35_Temperature>": False, "<http://example.org/net#S34_pH>": False, "<http://example.org/net#SX_Temperature>": False, '"17"': False, "": False}
    got = spark.createDataFrame([(t,) for t in terms], "s string").select("s", lost_probe("s").alias("lost")).collect()
    assert {r.s: r.lost for r in got} == terms
    assert "regexp_extract" not in triples.__closure__[0].cell_contents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_turtle_ranges_are_dealt_out(spark, tmp_path):
    """A task for each range: adaptive execution made one task of all."""
    rows = [(f"<http://e/{i}>", "<http://e/p>", f'"text {i}"@en') for i in range(3000)]
    turtle.write_turtle(spark.createDataFrame(rows, "s string, p string, o string").coalesce(1), str(tmp_path / "t"))
    read = turtle.read_turtle(spark, str(tmp_path / "t"), split_bytes=8192)
    files = read.sparkSession.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("turtle", "turtle")
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    stages = [files.getStageInfo(i) for job in files.getJobIdsForGroup("turtle") for i in files.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s) > 8


def test_plain_statements_are_read_as_any(spark):
    """Plain statements, and ones that only look like them, as the parser has them."""
    plain = '<http://e/a> <http://e/p> "x \\" . y"^^<http://e/t> .\n<http://e/a> <http://e/p> <http://e/b>.\n<http://e/a> <http://e/p> "z"@en-GB .\n'
    odd = '<http://e/c> <http://e/p> <http://e/d> , """a . b""" . # <http://e/x> <http://e/y> <http://e/z> .\n<http://e/c> a "v" .\n' + plain
    got = list(turtle.parse_turtle(plain + odd))
    first = [("<http://e/a>", "<http://e/p>", '"x \\" . y"^^<http://e/t>'), ("<http://e/a>", "<http://e/p>", "<http://e/b>"), ("<http://e/a>", "<http://e/p>", '"z"@en-GB')]
    more = [("<http://e/c>", "<http://e/p>", "<http://e/d>"), ("<http://e/c>", "<http://e/p>", '"a . b"'), ("<http://e/c>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", '"v"')]
    assert got == [*first, *more, *first]
    assert turtle._PLAIN.match(plain) and len(turtle.scan(plain, "", len(plain))[0]) == 3
