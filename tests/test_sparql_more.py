"""Dates, functions, seeded paths and negation after OPTIONAL."""

import hashlib
import io
from contextlib import redirect_stdout

import pytest

from netweave.rdf import sparql as compiler
from netweave.rdf.sparql import sparql

X = "http://x/"
STAMP = "http://www.w3.org/2001/XMLSchema#dateTime"


def iri(name):
    return f"<{X}{name}>"


@pytest.fixture(scope="module")
def graph(spark):
    stamp = lambda t, kind=STAMP: f'"{t}"^^<{kind}>'
    rows = [
        ("a", "at", stamp("2024-01-01T23:00:00-05:00")), ("b", "at", stamp("2024-01-02T00:30:00Z")), ("c", "at", stamp("2024-01-02T04:00:00Z")), ("d", "at", stamp("2024-01-03", STAMP.replace("dateTime", "date"))),
        ("a", "p", iri("b")), ("b", "p", iri("c")), ("c", "p", iri("d")), ("d", "p", iri("a")), ("e", "p", iri("f")), ("f", "p", iri("g")), ("a", "q", iri("a")), ("e", "q", iri("f")), ("z", "q", iri("z")),
        ("a", "r", iri("one")), ("b", "r", iri("two")), ("b", "t", iri("two")), ("c", "t", iri("three")), ("h", "v", '"-3"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("h", "name", '"a b/ü*~"'),
    ]
    return spark.createDataFrame([(iri(s), iri(p), o) for s, p, o in rows], "s string, p string, o string").cache()


def ask(graph, text):
    return sorted(tuple(r) for r in sparql(graph, f"PREFIX x: <{X}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> {text}").collect())


def test_dates_are_compared_by_instant(graph):
    at = lambda mark, t: [r[0][-1] for r in ask(graph, f'SELECT ?s WHERE {{ ?s x:at ?o FILTER(?o {mark} "{t}"^^xsd:dateTime) }}')]
    assert at(">", "2024-01-02T01:00:00Z") == ["a", "c", "d"] and at("=", "2024-01-02T04:00:00Z") == ["a", "c"] and at("!=", "2024-01-02T04:00:00Z") == ["b", "d"]
    ordered = sparql(graph, f"PREFIX x: <{X}> SELECT ?s WHERE {{ ?s x:at ?o }} ORDER BY ?o ?s").collect()
    assert [r.s[-1] for r in ordered] == ["b", "a", "c", "d"]
    assert ask(graph, "SELECT (MIN(?o) AS ?low) WHERE { ?s x:at ?o }") == [("2024-01-02T00:30:00Z",)]


def test_functions(graph):
    call = lambda text: ask(graph, f"SELECT ({text} AS ?x) WHERE {{ x:a x:at ?t . x:h x:v ?v ; x:name ?n }}")[0][0]
    assert [call(f"{f}(?t)") for f in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS", "TZ")] == [2024, 1, 1, 23, 0, 0.0, "-05:00"]
    assert call("ABS(-1)") == 1 and isinstance(call("ABS(-1)"), int) and call("ABS(?v)") == 3 and call("CEIL(1.2)") == 2
    assert call("ENCODE_FOR_URI(?n)") == "a%20b%2F%C3%BC%2A~"
    assert call("MD5(?n)") == hashlib.md5("a b/ü*~".encode()).hexdigest() and call("SHA256(?n)") == hashlib.sha256("a b/ü*~".encode()).hexdigest()
    assert call('STRDT("5", xsd:integer) + 1') == 6 and call('LANG(STRLANG("x", "de"))') == "de"
    assert call("YEAR(NOW())") >= 2024 and call("UUID()").startswith("urn:uuid:") and len(call("STRUUID()")) == 36 and 0 <= call("RAND()") < 1


CASES = {
    "NOT EXISTS": ("?s x:p ?n OPTIONAL { ?s x:r ?u } FILTER NOT EXISTS { ?s x:t ?u }", lambda p, r, t: [(s, u) for s, u in _optional(p, r) if not any(s == a and u in (None, b) for a, b in t)]),
    "EXISTS": ("?s x:p ?n OPTIONAL { ?s x:r ?u } FILTER EXISTS { ?s x:t ?u }", lambda p, r, t: [(s, u) for s, u in _optional(p, r) if any(s == a and u in (None, b) for a, b in t)]),
    "MINUS": ("?s x:p ?n OPTIONAL { ?s x:r ?u } MINUS { ?y x:t ?u }", lambda p, r, t: [(s, u) for s, u in _optional(p, r) if u is None or u not in {b for _, b in t}]),
    "MINUS both": ("?s x:p ?n OPTIONAL { ?s x:r ?u } MINUS { ?s x:p ?m OPTIONAL { ?s x:t ?u } }", lambda p, r, t: [(s, u) for s, u in _optional(p, r) if not any(s == a and (u is None or b is None or u == b) for a, b in _optional(p, t))]),
}


def _optional(p, r):
    return [(s, u) for s, _ in p for u in ([b for a, b in r if a == s] or [None])]


@pytest.mark.parametrize("name", CASES)
def test_negation_after_optional(graph, name):
    """The right rows, and no join without a key."""
    text, want = CASES[name]
    pairs = lambda k: [(r.s, r.o.strip("<>")) for r in graph.filter(f"p = '{iri(k)}'").collect()]
    p, r, t = pairs("p"), pairs("r"), pairs("t")
    found = sparql(graph, f"PREFIX x: <{X}> SELECT ?s ?u WHERE {{ {text} }}")
    assert sorted(map(str, found.collect())) == sorted(f"Row(s='{s.strip('<>')}', u={u!r})" for s, u in want(p, r, t))
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain()
    assert "NestedLoop" not in out.getvalue() and "CartesianProduct" not in out.getvalue()


def test_paths_start_from_what_is_bound(graph, monkeypatch):
    made = []
    real = compiler.Compiler.closure
    monkeypatch.setattr(compiler.Compiler, "closure", lambda self, steps, start: made.append(real(self, steps, start)) or made[-1])
    got = ask(graph, "SELECT ?s ?x WHERE { ?s x:q ?o . ?s x:p+ ?x }")
    assert got == sorted([(X + "a", X + n) for n in "abcd"] + [(X + "e", X + n) for n in "fg"])
    assert {r.s for r in made[0].select("s").distinct().collect()} == {iri("a"), iri("e")}  # never a pair with another start
    got = ask(graph, "SELECT ?s ?o WHERE { x:e x:q ?o . ?s x:p+ ?o }")
    assert got == [(X + "e", X + "f")] and {r.s for r in made[1].select("s").distinct().collect()} == {iri("f")}
    assert ask(graph, "SELECT ?x WHERE { ?s x:q x:z . ?s x:p* ?x }") == [(X + "z",)]
    assert ask(graph, "SELECT ?x WHERE { x:e x:q ?s . ?s x:p* ?x }") == [(X + "f",), (X + "g",)]
    assert len(ask(graph, "SELECT ?s ?x WHERE { ?s x:p+ ?x }")) == 4 * 4 + 3
