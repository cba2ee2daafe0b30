"""The network as triples, and questions to them in SPARQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from netweave.operators import placement
from netweave.plans.fixtures import BASE, PIPES, memo, net_links, net_pipes
from netweave.plans.placement_queries import FIGURES, RISKS, chosen
from netweave.plans.registry import query
from netweave.rdf import emit, profile, rules, store, turtle
from netweave.rdf import vocabulary as V
from netweave.rdf.sparql import sparql
from netweave.session import shared_path, table

PREFIX = {"n": V.NS}
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


@partial(memo, keep=store.stored_graph)
def triples(spark, sf_dir):
    nodes = chosen(spark, sf_dir)
    zone = F.concat(F.lit("N"), F.col("cluster") - 1)
    named = nodes.withColumn("zone", zone).withColumn("risks", placement.risks())
    stations = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("station_id"), (F.col("s_suppkey") * 7).alias("node_id")).join(named.select("node_id", "zone", "risks"), "node_id")
    stations = stations.withColumn("node_id", F.concat(F.lit("C"), "node_id"))
    zones = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("zone"), F.concat(F.lit("R"), "n_regionkey").alias("part_of"))
    pipes = net_pipes(spark, sf_dir).select(F.concat(F.lit("P"), "link_id").alias("pipe_id"), F.concat(F.lit("C"), "node1").alias("node1"), F.concat(F.lit("C"), "node2").alias("node2"), "diameter_mm")
    out = turtle.merge(emit.node_triples(named.withColumn("node_id", F.concat(F.lit("C"), "node_id"))), emit.zone_triples(zones), emit.pipe_triples(pipes), emit.station_triples(stations))
    # every 17th station lost its temperature probe
    return out.filter(~lost_probe("s") & ~(lost_probe("o") & F.col("p").endswith("/hosts>")))


def lost_probe(term: str) -> Column:
    """Whether a term is the temperature probe of a 17th station. The number is cut
    out of such names only: of all others a cast of nothing would cost more than
    making the triple."""
    number = F.substring_index(F.substring_index(term, "#S", -1), "_", 1).try_cast("long")
    return F.when(F.col(term).endswith("_Temperature>"), F.coalesce(number % 17 == 0, F.lit(False))).otherwise(False)


STATIONS = f"""stations AS (SELECT s_suppkey AS k, chosen.*, {RISKS} AS risks FROM supplier JOIN chosen ON node_id = s_suppkey * 7)"""
ALL = f"WITH {BASE}, {PIPES}, {FIGURES}, {STATIONS} "
SENSOR_ROWS = ", ".join(f"('{q}', '{c}', '{label}', '{prop}', '{pin}', '{face}', '{unit}')" for q, (c, label, prop, pin, face, unit) in V.SENSORS.items() if q in V.SUITE)


def _sql_triples() -> str:
    n = V.NS
    i = lambda e: f"'<{n}' || {e} || '>'"
    p = lambda x: f"'<{n}{x}>'"
    lit = lambda e, t: f"'\"' || CAST({e} AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#{t}>'"
    sosa = "http://www.w3.org/ns/sosa/"
    node = i("'C' || node_id")
    parts = [
        f"SELECT {node} AS s, '{TYPE}' AS p, {i('''CASE node_type WHEN 'dead_end' THEN 'DeadEnd' WHEN 'bend' THEN 'Bend' ELSE 'Junction' END''')} AS o FROM nodes",
        f"SELECT {node}, {p('nodeIdentifier')}, '\"C' || node_id || '\"' FROM nodes",
        f"SELECT {node}, {p('inDMA')}, {i(''''N' || (cluster - 1)''')} FROM nodes",
        *[f"SELECT {node}, {p(name)}, {lit(c, t)} FROM nodes" for name, c, t in (("elevation", "elevation_m", "decimal"), ("baseDemand", "demand_lps", "decimal"), ("modelledPressure", "pressure_m", "decimal"), ("nodeDegree", "degree", "integer"))],
        *[f"SELECT {node}, {p('satisfiesCriterion')}, {p(c)} FROM chosen WHERE {flag}" for flag, c in V.CRITERIA.items()],
        f"SELECT {i(''''N' || n_nationkey''')}, '{TYPE}', {p('DistrictMeteredArea')} FROM nation",
        f"SELECT {i(''''N' || n_nationkey''')}, {p('partOfNetwork')}, {i(''''R' || n_regionkey''')} FROM nation",
    ]
    pipe = i("'P' || link_id")
    parts += [
        f"SELECT {pipe}, '{TYPE}', {p('Pipe')} FROM pipes", f"SELECT {pipe}, {p('nodeIdentifier')}, '\"P' || link_id || '\"' FROM pipes", f"SELECT {pipe}, {p('startNode')}, {i(''''C' || node1''')} FROM pipes",
        f"SELECT {pipe}, {p('endNode')}, {i(''''C' || node2''')} FROM pipes", f"SELECT {pipe}, {p('diameter')}, {lit('diameter_mm', 'decimal')} FROM pipes",
    ]
    st, sensor = i("'S' || k"), i("'S' || k || '_' || q")
    parts += [
        f"SELECT {st}, '{TYPE}', {p('MonitoringStation')} FROM stations", f"SELECT {st}, {p('deployedAt')}, {node} FROM stations", f"SELECT {st}, {p('monitors')}, {node} FROM stations", f"SELECT {st}, {p('inDMA')}, {i(''''N' || (cluster - 1)''')} FROM stations",
        f"SELECT {st}, {p('samplingIntervalSeconds')}, '\"60\"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM stations", f"SELECT {st}, {p('addressesRisk')}, {i('risk')} FROM (SELECT k, unnest(risks) AS risk FROM stations)",
        f"SELECT {sensor}, '{TYPE}', {i('class')} FROM fitted", f"SELECT {sensor}, '{TYPE}', '<{sosa}Sensor>' FROM fitted", f"SELECT {sensor}, '<http://www.w3.org/2000/01/rdf-schema#label>', '\"' || label || '\"@en' FROM fitted", f"SELECT {sensor}, '<{sosa}observes>', {i('prop')} FROM fitted",
        f"SELECT {sensor}, {p('mcuPin')}, '\"' || pin || '\"' FROM fitted", f"SELECT {sensor}, {p('usesInterface')}, {i('face')} FROM fitted", f"SELECT {sensor}, {p('hasUnit')}, '<http://qudt.org/vocab/unit/' || unit || '>' FROM fitted",
        f"SELECT {st}, '<{sosa}hosts>', {sensor} FROM fitted", f"SELECT {sensor}, {p('compensatedBy')}, {i(''''S' || k || '_Temperature' ''')} FROM fitted WHERE q IN ('pH', 'TDS', 'DO')",
    ]
    return f"""suite(q, class, label, prop, pin, face, unit) AS (VALUES {SENSOR_ROWS}),
    fitted AS (SELECT k, suite.* FROM stations, suite WHERE NOT (k % 17 = 0 AND q = 'Temperature')),
    triples AS ({' UNION '.join(parts)})"""


TRIPLES = ALL + ", " + _sql_triples() + " "
IRI = lambda e: f"'{V.NS}' || {e}"


def ask(spark, sf_dir, text):
    graph = triples(spark, sf_dir)
    return sparql(graph, text, PREFIX, counts=store.counts(graph))


@query("triples_build", TRIPLES + "SELECT s, p, o FROM triples")
def triples_build(spark, sf_dir):
    return triples(spark, sf_dir)


@query("triples_count_by_predicate", TRIPLES + "SELECT p, count(*) AS n FROM triples GROUP BY p")
def triples_count_by_predicate(spark, sf_dir):
    return profile.predicate_counts(triples(spark, sf_dir))


DEAD_END_SENSORS = """# stations at dead ends
SELECT ?node ?pressure ?elevation WHERE {
  ?station a n:MonitoringStation ; n:deployedAt ?node .
  ?node a n:DeadEnd ; n:modelledPressure ?pressure ; n:elevation ?elevation .
} ORDER BY ?pressure"""


@query("sparql_dead_end_sensors", ALL + f"SELECT {IRI(''''C' || node_id''')} AS node, CAST(pressure_m AS VARCHAR) AS pressure, CAST(elevation_m AS VARCHAR) AS elevation FROM stations WHERE node_type = 'dead_end'")
def sparql_dead_end_sensors(spark, sf_dir):
    return ask(spark, sf_dir, DEAD_END_SENSORS)


@query("sparql_all_criteria", ALL + f"SELECT {IRI(''''C' || node_id''')} AS node, 4 AS criteria FROM chosen WHERE passed")
def sparql_all_criteria(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?node (COUNT(DISTINCT ?c) AS ?criteria) WHERE { ?node n:satisfiesCriterion ?c ; n:nodeIdentifier ?id . } GROUP BY ?node HAVING (COUNT(DISTINCT ?c) = 4) ORDER BY ?node")


@query("sparql_coverage", ALL + f"""SELECT {IRI("'N' || (cluster - 1)")} AS dma, count(DISTINCT CASE WHEN station THEN NULL ELSE k END) AS stations, count(DISTINCT id) AS nodes
  FROM (SELECT nodes.cluster, 'C' || nodes.node_id AS id, stations.k, false AS station FROM nodes LEFT JOIN stations USING (node_id) UNION ALL SELECT cluster, 'S' || k, NULL, true FROM stations) GROUP BY cluster""")
def sparql_coverage(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?dma (COUNT(DISTINCT ?station) AS ?stations) (COUNT(DISTINCT ?node) AS ?nodes) WHERE { ?node n:inDMA ?dma . OPTIONAL { ?station n:deployedAt ?node } } GROUP BY ?dma ORDER BY ?dma")


@query("sparql_unmonitored", ALL + f"SELECT {IRI(''''P' || link_id''')} AS pipe, CAST(diameter_mm AS VARCHAR) AS diameter, {IRI(''''C' || node1''')} AS node FROM pipes WHERE diameter_mm >= 200 AND node1 NOT IN (SELECT node_id FROM stations)")
def sparql_unmonitored(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?pipe ?diameter ?node WHERE { ?pipe a n:Pipe ; n:diameter ?diameter ; n:startNode ?node . FILTER (?diameter >= 200) FILTER NOT EXISTS { ?s n:deployedAt ?node } } ORDER BY DESC(?diameter)")


@query("sparql_provisioning", ALL + f"SELECT {IRI(''''S' || k''')} AS station FROM stations, (VALUES (1), (2), (3)) WHERE k % 17 = 0")
def sparql_provisioning(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?station WHERE { ?station sosa:hosts ?dependent . ?dependent n:compensatedBy ?t . FILTER NOT EXISTS { ?station sosa:hosts ?temp . ?temp a n:TemperatureSensor } }")


@query("sparql_risk", ALL + f"SELECT {IRI(''''C' || node_id''')} AS node, CAST(pressure_m AS VARCHAR) AS pressure, {IRI(chr(39) + 'IntrusionRisk' + chr(39))} AS risk FROM stations WHERE list_contains(risks, 'IntrusionRisk')")
def sparql_risk(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?node ?pressure ?risk WHERE { ?station n:deployedAt ?node ; n:addressesRisk ?risk . ?node n:modelledPressure ?pressure . FILTER (?risk = n:IntrusionRisk) } ORDER BY ?pressure")


@query("sparql_hero_ph", ALL + f"SELECT {IRI(''''C' || node_id''')} AS node, CAST(pressure_m AS VARCHAR) AS pressure, {IRI(''''N' || (cluster - 1)''')} AS dma, CAST(elevation_m AS VARCHAR) AS elevation FROM stations WHERE node_type = 'dead_end'")
def sparql_hero_ph(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?node ?pressure ?dma ?elevation WHERE { ?station n:deployedAt ?node ; sosa:hosts ?sensor . ?sensor a n:PHSensor . ?node a n:DeadEnd ; n:modelledPressure ?pressure ; n:elevation ?elevation ; n:inDMA ?dma . } ORDER BY ?pressure")


@query("sparql_describe", TRIPLES + f"SELECT s, p, o FROM triples WHERE s = '<{V.NS}C7>'")
def sparql_describe(spark, sf_dir):
    return ask(spark, sf_dir, "DESCRIBE n:C7")


@query("sparql_subgraph", TRIPLES + f"""SELECT substring(s, 2, length(s) - 2) AS s, substring(p, 2, length(p) - 2) AS p, CASE WHEN starts_with(o, '<') THEN substring(o, 2, length(o) - 2) ELSE regexp_extract(o, '^"(.*)"', 1) END AS o, way FROM (
  SELECT s, p, o, 'out' AS way FROM triples WHERE s = '<{V.NS}C7>' UNION ALL SELECT s, p, o, 'in' FROM triples WHERE o = '<{V.NS}C7>')""")
def sparql_subgraph(spark, sf_dir):
    return ask(spark, sf_dir, 'SELECT ?s ?p ?o ?way WHERE { { n:C7 ?p ?o . BIND (n:C7 AS ?s) BIND ("out" AS ?way) } UNION { ?s ?p n:C7 . BIND (n:C7 AS ?o) BIND ("in" AS ?way) } }')


@query("sparql_ask", ALL + "SELECT count(*) > 0 AS ask FROM stations WHERE k % 17 = 0")
def sparql_ask(spark, sf_dir):
    return ask(spark, sf_dir, "ASK { ?s sosa:hosts ?d . ?d n:compensatedBy ?t . MINUS { ?s sosa:hosts ?x . ?x a n:TemperatureSensor } }")


@query("sparql_construct", ALL + f"SELECT DISTINCT '<{V.NS}N' || (a.cluster - 1) || '>' AS s, '<{V.NS}monitoredBy>' AS p, '<{V.NS}S' || k || '>' AS o FROM stations a")
def sparql_construct(spark, sf_dir):
    return ask(spark, sf_dir, "CONSTRUCT { ?zone n:monitoredBy ?station } WHERE { ?station n:deployedAt/n:inDMA ?zone }")


@query("sparql_path", f"""WITH RECURSIVE {BASE}, walk AS (SELECT node2 AS node FROM links WHERE node1 = 1 UNION SELECT node2 FROM walk JOIN links ON node1 = node) SELECT {IRI("'C' || node")} AS node FROM walk""")
def sparql_path(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT DISTINCT ?node WHERE { n:C1 (^n:startNode/n:endNode)+ ?node }")


@query("sparql_aggregates", ALL + f"""SELECT {IRI("'N' || (cluster - 1)")} AS dma, CAST(sum(CAST(pressure_m AS DECIMAL(28,9))) AS DOUBLE) / count(*) AS mean, CAST(max(pressure_m) AS VARCHAR) AS top, count(*) AS n
  FROM nodes WHERE node_type IN ('dead_end', 'junction') AND degree >= 1 AND elevation_m * 2 > 100 GROUP BY cluster""")
def sparql_aggregates(spark, sf_dir):
    return ask(spark, sf_dir, "SELECT ?dma (AVG(?p) AS ?mean) (MAX(?p) AS ?top) (COUNT(*) AS ?n) WHERE { VALUES ?class { n:DeadEnd n:Junction } ?x a ?class ; n:inDMA ?dma ; n:modelledPressure ?p ; n:elevation ?e ; n:nodeDegree ?d . FILTER (?e * 2 > 100 && (?d >= 1 || !BOUND(?d))) } GROUP BY ?dma")


SHORT = "regexp_extract({0}, '[#/]([^#/>]+)>$', 1)"
KINDS = """typed AS (SELECT s, o AS type FROM triples WHERE p = '""" + TYPE + """'),
freq AS (SELECT type, count(*) AS f FROM typed GROUP BY type),
kinds AS (SELECT s, min(struct_pack(f := f, type := type)).type AS type FROM typed JOIN freq USING (type) GROUP BY s)"""


@query("specific_type", TRIPLES + f", {KINDS} SELECT s, type FROM kinds")
def specific_type(spark, sf_dir):
    return profile.specific_type(triples(spark, sf_dir))


@query("schema_patterns", TRIPLES + f", {KINDS} SELECT a.type AS class1, p, b.type AS class2, count(*) AS n FROM triples t JOIN kinds a ON a.s = t.s JOIN kinds b ON b.s = t.o WHERE p <> '{TYPE}' AND starts_with(o, '<') GROUP BY ALL")
def schema_patterns(spark, sf_dir):
    return profile.schema_patterns(triples(spark, sf_dir))


@query("entity_profile", TRIPLES + f"SELECT count(*) AS triples, count(DISTINCT s) AS entities, count(*) FILTER (starts_with(o, '<') AND p <> '{TYPE}') AS relationships, count(*) FILTER (starts_with(o, '\"')) AS attributes, count(DISTINCT p) AS predicates, count(DISTINCT o) FILTER (p = '{TYPE}') AS classes FROM triples")
def entity_profile(spark, sf_dir):
    return profile.entity_profile(triples(spark, sf_dir))


@query("infer_candidate", ALL + f"SELECT '<{V.NS}C' || node_id || '>' AS s FROM chosen WHERE passed")
def infer_candidate(spark, sf_dir):
    return profile.infer(triples(spark, sf_dir)).filter(F.col("o") == V.name("CandidateSensorNode")).select("s")


@query("infer_instrumented", ALL + f"SELECT DISTINCT '<{V.NS}C' || node_id || '>' AS s FROM stations")
def infer_instrumented(spark, sf_dir):
    return profile.infer(triples(spark, sf_dir)).filter(F.col("o") == V.name("InstrumentedNode")).select("s")


_PAIRS = ", ".join(f"('{V.name(a)}', '{V.name(b)}')" for a, b in V.SUBCLASSES.items())


@query("infer_subclass_closure", f"WITH RECURSIVE pairs(sub, super) AS (VALUES {_PAIRS}), up AS (SELECT sub, super FROM pairs UNION SELECT up.sub, pairs.super FROM up JOIN pairs ON up.super = pairs.sub) SELECT sub, super FROM up")
def infer_subclass_closure(spark, sf_dir):
    return profile.superclasses(spark)


def _typed(who: str, what: str, source: str) -> str:
    return f"SELECT '<{V.NS}' || {who} || '>' AS s, '<{V.NS}{what}>' AS type FROM {source}"


_FOLLOWS = " UNION ".join([
    *[_typed("'C' || node_id", c, "nodes") for c in ("Node", "NetworkElement")], _typed("'C' || node_id", "CandidateSensorNode", "chosen WHERE passed"), _typed("'C' || node_id", "InstrumentedNode", "stations"), _typed("'C' || node_id", "QualityCriticalNode", "nodes WHERE node_type = 'dead_end'"),
    *[_typed("'P' || link_id", c, "pipes") for c in ("Link", "NetworkElement")], _typed("'S' || k", "Platform", "stations"), _typed("'R' || n_regionkey", "WaterDistributionNetwork", "nation"),
    *[_typed(f"'{c}'", "PlacementCriterion", f"chosen WHERE {flag}") for flag, c in V.CRITERIA.items()], _typed("'S' || k || '_' || q", "Sensor", f"stations, (VALUES {', '.join(f'({chr(39)}{q}{chr(39)})' for q in V.SUITE)}) v(q) WHERE NOT (k % 17 = 0 AND q = 'Temperature')"),
])


@query("infer_types", ALL + f"SELECT DISTINCT s, type FROM ({_FOLLOWS})")
def infer_types(spark, sf_dir):
    """All types that follow by the vocabulary's rules and are not stated."""
    found = rules.entail(triples(spark, sf_dir), rules.NETWORK)
    return found.filter(F.col("p") == TYPE).select("s", F.col("o").alias("type"))


@query("infer_feeds", f"WITH RECURSIVE {BASE}, walk AS (SELECT node1 AS a, node2 AS b FROM links UNION SELECT a, node2 FROM walk JOIN links ON b = node1) SELECT DISTINCT '<{V.NS}C' || a || '>' AS s, '<{V.NS}C' || b || '>' AS o FROM walk WHERE (a, b) NOT IN (SELECT node1, node2 FROM links)")
def infer_feeds(spark, sf_dir):
    """What each node feeds through others, if links run from node1 to node2."""
    node = lambda c: F.concat(F.lit(f"<{V.NS}C"), c, F.lit(">"))
    stated = net_links(spark, sf_dir).select(node("node1").alias("s"), F.lit(V.name("feeds")).alias("p"), node("node2").alias("o"))
    return rules.entail(stated, rules.Rules(transitive=(V.name("feeds"),))).select("s", "o")


@query("turtle_roundtrip", TRIPLES + "SELECT s, p, o FROM triples")
def turtle_roundtrip(spark, sf_dir):
    path = shared_path(spark, "turtle")
    turtle.write_turtle(triples(spark, sf_dir), path)
    return turtle.read_turtle(spark, path)
