"""Tables to triples: a row gives its triples at once, as exploded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions import labels
from netweave.rdf import vocabulary as V
from netweave.rdf.terms import PREFIXES, RDF_TYPE, iri, literal

LABEL, COMMENT = f"<{PREFIXES['rdfs']}label>", f"<{PREFIXES['rdfs']}comment>"


def local(*parts) -> Column:
    """An IRI of the network's namespace."""
    return iri(F.concat(F.lit(V.NS), *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def rows(df: DataFrame, subject: Column, properties: Sequence[tuple[str, Column]]) -> DataFrame:
    """(s, p, o): each row's properties; null objects are no triples, an array
    of objects is a triple each."""
    arrays = []
    for p, o in properties:
        arrays.append(F.struct(F.lit(p).alias("p"), o.alias("o")))
    return df.select(subject.alias("s"), F.explode(F.array(*arrays)).alias("t")).select("s", "t.p", "t.o").filter("s IS NOT NULL AND o IS NOT NULL")


def many(df: DataFrame, subject: Column, p: str, objects: Column) -> DataFrame:
    return df.select(subject.alias("s"), F.lit(p).alias("p"), F.explode(objects).alias("o")).filter("s IS NOT NULL AND o IS NOT NULL")


def choose(value: Column, named: dict[str, str], default: str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.coalesce(known[value], F.lit(default))


def node_triples(nodes: DataFrame) -> DataFrame:
    """node_id (text), node_type, zone (local name), figures and flags."""
    s, n = local(F.col("node_id")), V.name
    out = rows(nodes, s, [
        (RDF_TYPE, local(choose(F.col("node_type"), V.NODE_CLASSES, "Junction"))), (n("nodeIdentifier"), literal(F.col("node_id"))), (n("inDMA"), local(F.col("zone"))),
        (n("elevation"), literal(F.col("elevation_m"), "decimal")), (n("baseDemand"), literal(F.col("demand_lps"), "decimal")), (n("modelledPressure"), literal(F.col("pressure_m"), "decimal")), (n("nodeDegree"), literal(F.col("degree"), "integer")),
    ])
    return out.union(criterion_triples(nodes, s))


def criterion_triples(flagged: DataFrame, subject: Column) -> DataFrame:
    """An edge for each criterion flag that is true."""
    met = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(V.name(c))) for flag, c in V.CRITERIA.items()]))
    return many(flagged, subject, V.name("satisfiesCriterion"), met)


def zone_triples(zones: DataFrame) -> DataFrame:
    """zone, part_of, and optional node_count and means."""
    n, figures = V.name, (("node_count", "nodeCount", "integer"), ("mean_elevation", "meanElevation", "decimal"), ("mean_pressure", "meanPressure", "decimal"), ("aggregate_demand", "aggregateDemand", "decimal"))
    return rows(zones, local(F.col("zone")), [(RDF_TYPE, F.lit(n("DistrictMeteredArea"))), (n("partOfNetwork"), local(F.col("part_of"))), *[(n(p), literal(F.col(c), t)) for c, p, t in figures if c in zones.columns]])


def pipe_triples(pipes: DataFrame) -> DataFrame:
    """pipe_id, node1, node2 (texts), diameter_mm; length_m and material where
    there are such columns."""
    n = V.name
    more = [(n("pipeLength"), literal(F.col("length_m"), "decimal"))] if "length_m" in pipes.columns else []
    if "material" in pipes.columns:
        more += [(n("hasMaterial"), local(labels.material_name(F.col("material")))), (n("hazenWilliamsC"), literal(labels.roughness(F.col("material")), "decimal"))]
    return rows(pipes, local(F.col("pipe_id")), [(RDF_TYPE, F.lit(n("Pipe"))), (n("nodeIdentifier"), literal(F.col("pipe_id"))), (n("startNode"), local(F.col("node1"))), (n("endNode"), local(F.col("node2"))), (n("diameter"), literal(F.col("diameter_mm"), "decimal")), *more])


def station_triples(stations: DataFrame, suite: Sequence[str] = V.SUITE) -> DataFrame:
    """station_id, node_id, zone (texts), risks (array) and the suite's sensors
    in the catalogue, compensated by the station's temperature probe if the
    suite has one."""
    n, sosa, s = V.name, PREFIXES["sosa"], local(F.col("station_id"))
    out = rows(stations, s, [(RDF_TYPE, F.lit(n("MonitoringStation"))), (n("deployedAt"), local(F.col("node_id"))), (n("monitors"), local(F.col("node_id"))), (n("inDMA"), local(F.col("zone"))), (n("samplingIntervalSeconds"), literal(F.lit(60), "integer"))])
    out = out.union(many(stations, s, n("addressesRisk"), F.transform("risks", lambda r: local(r))))
    catalogue = stations.sparkSession.createDataFrame([(q, *V.SENSORS[q]) for q in suite if q in V.SENSORS], "sensor string, class string, label string, property string, pin string, interface string, unit string")
    fitted = stations.select("station_id").crossJoin(F.broadcast(catalogue))  # a row for each sensor of the suite
    own = local(F.col("station_id"), "_", F.col("sensor"))
    out = out.union(rows(fitted, own, [(RDF_TYPE, local(F.col("class"))), (RDF_TYPE, F.lit(f"<{sosa}Sensor>")), (LABEL, literal(F.col("label"), lang="en")), (f"<{sosa}observes>", local(F.col("property"))), (n("mcuPin"), literal(F.col("pin"))), (n("usesInterface"), local(F.col("interface"))), (n("hasUnit"), iri(F.concat(F.lit(PREFIXES["unit"]), F.col("unit"))))]))
    out = out.union(rows(fitted, local(F.col("station_id")), [(f"<{sosa}hosts>", own)]))
    if "Temperature" in suite:
        out = out.union(rows(fitted.filter(F.col("sensor").isin(*V.COMPENSATED)), own, [(n("compensatedBy"), local(F.col("station_id"), "_Temperature"))]))
    if "reason" in stations.columns:
        why = local("Rationale_", F.col("node_id"))
        out = out.union(rows(stations, why, [(RDF_TYPE, F.lit(n("PlacementRationale"))), (COMMENT, literal(F.substring("reason", 1, 400), lang="en"))])).union(rows(stations, s, [(n("hasRationale"), why)])).union(criterion_triples(stations, why))
    return out
