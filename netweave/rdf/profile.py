"""What a graph holds: counts, specific types, schema patterns; and what
follows from the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.rdf import vocabulary as V
from netweave.rdf.terms import RDF_TYPE, is_iri, is_literal


def entity_profile(triples: DataFrame) -> DataFrame:
    """One row of counts: triples, entities, relationships (IRI objects that are
    no types), attributes (literals), predicates and classes in use."""
    typed = F.col("p") == RDF_TYPE
    return triples.agg(
        F.count("*").alias("triples"), F.countDistinct("s").alias("entities"), F.count_if(is_iri(F.col("o")) & ~typed).alias("relationships"),
        F.count_if(is_literal(F.col("o"))).alias("attributes"), F.countDistinct("p").alias("predicates"), F.countDistinct(F.when(typed, F.col("o"))).alias("classes"),
    )


def specific_type(triples: DataFrame) -> DataFrame:
    """(s, type): of a subject's types the rarest, of equals the first by name."""
    typed = triples.filter(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("type"))
    counted = typed.join(typed.groupBy("type").agg(F.count("*").alias("n")), "type")
    return counted.groupBy("s").agg(F.min(F.struct("n", "type"))["type"].alias("type"))


def schema_patterns(triples: DataFrame) -> DataFrame:
    """(class1, p, class2, n): how often things of a class point to things of
    another."""
    kinds = specific_type(triples)
    edges = triples.filter((F.col("p") != RDF_TYPE) & is_iri(F.col("o")))
    from_, to = kinds.select("s", F.col("type").alias("class1")), kinds.select(F.col("s").alias("o"), F.col("type").alias("class2"))
    return edges.join(from_, "s").join(to, "o").groupBy("class1", "p", "class2").agg(F.count("*").alias("n"))


def schema_json(triples: DataFrame) -> DataFrame:
    """(json): the derived schema as one document: a node for each class with its
    things, an edge for each pattern, and the largest class. Classes and
    patterns are few, being part of the vocabulary."""
    local = lambda c: F.regexp_extract(c, r"([^#/]+)>$", 1)
    things = specific_type(triples).groupBy(local(F.col("type")).alias("id")).agg(F.count("*").alias("n"))
    edges = schema_patterns(triples).select(local(F.col("class1")).alias("source"), local(F.col("p")).alias("label"), local(F.col("class2")).alias("target"), "n")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ends.join(things, "id", "left").select(F.struct("id", F.col("id").alias("label"), F.coalesce("n", F.lit(0)).alias("n")).alias("data"))
    sources = edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "label", "n"))).alias("edges"))
    targets = nodes.agg(F.sort_array(F.collect_list("data")).alias("nodes"))
    counts = things.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "n")))).alias("counts"), F.max("n").alias("maxN"))
    return targets.crossJoin(sources).crossJoin(counts).select(F.to_json(F.struct("nodes", "edges", "counts", "maxN")).alias("json"))  # one row each


def ids_of(term: Column, kind: str = "J") -> Column:
    """The number of a node (J) or pipe (P) that a prefixed name or IRI ends
    in, such as ``J12``; null for any other term."""
    found = F.regexp_extract(term, rf"(?:^|[:#/])({kind}\d+)>?$", 1)
    return F.when(found != "", found)


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count("*").alias("n"))


def superclasses(spark, pairs: dict[str, str] = V.SUBCLASSES) -> DataFrame:
    """(sub, super): all superclasses of every class. The class tree is part of
    the code, so its closure is taken on the driver."""
    out = []
    for sub in pairs:
        at = sub
        while at in pairs:
            at = pairs[at]
            out.append((V.name(sub), V.name(at)))
    return spark.createDataFrame(out, "sub string, super string")


def infer(triples: DataFrame) -> DataFrame:
    """(s, p, o) that follow and are not stated: nodes that meet all criteria
    are candidates, nodes with a station are instrumented, dead ends are
    quality-critical, stations that host a flow sensor are smart meters, and
    things of a class are of its superclasses."""
    spark, typed = triples.sparkSession, F.lit(RDF_TYPE).alias("p")
    of = lambda df, c, name: df.select(F.col(c).alias("s"), typed, F.lit(V.name(name)).alias("o"))
    has = lambda p: triples.filter(F.col("p") == V.name(p))
    met = has("satisfiesCriterion").filter(F.col("o").isin(*[V.name(c) for c in V.CRITERIA.values()])).groupBy("s").agg(F.countDistinct("o").alias("n")).filter(F.col("n") == len(V.CRITERIA))
    candidates = of(met.join(has("nodeIdentifier").select("s"), "s", "left_semi"), "s", "CandidateSensorNode")
    instrumented = of(has("deployedAt"), "o", "InstrumentedNode")
    critical = of(triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == V.name("DeadEnd"))), "s", "QualityCriticalNode")
    flow = triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == V.name("FlowSensor"))).select(F.col("s").alias("o"))
    meters = of(triples.filter(F.col("p").endswith("/hosts>")).join(flow, "o", "left_semi"), "s", "SmartWaterMeter")
    first = candidates.union(instrumented).union(critical).union(meters).distinct()
    known = triples.filter(F.col("p") == RDF_TYPE).select("s", "p", "o").union(first)
    above = known.join(F.broadcast(superclasses(spark)), known["o"] == F.col("sub")).select("s", "p", F.col("super").alias("o"))  # the vocabulary's size
    return first.union(above).distinct().join(triples.filter(F.col("p") == RDF_TYPE), ["s", "p", "o"], "left_anti")


def violations(triples: DataFrame) -> DataFrame:
    """(rule, s): things of two classes that exclude each other, and more than
    one value of a property that has one."""
    kinds = triples.filter(F.col("p") == RDF_TYPE).select("s", "o")
    apart = [V.name(c) for c in ("DeadEnd", "Bend", "Junction")]
    several = kinds.filter(F.col("o").isin(*apart)).groupBy("s").agg(F.countDistinct("o").alias("n")).filter("n > 1").select(F.lit("disjoint classes").alias("rule"), "s")
    single = [V.name(p) for p in ("elevation", "diameter", "startNode", "endNode", "deployedAt")]
    double = triples.filter(F.col("p").isin(*single)).groupBy("s", "p").agg(F.countDistinct("o").alias("n")).filter("n > 1").select(F.lit("more than one value").alias("rule"), "s")
    return several.union(double)
