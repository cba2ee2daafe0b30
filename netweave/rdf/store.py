"""A graph on disk, ordered so that a pattern reads little of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netweave.rdf.profile import predicate_counts
from netweave.session import shared_path


def write_graph(triples: DataFrame, path: str) -> None:
    """Triples as a set, range-sorted by predicate and subject: files and row
    groups that do not have a pattern's predicate are passed over by their
    statistics, and a predicate with very many triples lies in many files."""
    ordered = triples.select("s", "p", "o").distinct().repartitionByRange("p", "s", "o").sortWithinPartitions("p", "s", "o")
    ordered.write.option("compression", "zstd").parquet(path)


def stored_graph(triples: DataFrame) -> DataFrame:
    """The triples as such a table in the shared folder."""
    path = shared_path(triples.sparkSession, "graph")
    write_graph(triples, path)
    return triples.sparkSession.read.schema("s string, p string, o string").parquet(path)


def counts(graph: DataFrame) -> dict[str, int]:
    """Triples of each predicate, by which patterns are ordered; predicates are
    few, being part of the vocabulary."""
    return {row["p"]: row["n"] for row in predicate_counts(graph).collect()}
