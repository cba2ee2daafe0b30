"""From raw documents to a training mix: five stages, each over all that the
one before it kept.

Every stage is a function of (session, documents, folder of the tables) and
returns documents; ``run`` writes each result as Parquet to the shared folder
and reads it again for the next, so a lost executor costs one stage at most.

SQL cannot express the stages (a learned scorer, MinHash), so there is
no ORACLE_SQL; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import decontaminate, line_dedup, quality, similar_documents, source_mix
from netweave.session import brief_plans, shared_path, table

ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_accepted(docs, "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere already; n_chars is
    counted anew, and documents left without a line go."""
    kept = line_dedup.dedup_lines(docs, "doc_id", "text")
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those linked by a Jaccard
    similarity of their five-word shingles of 0.8 or more."""
    return similar_documents.keep_first(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix serves, as often as it serves them, in its
    order; with mix_pass and mix_finish."""
    return source_mix.serve(docs, "doc_id", "text", "source")


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        kept = stage(spark, docs, sf_dir)
        with brief_plans(spark):
            kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
