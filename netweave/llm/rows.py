"""Keys that tell the rows of a table of documents apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """``__k1`` and ``__k2``: 128 bits of a row's id and text. Rows that repeat
    both are one document."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(key.isNull(), key, text.isNull(), text).alias("__k1"), F.xxhash64(text, key, F.lit("second")).alias("__k2")]


def keep_rows(df: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df whose keys are in kept, each document once. df is shuffled
    once, by its keys, after each task has dropped the rows that it repeats; the
    row travels as one column, so its own names cannot clash with the keys."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *row_keys(id_col, text_col)).dropDuplicates(["__k1", "__k2"])
    joined = keyed.join(kept.select("__k1", "__k2"), ["__k1", "__k2"], "left_semi")
    return joined.select(*[F.col("__row")[c].alias(c) for c in df.columns])
