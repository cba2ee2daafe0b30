"""Fuzzy line dedup by MinHash.

Lines are compared in lower case with runs of white space as one space. Equal
lines are one line to begin with. A line's set is that of its character
shingles (a shorter line is its own only shingle); its signature keeps, for
each of bands x band_rows fixed points, the shingle hash nearest to it (in
exclusive-or order, which is a minimum over a random order). Lines that agree in
a whole band are candidates, exact Jaccard similarity decides, and connected
components of the links keep one line each: the first by document id, then by
place in the document. Blank lines are no lines and stay. Two lines exactly at a
similarity of 0.8 share a band with probability 0.997.

DataFrame operations only. Lines of a band are verified against the band's lead,
so a family of n similar lines costs n comparisons; lines of a band that this
leaves in different components are compared with each other (``similarity.py``),
so no link between lines that share a band is lost.

Defined results: null texts have no lines and stay null; rows that repeat id and
text are one document; null ids come after all others; lines are compared
whole, however long; other columns may have any name.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm import similarity as near
from netweave.llm.rows import row_keys
from netweave.session import release, stored

SHINGLE, BANDS, BAND_ROWS, SIMILARITY = 8, 8, 3, 0.8
#: Shingles hashed at once, in one row.
STEP = 4
#: Bands that are searched at once, which bounds what lies on disk.
HALF = 4
_WHITE = " \t\x0b\f\r"


def normal(line: Column) -> Column:
    odd = reduce(Column.__or__, [F.contains(line, F.lit(white)) for white in ("  ", *_WHITE[1:])])
    return F.trim(F.when(odd, F.regexp_replace(F.lower(line), r"\s+", " ")).otherwise(F.lower(line)))


def blank(line: Column) -> Column:
    return F.trim(line, F.lit(_WHITE)) == ""


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, __k1, __k2, pos, h1, h2, line): the lines that are not blank."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), *row_keys(id_col, text_col), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "line"))
    rows = rows.filter(~blank(F.col("line"))).withColumn("line", normal(F.col("line")))
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(2), "line"))


def _last(chars: Column, shingle: int) -> Column:
    """Where the last shingle begins, from 1: chars has two bytes a character,
    so a shingle is a slice of it."""
    return F.greatest(F.octet_length(chars) - 2 * shingle, F.lit(0)) + 1


def _hash(chars: Column, at: Column, shingle: int) -> Column:
    return F.xxhash64(F.substring(chars, at, F.lit(2 * shingle)))


def _spread(lines: DataFrame, shingle: int, step: int, *keys: str) -> DataFrame:
    """Rows of so many shingles ``e0``, ``e1`` ... of (keys, chars), the last of
    a line repeated where there are no more."""
    chars, last = F.col("chars"), F.col("last")
    rows = lines.select(*keys, "chars").withColumn("last", _last(chars, shingle))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), last, F.lit(2 * step))))
    return rows.select(*keys, *[_hash(chars, F.least(F.col("at") + 2 * i, last), shingle).alias(f"e{i}") for i in range(step)])


def _shingles(line: Column, shingle: int) -> Column:
    whole = F.array(F.encode(line, "UTF-16BE"))  # made once, not for each shingle
    of = lambda chars: F.transform(F.sequence(F.lit(1), _last(chars, shingle), F.lit(2)), lambda at: _hash(chars, at, shingle))
    return F.flatten(F.transform(whole, of))


def _signed(lines: DataFrame, shingle: int, bands: int, band_rows: int) -> DataFrame:
    """(h1, low, high, bands) of (h1, h2, chars): the bands of each h1, with the
    smallest and largest h2."""
    points = random.Random(42)
    points = [F.lit(points.getrandbits(64) - (1 << 63)).cast("long") for _ in range(bands * band_rows)]
    places = [F.min(F.least(*[F.col(f"e{i}").bitwiseXOR(p) for i in range(STEP)])).alias(f"s{k}") for k, p in enumerate(points)]
    signed = _spread(lines, shingle, STEP, "h1", "h2").groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high"), *places)
    keys = [F.xxhash64(F.lit(b), *[f"s{b * band_rows + r}" for r in range(band_rows)]) for b in range(bands)]
    return signed.select("h1", "low", "high", F.array(*keys).alias("bands"))


def similar_lines(lines: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """(h1, h2, component) of the distinct lines of (line) that are similar to
    some other. Should two lines have the same h1, which h2 tells, the search
    knows them by other numbers."""
    known = lines.select("line").distinct().select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"), "line")
    known = stored(known.withColumn("own", F.col("h1")), "distinct")
    chars = F.encode("line", "UTF-16BE").alias("chars")
    signed = stored(_signed(known.select("h1", "h2", chars), shingle, bands, band_rows), "signed")
    renamed = known.join(signed.filter("low != high").select("h1"), "h1", "left_semi").withColumn("h1", F.xxhash64("h2", "h1"))
    signed = signed.filter("low = high").union(_signed(renamed.select("h1", "h2", chars), shingle, bands, band_rows))
    parts = [F.slice("bands", at + 1, HALF) for at in range(0, bands, HALF)]
    members = reduce(DataFrame.union, [stored(near.led(signed.select("h1", F.explode(part).alias("band"))), "members") for part in parts])
    wanted = members.select("h1").distinct()
    texts = stored(known.unionByName(renamed).join(wanted, "h1", "left_semi"), "texts")
    release(known)
    sketches = _spread(texts.select("h1", chars), shingle, 1, "h1").withColumnRenamed("e0", "element").groupBy("h1").agg(F.count("*").alias("size"), *near.sketch())
    sketches = stored(sketches, "sketches")

    def elements(items: DataFrame) -> DataFrame:
        return _spread(texts.join(items, "h1").select("h1", "root", chars), shingle, 1, "h1", "root").withColumnRenamed("e0", "element").distinct()

    found = near.components(members, sketches, texts, "line", lambda line: _shingles(line, shingle), elements, similarity)
    return texts.join(found, texts["h1"] == found["node"]).select(F.col("own").alias("h1"), "h2", "component")


def kept_lines(lines: DataFrame, components: DataFrame) -> DataFrame:
    """(__k1, __k2, __n_kept, __flags): for each document that keeps a line, whether it
    keeps its 0th, 1st ... up to the last that it keeps."""
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2", "pos")).alias("place")
    first = lines.groupBy("h1", "h2").agg(place).join(components, ["h1", "h2"], "left")
    alone = F.when(F.col("component").isNull(), F.struct("h1", "h2"))
    kept = first.groupBy("component", alone).agg(F.min("place").alias("place")).select("place.__k1", "place.__k2", "place.pos")
    kept = kept.groupBy("__k1", "__k2").agg(F.sort_array(F.collect_list("pos")).alias("kept"))  # at most a document's lines
    gap = lambda p, i: p - F.when(i == 0, F.lit(-1)).otherwise(F.get("kept", i - 1)) - 1
    return kept.select("__k1", "__k2", F.size("kept").alias("__n_kept"), F.flatten(F.transform("kept", lambda p, i: F.concat(F.array_repeat(F.lit(False), gap(p, i)), F.array(F.lit(True))))).alias("__flags"))


def _flags(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    lines = lines_of(df, id_col, text_col)
    return kept_lines(stored(lines.drop("line"), "lines"), similar_lines(lines, **how))


def line_report(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """Per document (doc_id, n_lines, n_kept, removed): removed has the places
    of the lines that go, from 0, blank lines counted."""
    flags = _flags(df, id_col, text_col, **how)
    empty = F.transform(F.split(F.col(f"`{text_col}`"), "\n"), blank)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), *row_keys(id_col, text_col), F.coalesce(empty, F.array().cast("array<boolean>")).alias("blank"))
    docs = docs.groupBy("__k1", "__k2").agg(F.first("doc_id").alias("doc_id"), F.first("blank").alias("blank"))
    joined = docs.join(flags, ["__k1", "__k2"], "left")
    places = F.filter(F.sequence(F.lit(0), F.size("blank") - 1), lambda i: ~F.get("blank", i) & ~F.coalesce(F.get("__flags", i), F.lit(False)))
    return joined.select(
        "doc_id", F.size(F.filter("blank", lambda x: ~x)).alias("n_lines"), F.coalesce("__n_kept", F.lit(0)).alias("n_kept"),
        F.when(F.size("blank") > 0, places).otherwise(F.array().cast("array<int>")).alias("removed"),
    )


def dedup_lines(df: DataFrame, id_col: str, text_col: str, drop_emptied: bool = True, **how) -> DataFrame:
    """df with the lines that go taken out of its texts, each document once.
    With drop_emptied, documents all of whose lines go are left out; those that
    had none stay as they are."""
    flags = _flags(df, id_col, text_col, **how)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *row_keys(id_col, text_col))
    joined = keyed.join(flags, ["__k1", "__k2"], "left").dropDuplicates(["__k1", "__k2"])
    whole = F.col("__row")[text_col]
    left = F.filter(F.split(whole, "\n"), lambda line, i: blank(line) | F.coalesce(F.get("__flags", i), F.lit(False)))
    text = F.when(whole.isNotNull(), F.array_join(left, "\n"))
    if drop_emptied:
        joined = joined.filter(F.col("__flags").isNotNull() | F.coalesce(F.trim(whole, F.lit(_WHITE + "\n")) == "", F.lit(True)))
    return joined.select(*[text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in df.columns])
