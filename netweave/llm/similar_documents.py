"""One document of each group of near-duplicates: SimHash tiles, widened.

A document's set is that of its shingles of five words (A-Z lower-cased; a
shorter text is its own only shingle). Documents whose sets have a Jaccard
similarity of 0.8 or more are linked, and connected components of the links
keep one document each.

Candidates are, first, the documents whose SimHash of these shingles is within
three bits, by the tiles of ``simhash.py``. That finds copies with few edits: at
a similarity of 0.8 about ten of the 64 bits differ, more than any choice of
equal parts can cover. So documents that agree in a band of a MinHash signature
are candidates too (16 bands of 4 places: two documents exactly at 0.8 share one
with probability 0.9998). A component of fingerprints is one more band; bands
are searched as in ``similarity.py``, which loses no link within them.

Defined results: documents with equal sets are one before anything is compared;
null, empty and blank texts have the same empty set; a null id is never the
first; repeated rows are one document; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm import similarity as near
from netweave.llm import simhash
from netweave.llm.rows import keep_rows, row_keys
from netweave.operators.components import connected_components
from netweave.session import stored

SEED, SHINGLE, RADIUS, BANDS, BAND_ROWS, SIMILARITY = 42, 5, 3, 16, 4, 0.8
#: Shingles signed at once.
CHUNK = 1 << 12


def _orders(places: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 1 << 63, places, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, places, np.uint64)


def signature(hashes: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Of a set's hashes the least in each of so many orders."""
    out = np.full(len(factor), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), CHUNK):
        mixed_up = hashes[at : at + CHUNK, None] * factor + offset
        mixed_up ^= mixed_up >> np.uint64(32)
        out = np.minimum(out, (mixed_up * factor).min(0))
    return out


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """What near.sketch makes of the hashes."""
    words = np.zeros(near.WORDS, np.uint64)
    np.bitwise_or.at(words, (hashes & np.uint64(near.WORDS - 1)).astype(np.intp), np.uint64(1) << (hashes >> np.uint64(5) & np.uint64(63)))
    return words


def _raw(text: pa.Scalar) -> bytes | None:
    return text.as_buffer().to_pybytes() if text.is_valid else None


def _signed(df: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, __k1, __k2, h1, size, bits, bands, words): the row's keys, a hash
    and the size of its set, its SimHash, its bands and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, offset = _orders(bands * band_rows)
        longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        lists = lambda x: pa.array([row.view(np.int64) for row in x], pa.list_(pa.int64()))
        for batch in batches:
            own, sizes, bits, keys, words = [], [], [], [], []
            for t in batch.column(3):
                parts = list(simhash.shingle_hashes(_raw(t), shingle))
                hashes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                signs = signature(hashes, factor, offset)
                own.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                bits.append(simhash.folded(parts))
                keys.append(np.array([xxhash.xxh64_intdigest(signs[b * band_rows : (b + 1) * band_rows].tobytes(), b) for b in range(bands)], np.uint64))
                words.append(bitmap(hashes))
            made = [longs(own), pa.array(sizes, pa.int64()), longs(bits), lists(keys), lists(words)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "__k1", "__k2", "h1", "size", "bits", "bands", "words"])

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), *row_keys(id_col, text_col), F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, __k1 long, __k2 long, h1 long, size long, bits long, bands array<long>, words array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(h1, hashes) of (h1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate(list(simhash.shingle_hashes(_raw(t), shingle)))).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["h1", "hashes"])

    return texts.select("h1", "text").mapInArrow(run, "h1 long, hashes array<long>")


def keep_first(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, radius: int = RADIUS, bands: int = BANDS, band_rows: int = BAND_ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df with one document of each component: that with the
    smallest id, of equal ids that with the smaller key; ids before null."""
    rows = stored(_signed(df, id_col, text_col, shingle, bands, band_rows), "signed")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2"))
    same = [F.first(c).alias(c) for c in ("size", "bands", "words")]
    first = stored(rows.groupBy("h1").agg(place.alias("first"), F.min("bits").alias("bits"), *same), "sets")
    full = first.filter("size > 0")
    tiles = connected_components(simhash.links(full.select("bits").distinct(), radius))
    tiled = full.join(tiles, full["bits"] == tiles["node"], "left").select("h1", F.xxhash64(F.lit("tile"), F.coalesce("component", "bits")).alias("band"))
    members = stored(near.led(full.select("h1", F.explode("bands").alias("band")).unionByName(tiled)), "members")
    wanted = first.join(members.select("h1").distinct(), "h1", "left_semi").select("h1", "first.__k1", "first.__k2")
    texts = df.select(*row_keys(id_col, text_col), F.col(f"`{text_col}`").alias("text")).join(wanted, ["__k1", "__k2"]).dropDuplicates(["h1"])
    sketches = first.select("h1", "size", *[F.get("words", k).alias(f"w{k}") for k in range(near.WORDS)])
    texts = stored(_sets(texts, shingle), "texts")

    def elements(items: DataFrame) -> DataFrame:
        return texts.join(items, "h1").select("h1", "root", F.explode("hashes").alias("element"))

    reached = near.components(members, sketches, texts, "hashes", lambda hashes: hashes, elements, similarity)
    rooted = first.join(reached, first["h1"] == reached["node"], "left").select("first", F.coalesce("component", "h1").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.__k1", "first.__k2")
    return keep_rows(df, kept, id_col, text_col)
