"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within ``radius`` bits of each other are found exactly. The 64
bits are cut into ``blocks`` parts; two fingerprints that differ in at most
``radius`` bits agree in at least ``blocks - radius`` parts, so every choice of
that many parts makes a tile of the fingerprints that agree there, and the
fingerprints of a tile are compared with numpy exclusive-or and bit counts.
A crowded tile is cut by population count and hash into smaller ones; pairs of
these whose population counts differ by more than the radius are skipped, the
others are compared as tasks of their own. A tile gives a spanning forest of
its links, not all its pairs; the forests are joined by connected components.

Equal fingerprints are one before anything is compared, so exact copies cost
nothing, however many there are.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; a null id is never the smallest; repeated rows are in
one component; very long texts are hashed to their last word. ``similar_documents.py`` keeps one
document of each group, checked by the exact similarity of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.rows import keep_rows, row_keys
from netweave.operators.components import connected_components
from netweave.session import cut

SEED, SHINGLE = 42, 3
#: Shingles counted at once, fingerprints of a tile beyond which it is cut, and rows compared at once.
CHUNK, TILE, ROWS = 1 << 16, 2048, 1 << 16


def shingle_hashes(raw: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles (A-Z lower-cased), repeats included, in parts."""
    words = (raw or b"").lower().split()
    if 0 < len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    for at in range(0, len(words) - shingle + 1, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        texts = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(SEED)), np.uint64)


def folded(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of the hashes: a bit is 1 if over half of them have it."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        n += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles."""
    return folded(shingle_hashes(raw, shingle))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, __k1, __k2, bits): the row's keys, and the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits.view(np.int64))], names=["doc_id", "__k1", "__k2", "bits"])

    rows = df.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, __k1 long, __k2 long, bits long")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of x and y within the radius, by windows of population counts."""
    px, py = np.bitwise_count(x), np.bitwise_count(y)
    order = np.argsort(py, kind="stable")
    y, py = y[order], py[order].astype(np.int64)
    left, right = [], []
    by_count = np.argsort(px, kind="stable")
    for at in range(0, len(x), 256):
        rows = by_count[at : at + 256]
        low, high = np.searchsorted(py, int(px[rows[0]]) - radius, "left"), np.searchsorted(py, int(px[rows[-1]]) + radius, "right")
        if low < high:
            i, j = np.nonzero(np.bitwise_count(x[rows, None] ^ y[None, low:high]) <= radius)
            left.append(rows[i])
            right.append(order[low + j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it is linked to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(tile: np.ndarray, bits: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of whole tiles, which lie one after another. side: 0 where
    all rows of a tile are compared, else 1 and 2, compared across."""
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(tile)])))
    left, right = [], []
    small = np.repeat((sizes <= 32) & (side[starts] == 0), sizes)
    for shift in range(1, int(min(32, sizes.max(initial=1)))):
        found = np.flatnonzero(small[shift:] & (tile[shift:] == tile[:-shift]) & (np.bitwise_count(bits[shift:] ^ bits[:-shift]) <= radius))
        left.append(found)
        right.append(found + shift)
    for start, size in zip(starts, sizes, strict=True):
        if size > 32 or side[start]:
            part = slice(start, start + size)
            one, two = (np.flatnonzero(side[part] == k) for k in (1, 2)) if side[start] else (np.arange(size),) * 2
            i, j = _near(bits[part][one], bits[part][two], radius)
            left.append(start + one[i])
            right.append(start + two[j])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    root = _forest(len(tile), i, j)
    moved = np.flatnonzero(root != np.arange(len(tile)))
    return bits[moved], bits[root[moved]]


def links(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(src, dst): forests that link all fingerprints (column ``bits``, each
    once) within the radius of each other."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    bits = F.col("bits")
    keyed = distinct.select("bits", F.posexplode(F.array(*[bits.bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "part"))
    crowded = keyed.groupBy("choice", "part").count().filter(F.col("count") > TILE)
    crowded = crowded.select("choice", "part", F.ceil(F.col("count") / TILE / 4).cast("int").alias("cuts"))
    keyed = keyed.join(crowded, ["choice", "part"], "left")
    ones, cut_nr = F.bit_count("bits"), F.pmod(F.xxhash64("bits"), F.col("cuts")).cast("int")
    own = (ones * F.lit(1 << 20) + cut_nr).cast("long")
    others = F.flatten(F.transform(F.sequence(ones - radius, ones + radius), lambda p: F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda c: (p * F.lit(1 << 20) + c).cast("long"))))
    pairs = F.transform(others, lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))
    single = F.array(F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("side")))
    tiles = keyed.withColumn("pair", F.explode(F.when(F.col("cuts").isNull(), single).otherwise(pairs)))
    tiles = tiles.select(F.xxhash64("choice", "part", "pair.a", "pair.b").alias("tile"), "bits", F.col("pair.side").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges_of(held: list[np.ndarray]) -> pa.RecordBatch:
            src, dst = _compare(held[0], held[1].view(np.uint64), held[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= ROWS:
                whole = int(np.searchsorted(held[0], held[0][-1], "left"))
                if whole:
                    yield edges_of([h[:whole] for h in held])
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield edges_of(held)

    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "side")
    return dealt.mapInArrow(run, "src long, dst long")


def _rooted(df: DataFrame, id_col: str, text_col: str, radius: int, shingle: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their keys and bits, and the distinct bits with the root
    of their component."""
    rows = cut(fingerprints(df, id_col, text_col, shingle))
    distinct = cut(rows.select("bits").distinct())
    reached = connected_components(links(distinct, radius, blocks))
    return rows, distinct.join(reached, distinct["bits"] == reached["node"], "left").select("bits", F.coalesce("component", "bits").alias("root"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, radius: int = 3, shingle: int = SHINGLE, blocks: int = 5) -> DataFrame:
    """(doc_id, bits, fingerprint, component_id) of each row: component_id is
    the smallest id that is reached over links."""
    rows, rooted = _rooted(df, id_col, text_col, radius, shingle, blocks)
    lowest = rows.groupBy("bits").agg(F.min("doc_id").alias("lowest")).join(rooted, "bits")
    smallest = lowest.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = rooted.join(smallest, "root").select("bits", "component_id")
    return rows.join(named, "bits").select("doc_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str, text_col: str, radius: int = 3, shingle: int = SHINGLE, blocks: int = 5) -> DataFrame:
    """The rows of df with one document of each component: that with the
    smallest id, of equal ids that with the smaller key; ids before null."""
    rows, rooted = _rooted(df, id_col, text_col, radius, shingle, blocks)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2"))
    lowest = rows.groupBy("bits").agg(first.alias("first")).join(rooted, "bits")
    kept = lowest.groupBy("root").agg(F.min("first").alias("first")).select("first.__k1", "first.__k2")
    return keep_rows(df, kept, id_col, text_col)
