"""Whitening of embeddings with an exact covariance.

Components are scaled and floored to integers. Their sums and, less the whole
part of their means, their products are exact: integers are cut into small
limbs, limb matrices are multiplied by float64 BLAS, in blocks so small that
no sum leaves the 53 bits in which float64 is exact, and the products are put
together again as big integers. These are merged by Spark as pairs of decimals,
so neither the order of rows nor the number of tasks changes the covariance.
The driver gets one matrix of the dimension's size and decomposes it.

Defined results: vectors that are null, empty or hold null or non-finite entries
take no part; rows that repeat count each; a null id stays. Each dimension that
occurs is whitened by itself. Components without variance (an eigenvalue of no
more than the dimension times 2^-52 of the largest) are left out: one row alone
has none. A deviation beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.session import cut, stored

#: Bits of a limb, and rows of a block: rows * 2^(2 * (LIMB - 1)) < 2^53.
LIMB, BLOCK = 20, 8192
#: Big integers travel as high * 2^SHIFT + low.
SHIFT = 60


def usable(df: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x): rows that take part, their entries as integers."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("v")).filter("size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long")).alias("x"))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed limbs, lowest first: x is the sum of limb k times 2^(LIMB k), and no
    limb is larger than 2^(LIMB - 1)."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        low = ((x + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB
        if not x.any():
            return out


def exact_gram(x: np.ndarray) -> np.ndarray:
    """The exact product of an integer matrix's transpose and itself, as Python
    integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        parts = limbs(x[at : at + BLOCK])
        for i, a in enumerate(parts):
            for j in range(i, len(parts)):
                product = (a.T @ parts[j]).astype(np.int64).astype(object)
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers."""
    high = x >> 32
    return (high.sum(0).astype(object) << 32) + (x - (high << 32)).sum(0).astype(object)


def _matrices(batch: pa.RecordBatch, at: int, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a column of arrays, the rows that have it and their matrix."""
    column = batch.column(at)
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(rows), size)


def merged(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """By dimension, the number of rows and the sum over all rows of what ``of``
    makes of a block of them, exactly. A task adds up its own blocks; Spark adds up the
    tasks' cells; the driver gets a row for each cell."""
    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("high", pa.decimal128(38)), ("low", pa.decimal128(38)), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for rows, x in _matrices(batch, 0, "int64"):
                n, total = sums.get(x.shape[1], (0, 0))
                sums[x.shape[1]] = n + len(rows), total + of(x)
        for dim, (n, total) in sums.items():
            flat = total.ravel()
            high = flat >> SHIFT
            low = flat - (high << SHIFT)
            cells = len(flat)
            columns = [np.full(cells, dim), np.arange(cells), [Decimal(int(h)) for h in high], [Decimal(int(v)) for v in low], np.full(cells, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = df.mapInArrow(run, "dim int, cell long, high decimal(38,0), low decimal(38,0), rows long")
    added = found.groupBy("dim", "cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("rows").alias("rows"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for row in added.collect():  # the square of the dimension
        out.setdefault(row["dim"], (row["rows"], {}))[1][row["cell"]] = (int(row["high"]) << SHIFT) + int(row["low"])
    return {dim: (n, [cells[i] for i in range(len(cells))]) for dim, (n, cells) in out.items()}


def upper(matrix: np.ndarray) -> np.ndarray:
    return matrix[np.triu_indices(len(matrix))]


def square(cells: list, dim: int) -> np.ndarray:
    out = np.zeros((dim, dim), object)
    at = np.triu_indices(dim)
    out[at] = cells
    return np.where(np.tri(dim, k=-1, dtype=bool), out.T, out)


class Model:
    """Means, components and eigenvalues of one dimension's vectors."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int):
        """products: of the vectors less the whole part of their means."""
        dim = len(sums)
        self.n, self.whole = n, np.array([s // n for s in sums], object)
        self.rest = np.array([s % n for s in sums], object)
        exact = n * products - np.outer(self.rest, self.rest)
        cover = np.array([int(v) / (n * n) for v in exact.ravel()]).reshape(dim, dim)
        values, vectors = np.linalg.eigh(cover)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > dim * 2.0**-52 * max(values.max(), 0.0)]
        self.values, self.vectors, self.trace = values[order], vectors[:, order], float(np.trace(cover))

    def transform(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of integer vectors, the exact squared deviation, scaled by n squared, and
        the whitened components."""
        apart = self.n * (x.astype(object) - self.whole) - self.rest
        centred = (apart.astype(np.float64) / self.n) @ self.vectors
        return (apart * apart).sum(1), centred / np.sqrt(self.values)


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a
    row for each vector and component; components are numbered from 1.

    The fit takes all vectors. identity_error is the largest entry of the
    whitened vectors' own covariance, less the identity."""
    spark = df.sparkSession
    rows = cut(usable(df, id_col, vector_col, scale, offset))
    sums = merged(rows.select("x"), exact_sums)
    whole = {dim: np.array([s // n for s in cells], np.int64) for dim, (n, cells) in sums.items()}
    products = merged(rows.select("x"), lambda x: upper(exact_gram(x - whole[x.shape[1]])))
    models = {dim: Model(n, cells, square(products[dim][1], dim), components) for dim, (n, cells) in sums.items()}
    sent = spark.sparkContext.broadcast(models)  # matrices of the dimension's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, 1, "int64"):
                model = sent.value[x.shape[1]]
                deviation, whitened = model.transform(x)
                held = pa.array([int(d) if d < 1 << 63 else None for d in deviation], pa.int64())
                ends = pa.array(np.arange(len(x) + 1) * whitened.shape[1], pa.int32())
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(x), x.shape[1]), pa.int32()), held, pa.ListArray.from_arrays(ends, pa.array(whitened.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "deviation", "whitened"])

    found = stored(rows.mapInArrow(run, "vec_id long, dim int, deviation long, whitened array<double>"), "whitened")
    errors = identity_errors(found, models)
    known = [(dim, i + 1, m.n, float(e / m.trace), errors[dim]) for dim, m in models.items() for i, e in enumerate(m.values)]
    figures = spark.createDataFrame(known, "dim int, component int, n long, explained double, identity_error double")
    each = found.select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    # a row for each component of each dimension
    return each.join(F.broadcast(figures), ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def identity_errors(found: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """By dimension, how far the whitened vectors' covariance is from the
    identity: their means first, then products of what is left."""

    def added(of: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                dims = batch.column(0).to_numpy()
                for at, y in _matrices(batch, 1, "float64"):
                    if not y.shape[1]:
                        continue  # no component has variance
                    for dim in np.unique(dims[at]):  # dimensions may share a number of components
                        sums[dim] = sums.get(dim, 0.0) + of(y[dims[at] == dim], int(dim)).ravel()
            for dim, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), dim), pa.int32()), pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "cell", "value"])

        cells = found.select("dim", "whitened").mapInArrow(run, "dim int, cell long, value double").groupBy("dim", "cell").agg(F.sum("value").alias("value"))
        out: dict[int, dict[int, float]] = {}
        for row in cells.collect():  # the square of the number of components
            out.setdefault(row["dim"], {})[row["cell"]] = row["value"]
        return {dim: np.array([values[i] for i in range(len(values))]) for dim, values in out.items()}

    counts = {dim: m.n for dim, m in models.items()}
    means = {dim: total / counts[dim] for dim, total in added(lambda y, dim: y.sum(0)).items()}
    products = added(lambda y, dim: (y - means[dim]).T @ (y - means[dim]))
    out = {dim: 0.0 for dim in models}
    for dim, total in products.items():
        size = len(means[dim])
        out[dim] = float(np.abs(total.reshape(size, size) / counts[dim] - np.eye(size)).max())
    return out
