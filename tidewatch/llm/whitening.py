"""Whitening of embeddings by shifted Cholesky QR.

Entries become integers, so sums, centring and deviations are exact. Each pass sends the centred rows through the triangular
factors found so far and sums the Gram matrix of what comes out: a task keeps one matrix and emits its cells, which Spark
adds up. The Cholesky factor of that matrix joins the others; the first has a shift on its diagonal, so that it exists however
ill-conditioned the rows are. Two or three passes leave rows that are orthonormal. The composed factor R has the singular values and
right vectors of the centred rows, so its SVD gives components and eigenvalues without squaring the condition of the data.

What the driver gets is square in the number of dimensions, whatever the number of rows; a pass reads the packed rows from
the shared folder and writes nothing but the cells.

Results for odd inputs: a vector that is null or empty, or that has a null or non-finite entry, is left out, as is one with an
entry too large for a 64-bit integer; of vectors of several lengths those of the most frequent length are taken (of equally
frequent ones the longest). Directions without variance (constant dimensions, fewer rows than dimensions, copies of one vector)
have no component, so fewer than asked for may come out, and none for one row. Repeated rows and null ids count row by row; an
empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Passes at most, the departure from orthonormal rows that ends them, and the singular value that counts as none, as a share of the largest.
PASSES, ENOUGH, NOTHING = 6, 1e-12, 1e-12
#: Entries of a task's rows that are worked on at once.
AT_ONCE = 1 << 20


class Fit(NamedTuple):
    """Rows, sums of each dimension, components (one a row), their eigenvalues, the trace, and the number of Gram passes."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def packed(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id, size and x (little-endian 64-bit integers) of the vectors that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            scaled = np.floor(SCALE * pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
            fits = np.abs(scaled) < 2.0**62  # false for what isn't finite
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~fits)])
            kept = np.flatnonzero((sizes > 0) & (wrong[ends] == wrong[ends - sizes]))
            x = np.where(fits, scaled, 0).astype("<i8") + OFFSET
            rows = [x[ends[i] - sizes[i] : ends[i]].tobytes() for i in kept]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(sizes[kept]), pa.array(rows, pa.binary())], names=["vec_id", "size", "x"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    return rows.mapInArrow(run, "vec_id bigint, size bigint, x binary")


def matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows of a task, some at a time."""
    step = max(1, AT_ONCE // size)
    for batch in batches:
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            yield part.column("vec_id"), np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(len(part), size)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n times each entry's distance from its dimension's mean, as exact integers."""
    if len(x) and n * max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(sums).max()) >= 1 << 63:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def squares(apart: np.ndarray) -> list[Decimal]:
    """The sum of the squares of each row, exact."""
    if apart.dtype == object or len(apart) and float(np.abs(apart).max()) ** 2 * apart.shape[1] >= 2.0**62:
        return [Decimal(sum(int(v) ** 2 for v in row)) for row in apart]
    return [Decimal(int(v)) for v in (apart * apart).sum(axis=1)]


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Rows q with q R = row for the upper triangular factor R, column after column."""
    out = np.empty_like(rows)
    for j in range(len(factor)):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram(table: DataFrame, size: int, transform: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the outer products of what `transform` makes of the integer rows, `width` numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, x in matrices(batches, size):
            q = transform(x)
            total += q.T @ q
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    cells = table.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # square in the dimensions
    out = np.zeros((width, width))
    for c in cells:
        out[c.i, c.j] = out[c.j, c.i] = c.v
    return out


def cholesky(g: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """The upper factor of `g`, with the shift of the method where it is asked for or `g` has no factor without."""
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    d, unit = len(g), np.finfo(float).eps / 2
    shift = 11 * (rows * d + d * (d + 1)) * unit * np.linalg.norm(g, 2)
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def counted(table: DataFrame) -> tuple[int, int, np.ndarray]:
    """The size that is taken, the number of rows of that size, and the sums of their dimensions."""
    sizes = table.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return 0, 0, np.zeros(0, np.int64)
    size = sizes["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, x in matrices(batches, size):
            total += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    sums = table.where(F.col("size") == size).mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return size, sizes["count"], np.array([r.v for r in sorted(sums, key=lambda r: r.i)], np.int64)


def fit(table: DataFrame, size: int, n: int, sums: np.ndarray, components: int) -> Fit:
    """Components of the packed rows of one size."""
    factors: list[np.ndarray] = []
    whole = np.eye(size)
    for passes in range(1, PASSES + 1):

        def through(x: np.ndarray) -> np.ndarray:
            q = centred(x, n, sums)
            for r in factors:
                q = solved(q, r)
            return q

        g = gram(table, size, through, size)
        if not g.any():  # all rows are equal
            return Fit(n, sums, np.zeros((0, size)), np.zeros(0), 0.0, passes)
        # orthonormal but for directions that have nothing
        if factors and np.abs(g @ g - g).max() <= ENOUGH * size or passes == PASSES:
            break
        factors.append(cholesky(g, n, shifted=not factors))
        whole = factors[-1] @ whole
    # the last factor is the root of the last Gram matrix, which exists without full rank too
    weights, axes = np.linalg.eigh(g)
    _, sigma, right = np.linalg.svd(np.sqrt(np.maximum(weights, 0))[:, None] * axes.T @ whole)
    values = sigma**2 / n
    kept = min(components, int((sigma > NOTHING * sigma[0]).sum()))
    right = right[:kept]
    sign = np.sign(right[np.arange(kept), np.abs(right).argmax(axis=1)])
    return Fit(n, sums, right * sign[:, None], values[:kept], float(values.sum()), passes)


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation (decimal, exact), whitened (an array, one number a component), n, explained (an array) and identity_error.

    `deviation` is the squared length of n times the centred integer row.
    """
    spark = vectors.sparkSession
    schema = "vec_id bigint, deviation decimal(38,0), whitened array<double>"
    table = written(packed(vectors, id_column, column), "whitening-rows")
    size, n, sums = counted(table)
    if not n:
        found, off = spark.createDataFrame([], schema), 0.0
        return found.select("*", F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("explained"), F.lit(off).alias("identity_error"))
    table = table.where(F.col("size") == size)
    own = fit(table, size, n, sums, components)
    onto = own.components.T / np.sqrt(own.values)
    kept = len(own.values)
    off = 0.0
    if kept:
        # a column of ones gives the means
        g = gram(table, size, lambda x: np.column_stack([centred(x, n, sums) @ onto, np.ones(len(x))]), kept + 1) / n
        off = float(np.abs(g[:kept, :kept] - np.outer(g[kept, :kept], g[kept, :kept]) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches, size):
            apart = deviations(x, n, sums)
            w = (apart / n).astype(np.float64) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * kept, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(squares(apart), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    shares = F.array(*map(F.lit, (own.values / own.trace).tolist())) if kept else F.array()
    return table.mapInArrow(run, schema).select("*", F.lit(n).cast("long").alias("n"), shares.cast("array<double>").alias("explained"), F.lit(off).alias("identity_error"))
