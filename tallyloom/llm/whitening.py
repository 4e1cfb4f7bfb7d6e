"""Whitening of vectors: centred, projected on the eigenvectors of their covariance, divided by the eigenvalues' roots.

Sums are exact integers. The covariance is compensated: centred vectors are pairs of doubles (high and low part), their
outer products are made by an error-free product and summed by error-free sums, so a sum has about 106 bits; each task
gives one pair of triangles, and pairs are merged across tasks. The eigen-solve is LAPACK's syevd (numpy.linalg.eigh):
Householder reduction to a tridiagonal matrix, then divide and conquer; its matrix has the vectors' length, not their number.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import cut, map_batches
from tallyloom.llm._vectors import integer_vectors, matrix

#: Rows whose outer products are held at once; tasks that merge those of all others, each of which gives one row.
ROWS, MERGE_TASKS = 128, 16
#: What is added to floor(1024 * component).
OFFSET = 100_000
_SPLIT = float(2**27 + 1)
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> Pair:
    t = a * _SPLIT
    high = t - (t - a)
    return high, a - high


def two_prod(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded product and its exact error."""
    p, (ah, al), (bh, bl) = a * b, _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def pair_sum(a: Pair, b: Pair) -> Pair:
    """The sum of two pairs as a pair."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    high = s + e
    return high, e - (high - s)


def column_sums(a: Pair) -> Pair:
    """The sums over rows: halves of the rows are added to each other until one is left."""
    while len(a[0]) > 1:
        half, odd = len(a[0]) // 2, len(a[0]) % 2
        both = pair_sum((a[0][:half], a[1][:half]), (a[0][half : 2 * half], a[1][half : 2 * half]))
        a = tuple(np.concatenate([x, y[-1:]]) for x, y in zip(both, a, strict=True)) if odd else both
    return a[0][0], a[1][0]


def outer_products(rows: Pair, i: np.ndarray, j: np.ndarray) -> Pair:
    """The products of entries i and j of each row."""
    high, low = rows
    p, e = two_prod(high[:, i], high[:, j])
    return p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j])


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """The exact integers n * x - sums; the whole part of the mean goes first, so that they stay small."""
    return n * (x - sums // n) - sums % n


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> Pair:
    """x - sums / n as a pair, from the exact integer n * x - sums."""
    m = deviations(x, sums, n)
    high = m.astype(np.float64)
    low = (m - high.astype(np.int64)).astype(np.float64)
    q = high / n
    p, e = two_prod(q, np.float64(n))
    r = ((high - p) - e + low) / n
    s = q + r
    return s, r - (s - q)


def total(vectors: DataFrame, dims: int, width: int, terms: Callable[[np.ndarray], Pair]) -> Pair:
    """The sum over all rows of width pairs each. A task gives one row, and the driver sees at most as many as there are merging tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width), np.zeros(width)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                sums = pair_sum(sums, column_sums(terms(x[at : at + ROWS])))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums[0]]), pa.array([sums[1]])], ["task", "high", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width), np.zeros(width)
        for batch in batches:
            for h, e in zip(batch.column(1), batch.column(2), strict=True):
                sums = pair_sum(sums, (h.values.to_numpy(), e.values.to_numpy()))
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([sums[0]]), pa.array([sums[1]])], ["task", "high", "low"])

    schema = "task int, high array<double>, low array<double>"
    merged = map_batches(map_batches(vectors.select("x"), run, schema).repartition(MERGE_TASKS, "task"), merge, schema)
    sums = np.zeros(width), np.zeros(width)
    for r in merged.collect():
        sums = pair_sum(sums, (np.array(r.high), np.array(r.low)))
    return sums


def integer_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dims, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n, s = n + len(x), s + x.sum(0)
        yield pa.record_batch([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], s]))], ["dim", "v"])

    parts = map_batches(vectors.select("x"), run, "dim long, v long")
    sums = {r.dim: int(r.v) for r in parts.groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return sums.get(-1, 0), [sums.get(d, 0) for d in range(dims)]


def squared_deviation(x: np.ndarray, sums: np.ndarray, n: int) -> list[int]:
    """The exact sum over dimensions of (n * x - sums)^2 of each row; large entries are squared in two parts of 30 bits."""
    m = np.abs(deviations(x, sums, n))
    top, groups = int(m.max(initial=0)), -(-m.shape[1] // 8)
    if top < 1 << 28 and groups <= 8:
        return (m * m).sum(1).tolist()
    if top >= 1 << 58:
        return [sum(v * v for v in row) for row in m.tolist()]
    a, b = m >> 30, m & ((1 << 30) - 1)
    sums_of = lambda v: [v[:, d::groups].sum(1).tolist() for d in range(groups)]  # noqa: E731  at most 8 terms, which a long holds
    parts = zip(*sums_of(a * a), *sums_of(a * b), *sums_of(b * b), strict=True)
    return [(sum(p[:groups]) << 60) + (sum(p[groups : 2 * groups]) << 31) + sum(p[2 * groups :]) for p in parts]


def solve(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns); a vector's largest entry is positive, of equally large ones the first."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return values, vectors * np.where(signs == 0, 1, signs)


def _triangle(flat: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = flat
    return out


def whiten_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact for each vector and each of the first components.

    Components of a vector become x = floor(1024 * component) + 100000; the covariance is over all vectors that are left, divisor n.
    Null vectors and vectors that hold null, NaN or infinite components are left out, and so are those whose length isn't the
    most frequent one (of equally frequent ones the greatest), as nothing projects them; components beyond 131,072 in size are an
    error. Vectors shorter than most have as many components. deviation is null where the exact sum, which
    deviation_exact holds, is above the largest long. Where an eigenvalue is zero up to rounding (fewer vectors than dimensions,
    constant or repeated dimensions) whitened is null; explained is null where all vectors are equal, and identity_error, which is
    over the components that have whitened values, where there are none. Rows without an id and repeated rows count like others;
    an empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = df.sparkSession
    listed = cut(integer_vectors(df, id_col, vec_col, add=OFFSET))
    kind = listed.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    sizes = listed.filter(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes.d
    vectors = listed.filter(F.size("x") == dims)
    n, sums = integer_sums(vectors, dims)
    s = np.array(sums, np.int64)
    i, j = np.triu_indices(dims)
    high, low = total(vectors, dims, len(i), lambda x: outer_products(centred(x, s, n), i, j))
    covariance = _triangle((high + low) / n, i, j, dims)
    trace = float(covariance.trace())
    values, axes = solve(covariance)
    k = min(most, dims)
    values, axes = values[:k], axes[:, :k]
    full = values > dims * np.finfo(float).eps * max(values[0], 0)
    project = axes[:, full] / np.sqrt(values[full])
    width = int(full.sum())
    error = None
    if width:
        white = lambda x: centred(x, s, n)[0] @ project
        high, low = total(vectors, dims, width, lambda x: (w := white(x), np.zeros_like(w)))
        mean = (high + low) / n
        i, j = np.triu_indices(width)
        high, low = total(vectors, dims, len(i), lambda x: outer_products((w := white(x) - mean, np.zeros_like(w)), i, j))
        error = float(np.abs(_triangle((high + low) / n, i, j, width) - np.eye(width)).max())
    explained = [max(0.0, float(e)) / trace if trace > 0 else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            r = len(x)
            out = np.full((r, k), np.nan)
            out[:, full] = centred(x, s, n)[0] @ project
            far = squared_deviation(x, s, n)
            each = pa.array(np.repeat(np.arange(r), k))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                pa.array(np.full(r * k, n)),
                pa.array([f if f < 1 << 63 else None for f in far], pa.int64()).take(each),
                pa.array(out.ravel(), mask=np.tile(~full, r)),
                pa.array(explained * r, pa.float64()),
                pa.array([error] * (r * k), pa.float64()),
                pa.array([decimal.Decimal(f) for f in far], pa.decimal128(38, 0)).take(each),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return map_batches(vectors, run, schema)
