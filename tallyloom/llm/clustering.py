"""Clusters of vectors around centroids, in integers throughout, so that every run gives the same rows.

A vector meets the centroids by partial distances: squared differences are summed over the dimensions of high variance
first. The centroid that leads after the first of them gives a whole distance to beat; each other one is abandoned
when its sum is strictly above the best distance so far, and survivors finish all dimensions. Sums are exact, so an abandoned
centroid can't have won or tied.

A round is one pass: each task sums its vectors by cluster, and only these sums are shuffled. The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import cut, map_batches
from tallyloom.llm._vectors import integer_vectors, matrix

#: Dimensions that are summed before a centroid may be abandoned again.
BLOCK = 8
_SCHEMA = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid of each row, squared distance to it, squared differences that were computed).

    Of equally near centroids the smallest number wins.
    """
    x, c = x[:, order], centroids[:, order]
    dims = x.shape[1]
    head = np.stack([((x[:, :block] - one[:block]) ** 2).sum(1) for one in c], 1)
    who = head.argmin(1)
    lead = who.copy()
    best = head[np.arange(len(x)), lead] + ((x[:, block:] - c[lead][:, block:]) ** 2).sum(1)
    terms = head.size * min(block, dims) + len(x) * max(0, dims - block)
    for j in range(len(c)):
        alive = np.flatnonzero((head[:, j] <= best) & (lead != j))
        d = head[alive, j]
        for at in range(block, dims, block):
            if not len(alive):
                break
            part = x[alive, at : at + block] - c[j, at : at + block]
            d = d + (part * part).sum(1)
            terms += part.size
            stay = d <= best[alive]
            alive, d = alive[stay], d[stay]
        win = (d < best[alive]) | (j < who[alive])  # who survives with an equal distance wins by number alone
        best[alive[win]], who[alive[win]] = d[win], j
    return who, best, terms


def _by_variance(vectors: DataFrame, dims: int) -> np.ndarray:
    """The dimensions by falling variance; each task gives one row of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        if n:
            yield pa.record_batch([pa.array(np.full(dims, n)), pa.array(np.arange(dims)), pa.array(s), pa.array(q)], ["n", "dim", "s", "q"])

    sums = map_batches(vectors.select("x"), run, "n long, dim long, s double, q double")
    spread = sums.groupBy("dim").agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("v")).collect()
    return np.array([r.dim for r in sorted(spread, key=lambda r: (-r.v, r.dim))])


def _round(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]]]:
    """({(cluster, dimension): sum}, {cluster: (count, inertia)}) of the vectors by their nearest centroids."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            who, d, _ = nearest(x, centroids, order)
            for j in range(k):
                mine = who == j
                count[j] += mine.sum()
                inertia[j] += d[mine].sum()
                sums[j] += x[mine].sum(0)
        full = np.flatnonzero(count)
        if len(full):
            # dimension -1 carries the count and -2 the inertia
            values = np.concatenate([sums[full], count[full, None], inertia[full, None]], 1)
            names = np.concatenate([np.arange(dims), [-1, -2]])
            yield pa.record_batch([pa.array(np.repeat(full, dims + 2)), pa.array(np.tile(names, len(full))), pa.array(values.ravel())], ["cluster", "dim", "v"])

    parts = map_batches(vectors.select("x"), run, "cluster long, dim long, v long")
    total = {(r.cluster, r.dim): int(r.v) for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    sizes = {c: (v, total[c, -2]) for (c, dim), v in total.items() if dim == -1}
    return total, sizes


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector of dims finite components.

    Components become floor(1024 * component). The first centroids are the k vectors with the smallest SHA-256 of "seed:id";
    each round assigns all vectors and moves every centroid that has some to the floor of their mean; then they are assigned
    once more. Other vectors (null, shorter, longer, or with null, NaN or infinite components) are left out; components beyond
    131,072 in size are an error, since squared distances end at a long. Rows without an id count like others (their id as the empty
    text), repeated rows count each, equally near centroids go by number, and with fewer than k vectors there are as many
    centroids; equal vectors may be several of them, of which the later stay empty and in place. An empty table, or one without
    such vectors, gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = df.sparkSession
    vectors = cut(integer_vectors(df.filter(F.size(vec_col) == dims), id_col, vec_col))
    schema = _SCHEMA.format(vectors.schema["vec_id"].dataType.simpleString())
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], schema)
    centroids, order = np.array([r.x for r in first], np.int64), _by_variance(vectors, dims)
    for _ in range(rounds):
        sums, sizes = _round(vectors, centroids, order)
        for c, (n, _inertia) in sizes.items():
            centroids[c] = [sums[c, d] // n for d in range(dims)]
    _, sizes = _round(vectors, centroids, order)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = np.array([sizes.get(c, (0, 0))[1] for c in range(len(names))], np.int64)
    whole = sum(i for _, i in sizes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, d, _ = nearest(matrix(batch.column(1), dims), centroids, order)
            columns = [batch.column(0), pa.array(who.astype(np.int32)), pa.array(d), pa.array(inertia[who]), pa.array(np.full(len(who), whole)), pa.array(names).take(pa.array(who))]
            yield pa.record_batch(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return map_batches(vectors, run, schema)
