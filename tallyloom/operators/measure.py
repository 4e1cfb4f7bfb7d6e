"""Measurement: vectors or structured readings to a distribution over the 27 cells.

A measurement is two arrays in cube order, so that measuring is a projection: no shuffle, and one row stays one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tallyloom.functions.cube import CELLS
from tallyloom.functions.numeric import PPM, clamp_ppm, entropy_micro, entropy_term, half_up, once

N_CELLS = len(CELLS)


def centroids(df: DataFrame, cell: Column, vector_col: str, dims: int) -> DataFrame:
    """One row (centroids array<array<double>>, in cell order): mean vectors; a cell without vectors has zeros.

    One aggregation with partial sums; what is gathered is 27 rows whatever the input's size.
    """
    means = df.groupBy(cell.alias("cell")).agg(F.array(*[F.avg(F.col(vector_col)[i].cast("double")) for i in range(dims)]).alias("v"))
    zeros = F.array_repeat(F.lit(0.0), dims)
    held = means.agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"))
    return held.select(F.transform(F.sequence(F.lit(0), F.lit(N_CELLS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zeros)).alias("centroids"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0; vectors of unequal length are compared over the shorter."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms > 0, _dot(a, b) / F.when(norms > 0, norms).otherwise(1.0)).otherwise(F.lit(0.0))


def cosines(df: DataFrame, table: DataFrame, vector_col: str) -> DataFrame:
    """Adds cosines array<double>: the vector against each of the 27 centroids of a one-row table, 0 if either norm is 0.

    Vectors must have the centroids' length.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    with_norms = once(table, centroids=F.transform("centroids", lambda c: F.struct(c.alias("c"), F.sqrt(_dot(c, c)).alias("n"))))
    held = once(once(df, __v=vector), __n=F.sqrt(_dot(F.col("__v"), F.col("__v")))).crossJoin(F.broadcast(with_norms))
    safe = lambda c: F.when(c.n * F.col("__n") > 0, c.n * F.col("__n"))
    return once(held, cosines=F.transform("centroids", lambda c: F.coalesce(_dot(F.col("__v"), c.c) / safe(c), F.lit(0.0)))).drop("__v", "__n", "centroids")


def add_shares(df: DataFrame, weights: Column, out: str) -> DataFrame:
    """Adds out: non-negative weights as ppm. Each share is rounded half up, the last cell takes what is left, at least 0.

    All zero when the weights sum to 0. Where the rounded shares exceed a million the sum does too; that is the rule.
    """
    held = once(df, __p=weights)
    held = once(held, __t=F.aggregate("__p", F.lit(0.0), lambda s, x: s + x), __k=F.size("__p"))
    total = F.when(F.col("__t") > 0, F.col("__t")).otherwise(1.0)
    held = once(held, __r=F.transform(F.slice("__p", 1, F.col("__k") - 1), lambda w: half_up(w / total * PPM)))
    left = F.lit(PPM).cast("long") - F.aggregate("__r", F.lit(0).cast("long"), lambda s, x: s + x)
    full = F.concat("__r", F.array(F.greatest(F.lit(0).cast("long"), left)))
    return once(held, **{out: F.when(F.col("__t") > 0, full).otherwise(F.array_repeat(F.lit(0).cast("long"), F.col("__k")))}).drop("__p", "__t", "__k", "__r")


def _ppm(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity_ppm, amplitude_ppm) of rows of cosines: clamp_ppm and add_shares for whole batches."""
    similar = np.clip(np.floor(scores * PPM + 0.5), -PPM, PPM).astype(np.int64)
    weights = np.maximum(scores, 0.0)
    total = np.cumsum(weights, 1)[:, -1:]
    shares = np.floor(weights[:, :-1] / np.where(total > 0, total, 1.0) * PPM + 0.5).astype(np.int64)
    amplitude = np.concatenate([shares, np.maximum(0, PPM - shares.sum(1, keepdims=True))], 1)
    return similar, np.where(total > 0, amplitude, 0)


def measure_vectors(df: DataFrame, table: DataFrame, vector_col: str) -> DataFrame:
    """Adds cosines, similarity_ppm and amplitude_ppm, arrays in cube order; negative cosines count as no amplitude.

    The 27 centroids are read to the driver and go to the tasks, where a batch of vectors is one product of matrices. A vector that is null, of
    another length than the centroids, or that holds a null or a number that isn't finite, is like none of them: cosines of 0.
    """
    cents = np.array(table.first()["centroids"], np.float64)
    dims, norms = cents.shape[1], np.sqrt((cents * cents).sum(1))
    out = StructType([*df.schema.fields, StructField("cosines", ArrayType(DoubleType())), StructField("similarity_ppm", ArrayType(LongType())), StructField("amplitude_ppm", ArrayType(LongType()))])
    at = df.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            fits = np.array(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False))
            vectors = np.zeros((batch.num_rows, dims))
            vectors[fits] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            vectors[~np.isfinite(vectors).all(1)] = 0.0
            both = np.sqrt((vectors * vectors).sum(1))[:, None] * norms
            scores = np.where(both > 0, vectors @ cents.T / np.where(both > 0, both, 1.0), 0.0)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(cents))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (scores, *_ppm(scores))]
            yield pa.record_batch([*batch.columns, *lists], [*batch.schema.names, "cosines", "similarity_ppm", "amplitude_ppm"])

    return df.mapInArrow(run, out)


def entropy_microbits(amplitudes: Column) -> Column:
    """Entropy in bits of ppm amplitudes, in millionths."""
    return entropy_micro(F.aggregate(amplitudes, F.lit(0.0), lambda s, a: s + entropy_term(a / PPM)))


def supported(amplitudes: Column) -> Column:
    return F.aggregate(amplitudes, F.lit(0).cast("long"), lambda s, a: s + a)


def _fold_weights(acts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weight_ppm of operator events (act, grain, weight_ppm) per row and cell, in cube order, and which of these sums a null makes unknown.

    Without events a held fold is all weight on holding at Figure grain, and one that isn't held has none. An event whose act and
    grain name no cell raises an error.
    """
    n = len(acts)
    sizes = pc.fill_null(pc.list_value_length(acts), 0).to_numpy(zero_copy_only=False)
    events = acts.flatten()
    names = pc.binary_join_element_wise(events.field("act"), events.field("grain"), ":")
    cell = pc.index_in(names, pa.array([f"{c[2]}:{c[3]}" for c in CELLS]))
    if cell.null_count:
        raise ValueError("an event's act and grain name no cell")
    place = np.repeat(np.arange(n), sizes) * N_CELLS + cell.to_numpy(zero_copy_only=False)
    given = events.field("weight_ppm").cast(pa.int64(), safe=False)
    weights = np.zeros(n * N_CELLS, np.int64)
    np.add.at(weights, place, pc.fill_null(given, 0).to_numpy(zero_copy_only=False))
    unknown = np.zeros(n * N_CELLS, bool)
    unknown[place[given.is_null().to_numpy(zero_copy_only=False)]] = True
    weights, unknown = weights.reshape(n, N_CELLS), unknown.reshape(n, N_CELLS)
    hold = next(i for i, c in enumerate(CELLS) if c[2:4] == ("NUL", "Figure"))
    weights[held & (sizes == 0), hold] = PPM
    return weights, unknown


def measure_folds(df: DataFrame, acts_col: str = "acts", held_col: str = "held") -> DataFrame:
    """Adds similarity_ppm (the fold's own weight, scaled down where the events exceed a million) and amplitude_ppm, by the batch.

    A weight that is null leaves its cell's similarity at a million and the fold without amplitudes.
    """
    out = StructType([*df.schema.fields, StructField("similarity_ppm", ArrayType(LongType())), StructField("amplitude_ppm", ArrayType(LongType()))])
    at, held_at = df.columns.index(acts_col), df.columns.index(held_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.fill_null(batch.column(held_at), False).to_numpy(zero_copy_only=False)
            weights, unknown = _fold_weights(batch.column(at), held)
            lost = unknown.any(1)
            total = np.where(lost, 0, weights.sum(1))[:, None]
            scale = np.where(total > PPM, PPM / np.where(total > 0, total, 1), 1.0)
            similar = np.clip(np.floor(weights * scale + 0.5), -PPM, PPM).astype(np.int64)
            similar[unknown] = PPM
            shares = np.floor(weights[:, :-1] / np.where(total > 0, total, 1) * PPM + 0.5).astype(np.int64)
            amplitude = np.where(total > 0, np.concatenate([shares, np.maximum(0, PPM - shares.sum(1, keepdims=True))], 1), 0)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_CELLS)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (similar, amplitude)]
            yield pa.record_batch([*batch.columns, *lists], [*batch.schema.names, "similarity_ppm", "amplitude_ppm"])

    return df.mapInArrow(run, out)


def cells_long(df: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, cell int, similarity_ppm, amplitude_ppm): one row a cell."""
    zipped = F.arrays_zip("similarity_ppm", "amplitude_ppm")
    return df.select(*keep, F.posexplode(zipped).alias("cell", "m")).select(*keep, "cell", F.col("m.similarity_ppm").alias("similarity_ppm"), F.col("m.amplitude_ppm").alias("amplitude_ppm"))
