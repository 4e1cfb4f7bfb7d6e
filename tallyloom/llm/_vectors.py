"""Vectors of integers, which the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers beyond this make squared distances that a long can't hold.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """Whether the vector is there and holds neither null nor NaN nor an infinity."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024, add: int = 0) -> DataFrame:
    """vec_id and x, the list of floor(scale * component) + add of each row whose vector is finite."""
    vector = F.col(vec_col)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(add).cast("long"))
    return df.filter(finite(vector)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The batch's vectors as rows. Larger entries than LARGEST are an error: no long could hold what follows from them."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if rows.size and (rows.max() > LARGEST or rows.min() < -LARGEST):
        raise ValueError(f"a component lies beyond {LARGEST} after scaling")
    return rows
