"""Helpers that several operators of this package use."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources.scratch import cut  # noqa: F401  used by the operators of this package

#: The characters that count as white space in the contracts: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\f\r"
#: Rows of a batch that goes to Python.
BATCH_ROWS = 2000


def text_or_empty(col: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def squeeze_space(text: Column) -> Column:
    """Deletes every white-space character of the contracts.

    Six chained replacements of one byte each are faster than one regular expression.
    """
    for ch in ASCII_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def small(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows and, but for single longer texts, bytes, without a copy, so that few texts are Python strings at once."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.nbytes > size and part.num_rows > 1:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows: the JVM's buffers for them lie outside its heap and grow with the texts of a batch."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system at a task's end: the worker lives on, and other operators' tasks share the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps what is freed
    if trim:
        trim(0)


class Memo(dict):
    """A dictionary that makes what it lacks; whoever looks up in it empties it between texts when it has grown."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self, most: int) -> None:
        if len(self) > most:
            self.clear()


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
