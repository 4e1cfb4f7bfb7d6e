"""Readings to folds: what a reader saw in a unit, as weighted operator events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyloom.functions.numeric import PPM

# The act of each ground site and stance.
GROUND_ACTS = {
    "void": {"cultivating": "INS", "clearing": "NUL", "tending": "SIG"},
    "field": {"cultivating": "SYN", "clearing": "SEG", "tending": "CON"},
    "atmosphere": {"cultivating": "REC", "clearing": "DEF", "tending": "EVA"},
}
STANCES = ("cultivating", "clearing", "tending")


ACT_FIELDS = ("act", "grain", "weight_ppm", "source")


def _events(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, pa.Array]:
    """(row, act, grain, units, source) of the operator events of a batch of readings, each row's in their order."""
    n, every = batch.num_rows, np.arange(batch.num_rows)
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    numbers = lambda a, t, empty: pc.fill_null(a.cast(t), empty).to_numpy(zero_copy_only=False)
    surprises = column("surprises")
    sizes = numbers(pc.list_value_length(surprises), pa.int64(), 0)
    n_syn = np.maximum(0, numbers(column("n_syn"), pa.int64(), 0))
    held, predicted = (numbers(column(c), pa.bool_(), False) for c in ("held", "predicted"))
    content = surprises.flatten().cast(pa.string())
    fixed = [(acts[st], "Ground", f"ground:{site}.{st}") for st in STANCES for site, acts in GROUND_ACTS.items()]
    fixed += [("SYN", "Figure", None), ("SYN", "Ground", "ground:syn-merge"), ("NUL", "Figure", None), ("REC", "Figure", None), ("EVA", "Figure", None)]
    parts = [(np.repeat(every, sizes), np.arange(len(content)) + len(fixed), 1.0), (np.repeat(every, n_syn), 9, 1.0)]
    amounts = np.stack([numbers(pc.struct_field(column("ground"), [site, st]), pa.float64(), 0.0) for st in STANCES for site in GROUND_ACTS], 1)
    totals = np.stack([(amounts[:, i] + amounts[:, i + 1]) + amounts[:, i + 2] for i in (0, 3, 6)], 1)
    safe = np.where(totals > 0, totals, 1.0) * np.maximum(1, (totals > 0).sum(1))[:, None]
    units = np.where(np.repeat(totals > 0, 3, axis=1), amounts / np.repeat(safe, 3, axis=1), 0.0)
    rows, kinds = np.nonzero(units > 0)
    parts += [(rows, kinds, units[rows, kinds]), (np.repeat(every, n_syn), 10, 1.0)]
    parts += [(every[held & (sizes + n_syn == 0)], 11, 1.0), (every[predicted], 12, 1.0), (every, 13, 1.0)]
    row = np.concatenate([r for r, _, _ in parts])
    order = np.argsort(row, kind="stable")
    what = pa.array(np.concatenate([np.broadcast_to(k, len(r)) for r, k, _ in parts])[order])
    of = lambda i, rest: pa.concat_arrays([pa.array([e[i] for e in fixed], pa.string()), rest]).take(what)
    act, grain, source = of(0, content), of(1, pa.array(["Figure"] * len(content), pa.string())), of(2, pa.nulls(len(content), pa.string()))
    return row[order], act, grain, np.concatenate([np.broadcast_to(u, len(r)) for r, _, u in parts])[order], source


def fold_readings(df: DataFrame) -> DataFrame:
    """Adds acts array<struct<act, grain, weight_ppm, source>>, of readings (surprises array<string>, n_syn int, ground struct, held
    boolean, predicted boolean), by the batch.

    In this order: each surprise and each merge at Figure grain, the ground (nine site-and-stance amounts: stances that have any share alike, within a
    stance by amount), each merge at Ground grain, holding if held and nothing else happened, learning if anything was predicted, and evaluation
    always. Shares are rounded half up; the last takes what is left of a million.
    """
    act = StructType([StructField(c, LongType() if c == "weight_ppm" else StringType()) for c in ACT_FIELDS])
    out = StructType([*df.schema.fields, StructField("acts", ArrayType(act))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, acts, grains, units, sources = _events(batch)
            total = np.bincount(row, units, n)
            weight = np.floor(units / total[row] * PPM + 0.5).astype(np.int64)
            ends = np.cumsum(np.bincount(row, minlength=n))
            weight[ends - 1] = 0
            weight[ends - 1] = PPM - np.add.reduceat(weight, ends - np.bincount(row, minlength=n)) if n else weight
            events = pa.StructArray.from_arrays([acts, grains, pa.array(weight), sources], list(ACT_FIELDS))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), events)
            yield pa.record_batch([*batch.columns, lists], [*batch.schema.names, "acts"])

    return df.mapInArrow(run, out)


def signature(acts: Column, sources: bool = False) -> Column:
    """The sorted distinct act:grain of events, with sources act:grain:source where an event has one."""
    named = F.filter(F.coalesce(acts, F.array().cast("array<struct<act:string,grain:string,source:string>>")) if sources else acts, lambda e: e.act.isNotNull() & e.grain.isNotNull())
    one = (lambda e: F.concat_ws(":", e.act, e.grain, e.source)) if sources else (lambda e: F.concat_ws(":", e.act, e.grain))
    return F.array_sort(F.array_distinct(F.transform(named, one)))
