"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.scratch import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (x, y) that connect the same nodes: of each batch's pieces one node with every other, so that chains that lie together are stars at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict = {}
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for node in (x, y):
                    up.setdefault(node, node)
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                up[max(x, y)] = min(x, y)
            ends = []
            for node in up:
                top = node
                while up[top] != top:
                    up[top] = top = up[up[top]]
                if top != node:
                    ends.append((node, top))
            yield pa.record_batch([pa.array([e[i] for e in ends], batch.schema.field(i).type) for i in (0, 1)], ["x", "y"])

    plain = all(field.dataType.typeName() in ("string", "byte", "short", "integer", "long") for field in edges.schema)
    return edges.mapInArrow(run, edges.schema) if plain else edges  # other types needn't be equal in Python where they are in Spark


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each node of an edge can reach.

    Node ids may be of any orderable type. Loops and repeated edges change nothing; edges with a null end are
    ignored; no edges give no rows. Edges that lie together are contracted first. Every round moves each node's edges towards its smallest neighbour and
    halves chains at least; it ends when a round changes nothing. Rows of a hub are summed before their shuffle and joined by
    a join that adaptive execution splits. Edges never leave the executors: the driver sees a count and a checksum.
    """
    ends = _contracted(edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x <> y"))
    now = cut(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    mark = F.struct(F.count("*"), F.coalesce(F.sum(F.shiftright(F.xxhash64("a", "b"), 16)), F.lit(0)))
    before = now.agg(mark).first()[0]
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now = cut(_stars(now))
        after = now.agg(mark).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
