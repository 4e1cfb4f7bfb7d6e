"""Exact deduplication by progressive refinement.

Two texts are equal when they are identical after every white-space character is deleted. Rows are
grouped by the length of that normalised text and, within it, by a hash of its prefix; both come from one pass over the texts, so the
first two levels are one summed table. Only what is in a group of two
or more by both has its whole text hashed. A row that falls out on the way is unique and never takes part in a shuffle
of full hashes.

At scale: the shuffled rows are narrow (ids, lengths, hashes), never texts. The first grouping is summed
before its shuffle. The keys of surviving groups are broadcast only when counted and found small; beyond
that bound every row's whole text is hashed, with the same result. A hot group (a third of all rows)
is aggregated before the shuffle and joined back by a join that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import cut, squeeze_space, text_or_empty

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 64
#: Surviving (length, prefix hash) keys that may be broadcast: about 16 bytes each.
BROADCAST_KEYS = 1_000_000


def _signed(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(
        F.col(id_col).alias("__id"),
        F.length(text).alias("__points"),
        squeeze_space(text).alias("__norm"),
        *carry,
    ).select(
        "__id",
        "__points",
        "__norm",
        F.length("__norm").alias("__len"),
        F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("__prefix"),
        *carry,
    )


def _rank(points: Column, id_col: str) -> Column:
    """What is least for the row that stays: the most code points, then an id before none, then the smallest id, of any type."""
    return F.struct(F.negative(points).alias("less"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def refine(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """One narrow row a document: __id, __points, __len, __prefix, __full (null: unique), and the carried columns."""
    signed = _signed(df, id_col, text_col, carry)
    pairs = signed.groupBy("__len", "__prefix").agg(F.count("*").alias("__n"))
    survivors = cut(pairs.filter("__n > 1").select("__len", "__prefix", F.lit(True).alias("__hit")))
    whole = F.sha2("__norm", 256)
    if survivors.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked = signed.join(F.broadcast(survivors), ["__len", "__prefix"], "left")
        full = F.when(F.col("__hit"), whole)
    else:
        marked, full = signed, whole
    return cut(marked.select("__id", "__points", "__len", "__prefix", full.alias("__full"), *carry))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Every row's group: id, keep_id, group_size, kept, and the carried columns.

    The row with the most code points in the original text stays, then the smallest id.
    Null text counts as empty; empty and blank texts are equal to each other. A null id loses every tie.
    Rows that repeat an id with an equal text are one document: they count in group_size and all get the
    same decision. An empty table gives an empty result. Other columns of the input are not read.
    """
    narrow = refine(df, id_col, text_col, carry)
    key = ["__len", "__prefix", "__full"]
    hashed = narrow.filter("__full is not null")
    best = F.min(_rank(F.col("__points"), "__id"))
    groups = hashed.groupBy(*key).agg(best.alias("__best"), F.count("*").alias("group_size"))
    grouped = hashed.join(groups, key).withColumn("keep_id", F.col("__best.id"))
    alone = narrow.filter("__full is null").withColumn("group_size", F.lit(1).cast("long")).withColumn("keep_id", F.col("__id"))
    out = ["__id", "keep_id", "group_size", *carry]
    return (
        grouped.select(out)
        .unionByName(alone.select(out))
        .withColumn("kept", F.col("__id").eqNullSafe(F.col("keep_id")))
        .withColumnRenamed("__id", id_col)
        .select(id_col, "keep_id", "group_size", "kept", *carry)
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole and with their own columns; exactly one of each group, even of repeated rows.

    Of copies, the one with the most code points in the original text stays, then the smallest id. Rows
    that no other row shares length and prefix with pass straight through; the rest are reduced to one a group
    by an aggregation that runs on each task before its shuffle, so a hot group moves one row a task. Null, empty and blank texts
    are equal to each other; a row without an id loses every tie. Texts of any length are hashed whole, an empty table gives
    no rows, and columns of the input pass whatever their names: a row travels as one value.
    """
    signed = _signed(df.select(F.struct("*").alias("__row"), F.col(id_col).alias("__of"), text_or_empty(text_col).alias("__text")), "__of", "__text", ["__row"])
    pairs = signed.groupBy("__len", "__prefix").agg(F.count("*").alias("__n"))
    survivors = cut(pairs.filter("__n > 1").select("__len", "__prefix", F.lit(True).alias("__hit")))
    if survivors.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        marked = signed.join(F.broadcast(survivors), ["__len", "__prefix"], "left")
    else:
        marked = signed.withColumn("__hit", F.lit(True))
    alone = marked.filter("__hit is null").select("__row.*")
    order = _rank(F.col("__points"), "__id")
    kept = (
        marked.filter("__hit")
        .select("__len", "__prefix", F.sha2("__norm", 256).alias("__full"), order.alias("__order"), "__row")
        .groupBy("__len", "__prefix", "__full")
        .agg(F.min_by("__row", "__order").alias("__row"))
    )
    return alone.unionByName(kept.select("__row.*"))
