"""Document fingerprints by a threshold-scaled sketch, native throughout.

A document's set holds the hashes (the first 64 bits of MD5, as 16 hex digits) of its distinct shingles of five
words; words are what white space separates, lower-cased, and a text of fewer words is one shingle. A fingerprint
retains every hash below a fixed fraction of the range, whatever the document's length, and the smallest hash at any rate,
so that a text with words is never without. Thus it grows with the document, the fingerprint of a union is made from
the parts' alone, and how much of a short document lies in a very long one can be estimated as well as the likeness of equals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import ASCII_SPACE, cut, text_or_empty

#: Words of a shingle, and the part of all hashes that is retained: one of SCALE.
SHINGLE_WORDS, SCALE = 5, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def limit_of(scale: int) -> str:
    """The hash below which all are retained."""
    if scale < 1:
        raise ValueError("scale must be at least 1")
    return f"{(1 << 64) // scale:016x}" if scale > 1 else "g"


def _retain(hashes: Column, scale: int) -> Column:
    below = lambda h: F.filter(h, lambda x: x < limit_of(scale))
    return _let(hashes, lambda h: _let(below(h), lambda b: F.when(F.size(b) > 0, b).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)))


def fingerprint(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The sorted retained hashes of a text; none for null, empty and blank texts."""
    bare = F.btrim(F.lower(text_or_empty(text)), F.lit(ASCII_SPACE))
    hashes = lambda w: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (words - 1))), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ")), 1, 16)
    )
    listed = lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(_let(F.split(b, r"[\x20\x09-\x0D]+"), hashes))
    return F.array_sort(F.array_distinct(_retain(_let(bare, listed), scale)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The fingerprint of the union of two documents' sets."""
    return F.array_sort(_retain(F.array_union(a, b), scale))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles among all of both, from 0 to 1; of two documents without words 1."""
    both = lambda x, y: F.size(F.array_intersect(x, y))
    return _let(F.struct(a.alias("a"), b.alias("b"), both(a, b).alias("n")), lambda s: F.when((F.size(s.a) == 0) & (F.size(s.b) == 0), 1.0).otherwise(s.n / (F.size(s.a) + F.size(s.b) - s.n)))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has too; 0 where a has none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def merge_groups(df: DataFrame, by: str, column: str, scale: int = SCALE) -> DataFrame:
    """by, hash: the fingerprint of each group's union, one row a hash, as a group's may be too long for one value.

    Hashes that many documents share are made distinct before they are shuffled. Null keys are a group.
    """
    hashes = df.select(F.col(by).alias("by"), F.explode(column).alias("hash")).distinct()
    least = hashes.groupBy("by").agg(F.min("hash").alias("least")).filter(F.col("least") >= limit_of(scale))
    kept = hashes.filter(F.col("hash") < limit_of(scale))
    return kept.unionByName(least.withColumnRenamed("least", "hash")).withColumnRenamed("by", by)


def _half(text: Column) -> Column:
    return F.floor(F.length(text) / 2).cast("int")


def _followers(keys: DataFrame) -> DataFrame:
    """id, h, half and the next row's id and h (after the last: the first's), in ascending order of id, then h.

    The keys are dealt out by ranges and ordered within each; where a range ends the next one's first key follows, which
    is looked up among as many rows as there are ranges.
    """
    placed = cut(keys.repartitionByRange("id", "h").withColumn("range", F.spark_partition_id()))
    key = F.struct("id", "h")
    heads = placed.groupBy("range").agg(F.min(key).alias("head"))
    ranges = Window.orderBy("range")
    first = F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead("head").over(ranges), first).alias("after"))
    inside = F.lead(key).over(Window.partitionBy("range").orderBy("id", "h"))
    return placed.withColumn("inside", inside).join(heads, "range").select("id", "h", "half", F.coalesce("inside", "after").alias("next"))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """id, text, next_print and edited: the text whose last half (floor of code points) is the first as many of the next document.

    The next document is the one with the next id; the last one's is the first, and a single one's is itself. Among rows with the
    same id the texts' hashes decide; rows that repeat id and text are one document and each gets its values. Ids may be null
    (they come first). Only ids, hashes and lengths are ordered; texts move once to meet their place in the order, and of
    each a prefix and the fingerprint once more to the document before it.
    """
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = cut(docs.groupBy("id", "h").agg(F.max(_half(F.col("text"))).alias("half"), F.count("*").alias("copies")))
    before = _followers(keys.drop("copies")).select(F.struct("id", "h").alias("to"), F.col("half").alias("lend"), F.col("next.*"))
    before = cut(before)
    repeated = not keys.filter("copies > 1").isEmpty()
    if repeated:  # repeated rows are summed before they are shuffled, meet as one and part at the end
        docs = docs.groupBy("id", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    same = lambda id_, h: F.col("d.id").eqNullSafe(F.col(id_)) & (F.col("d.h") == F.col(h))
    lent = docs.alias("d").join(before.alias("b"), same("b.id", "b.h")).select("to", F.left("text", "lend").alias("prefix"), fingerprint(F.col("text"), words, scale).alias("next_print"))
    text, half = F.col("d.text"), _half(F.col("d.text"))
    edited = F.concat(F.left(text, F.length(text) - half), F.col("prefix"))
    whole = docs.alias("d").join(lent.alias("l"), same("l.to.id", "l.to.h"))
    whole = whole.select(F.col("d.id").alias("id"), text.alias("text"), edited.alias("edited"), "next_print", *([F.explode(F.sequence(F.lit(1), F.col("d.copies"))).alias("copy")] if repeated else []))
    return whole.drop("copy")


def fingerprint_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_in_doc, doc_in_next of each document.

    See with_next for what the edited text and the next document are. Fingerprints are hashes joined by commas, near_... is the
    likeness and ..._in_... the containment. Null texts count as empty; texts are read whole, however long; texts
    without words have an empty fingerprint. Rows that repeat an id and a text have equal values, repeated texts of other ids equal
    fingerprints. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    met = with_next(df, id_col, text_col, words, scale)
    prints = met.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), words, scale).alias("own"),
        fingerprint(F.col("edited"), words, scale).alias("other"),
        "next_print",
    )
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", ",").alias("fingerprint"),
        F.array_join("other", ",").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_print")).alias("near_next"),
        containment(F.col("next_print"), F.col("own")).alias("next_in_doc"),
        containment(F.col("own"), F.col("next_print")).alias("doc_in_next"),
    )
