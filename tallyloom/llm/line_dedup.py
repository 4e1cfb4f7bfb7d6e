"""Line deduplication by a deletion-neighbourhood join.

Lines within one edit (a character put in, taken out or changed) of an earlier line go, and so do exact repeats; the
earliest stays. Two such lines have a deletion variant in common. Emitting every variant of every line would make
as many rows as there are characters, so what can't have a partner is ruled out first, without losing any:

1. Repeats are summed to distinct lines, named by 128 bits.
2. Of two lines one edit apart, the shorter having L characters, the first or the last L // 2 characters are equal. Lines
   whose halves no other line shares emit nothing.
3. The edit lies in one of SEGMENTS parts of L; what lies before and after it is equal. Parts whose surroundings no other line shares
   go, and parts longer than PART_CHARS are split in the same way again, so a line of any length costs its length times the few
   rounds that it takes. Short parts emit their variants only: itself and every deletion of one character, hashed, as keys.
4. Equal keys meet. Within a key each line needs only the earliest partner, which is an aggregation; the pair is
   verified by its edit distance. So lists of any length make no pairs, and a hot key is summed before its shuffle.

All of it is DataFrame operations of the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import text_or_empty
from tallyloom.sources.scratch import cut

#: Shorter lines (in code points) are dropped only as exact repeats; by default one edit counts at any length.
EDIT_CHARS = 0
#: Parts of a line in which the edit may lie; the length up to which a part emits its variants.
SEGMENTS, PART_CHARS = 8, 64
#: Rows that may be broadcast, of at most about 40 bytes each.
BROADCAST_ROWS = 300_000


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if counted and found small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that may be dropped: doc, no, line, n, h1, h2. Blank ones may not."""
    lines = df.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("no", "line"))
    return lines.filter(F.col("line").rlike("[^ \\x09-\\x0D]")).withColumns({"n": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def _tail(text: Column, size: Column) -> Column:
    """The last so many characters; none for 0."""
    return F.when(size > 0, F.substring(text, -size, size)).otherwise(F.lit(""))


def _half_keys() -> Column:
    """For L = n and L = n - 1: the hashes of L with the first and with the last L // 2 characters."""
    keys = []
    for less in (0, 1):
        size = F.col("n") - less
        half = (size / 2).cast("int")
        keys += [F.xxhash64(size, F.lit("first"), F.substring("line", F.lit(1), half)), F.xxhash64(size, F.lit("last"), _tail(F.col("line"), half))]
    return F.array(*keys)


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(key)


def _split(parts: DataFrame) -> DataFrame:
    """Each part in SEGMENTS parts, with the hash of what lies around it; only those whose surroundings repeat."""
    size = F.ceil(F.col("p") / SEGMENTS).cast("int")
    each = parts.withColumn("p", F.length("part") - F.col("long").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("j"))
    each = each.withColumns({"start": F.least(F.col("j") * size, F.col("p")), "rest": F.greatest(F.lit(0), F.col("p") - (F.col("j") + 1) * size)})
    around = F.xxhash64("around", "j", F.substring("part", F.lit(1), F.col("start")), F.lit("|"), _tail(F.col("part"), F.col("rest")))
    inner = F.substring("part", F.col("start") + 1, F.length("part") - F.col("start") - F.col("rest"))
    split = cut(each.select("h1", "h2", "first", "long", around.alias("around"), inner.alias("part")))
    return split.join(_small(cut(_repeated(split, "around"))), "around")


def _near_earlier(df: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, earlier (the position of the earliest line within one edit that comes before): lines that have one."""
    halves = distinct.select("h1", "h2", F.explode("keys").alias("key"))
    again = cut(_repeated(halves, "key"))
    hopeful = cut(halves.join(_small(again), "key").select("h1", "h2").distinct().join(distinct.select("h1", "h2", "first"), ["h1", "h2"]))
    at = hopeful.select(F.col("first.doc").alias("at_doc"), F.col("first.no").alias("at_no")).distinct()
    texts = _lines(df, id_col, text_col).join(_small(at), F.col("doc").eqNullSafe(F.col("at_doc")) & (F.col("no") == F.col("at_no")), "left_semi").select("h1", "h2", "n", "line")
    lines = cut(texts.dropDuplicates(["h1", "h2"]).join(hopeful, ["h1", "h2"]))

    # the part of the line in which the edit lies, for each length that the shorter of a pair may have
    of_length = lines.select("h1", "h2", "first", "line", "n", F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("l"))
    met = cut(_split(of_length.select("h1", "h2", "first", (F.col("n") > F.col("l")).alias("long"), F.xxhash64("l").alias("around"), F.col("line").alias("part"))))
    too_long = F.length("part") - F.col("long").cast("int") > PART_CHARS
    done, met = met.filter(~too_long), met.filter(too_long)
    while not met.isEmpty():
        met = cut(_split(met))
        done, met = done.unionByName(met.filter(~too_long)), met.filter(too_long)
    met = done

    # variants: of the shorter its part as it is, and with its deletions by place; of the longer its deletions
    deleted = lambda i: F.concat(F.substring("part", F.lit(1), i), F.substring("part", i + 2, F.length("part")))
    places = F.when(F.length("part") > 0, F.sequence(F.lit(0), F.length("part") - 1)).otherwise(F.array().cast("array<int>"))
    own = F.array(F.xxhash64(F.lit("put in"), "part"))
    changed = F.transform(places, lambda i: F.xxhash64(F.lit("changed"), i, deleted(i)))
    taken = F.transform(places, lambda i: F.xxhash64(F.lit("put in"), deleted(i)))
    variants = met.select("around", "h1", "h2", "first", "long", "part", F.explode(F.when(F.col("long"), F.array_distinct(taken)).otherwise(F.concat(own, changed))).alias("variant"))
    key = ["around", "variant"]
    found = F.struct("first", "part")
    best = variants.groupBy(*key).agg(
        F.count("*").alias("c"), F.min(F.when(F.col("long"), found)).alias("of_long"), F.min(F.when(~F.col("long"), found)).alias("of_short")
    )
    # a longer line's partner is the shorter; a shorter line's is the earliest other, longer or of its length
    partner = F.when(F.col("long"), F.col("of_short")).otherwise(F.least("of_long", "of_short"))
    pairs = variants.join(best.filter("c > 1"), key).withColumn("partner", partner).filter("partner.first < first")
    close = F.levenshtein(F.col("part"), F.col("partner.part"), 1).between(0, 1)
    return pairs.filter(close).groupBy("h1", "h2").agg(F.min("partner.first").alias("earlier"))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """Every line to drop: id, line_no (from 0), earlier_id, earlier_no (the earliest line that it repeats).

    Lines are what lies between line feeds; their order is that of (id, line_no), with rows without an id first. A line goes if it
    equals an earlier line or, with edits=1, lies one edit from one, whether that one stays or not; of two lines one edit apart both must
    have edit_chars code points. Blank lines stay, and so does the empty line that a null or empty text has. Rows that repeat an id, and
    rows without one, share positions: equal lines there count as the same occurrence, so a line is dropped from all of them or
    none. Lines of any length are compared whole. An empty table gives no rows.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    lines = _lines(df, id_col, text_col)
    keys = F.when(F.col("n") >= edit_chars, _half_keys()) if edits else F.lit(None).cast("array<bigint>")
    seen = lines.select("doc", "no", "h1", "h2", keys.alias("keys"))
    distinct = cut(seen.groupBy("h1", "h2").agg(F.min(F.struct("doc", "no")).alias("first"), F.max(F.struct("doc", "no")).alias("last"), F.first("keys").alias("keys")))
    doomed = distinct.filter("not (first <=> last)").select("h1", "h2", "first")
    if edits:
        near = cut(_near_earlier(df, distinct.filter("keys is not null"), id_col, text_col))
        both = doomed.select("h1", "h2").unionByName(near.select("h1", "h2")).distinct()
        doomed = both.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]).join(near, ["h1", "h2"], "left")
    else:
        doomed = doomed.withColumn("earlier", F.lit(None).cast(distinct.schema["first"].dataType))
    at = lines.select("doc", "no", "h1", "h2").join(_small(cut(doomed)), ["h1", "h2"])
    gone = at.filter("earlier is not null or not (doc <=> first.doc and no = first.no)").withColumn("of", F.least("earlier", "first"))
    return gone.select(F.col("doc").alias(id_col), F.col("no").alias("line_no"), F.col("of.doc").alias("earlier_id"), F.col("of.no").alias("earlier_no")).distinct()


def _dropped(df: DataFrame, id_col: str, text_col: str, edits: int) -> DataFrame:
    """The numbers of each document's dropped lines: __doc, __gone."""
    return repeated_lines(df, id_col, text_col, edits).groupBy(F.col(id_col).alias("__doc")).agg(F.sort_array(F.collect_set("line_no")).alias("__gone"))


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """One row a document: id, n_lines, n_dropped, dropped (the numbers of its dropped lines, joined by commas)."""
    docs = df.select(id_col, F.size(F.split(text_or_empty(text_col), "\n")).cast("long").alias("n_lines"))
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    return docs.join(_dropped(df, id_col, text_col, edits), F.col(id_col).eqNullSafe(F.col("__doc")), "left").select(
        id_col, "n_lines", F.size(gone).cast("long").alias("n_dropped"), F.array_join(gone.cast("array<string>"), ",").alias("dropped")
    )


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1) -> DataFrame:
    """The rows with their texts rid of repeated lines; null texts stay null.

    Which lines go is as in repeated_lines, where ties, repeated ids, rows without one, blank and very long lines are described. An empty table
    gives no rows, and columns of the input pass whatever their names.
    """
    gone = cut(_dropped(df, id_col, text_col, edits))
    rows = df.select(F.struct("*").alias("__row"), F.col(id_col).alias("__of"), F.col(text_col).alias("__text"))
    whole = rows.join(gone, F.col("__of").eqNullSafe(F.col("__doc")), "left")
    kept = F.array_join(F.filter(F.split("__text", "\n"), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    fields = [F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept).alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in df.columns]
    return whole.select(*fields)
