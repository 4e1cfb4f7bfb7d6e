"""Near-duplicate documents by bottom-k sketches.

A document's set holds the hashes of its five-word shingles, all by one hash function. Documents with equal sets
form a class; only one row of a class goes on. A class keeps the k smallest hashes of its set. Inverted lists of the
smallest of these generate pairs with the number of values they share; the sketch of the pair's union estimates
their similarity and filters; the exact similarity of the full sets verifies. Linked classes are joined to components.

Values that very many classes retain (shared passages) would make lists whose pairs grow with the square. They
are left out of the lists, and this loses nothing for a class most of whose retained values are rarer. Classes of which a
large part is such passages (large groups of near copies) are handled exactly in another way, see _hot_pairs.

Chance: a pair exactly at the limit is overlooked when the lists have no two of its values in common, or when its
estimate falls short by 0.29; both are below one in a million at limits from 0.80 on (which values go into the lists depends on
the limit, see list_bounds), and a pair counts only if nothing else connects its ends.
Everything else is exact. The full sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm._shared import give_back, map_batches, small, text_or_empty
from tallyloom.operators.graph import components
from tallyloom.sources.scratch import cut

#: Words of a shingle; retained hashes of a set; those of them whose lists generate pairs; the longest such list.
SHINGLE_WORDS, SKETCH, KEYS, HOT = 5, 64, 24, 48
#: The chance that a pair at the limit may be overlooked with.
CHANCE = 1e-6
#: How far below the similarity the estimate of 64 values may lie.
ESTIMATE_MARGIN = 0.29
#: Members of a long list that meet its centre in one task; the share of common members from which on one long list takes in another.
SPLIT, SAME = 256, 0.75
#: Members of a long list that its centre and the order of its elements are taken from.
CENTRE = 32
#: Ids that may be broadcast to fetch the full sets of candidates.
BROADCAST_IDS = 2_000_000
_WORDS_KEPT = 300_000


def list_bounds(t: float, chance: float = CHANCE) -> tuple[int, int]:
    """(hot values of a class beyond which the lists of its others don't suffice, lists of hot values that it then takes part in).

    Of the KEYS smallest values of a pair's union, both sides retain each one with probability t. Two must be left beside
    the hot ones of a class with few; of the first hot ones of two classes with many, one must be common.
    """
    at_most = np.cumsum([math.comb(KEYS, i) * t**i * (1 - t) ** (KEYS - i) for i in range(KEYS + 1)])
    few = int((at_most < chance).sum()) - 2
    many = 1 if t >= 1 else math.ceil(math.log(chance) / math.log(1 - t))
    return max(0, few), min(many, KEYS)


class Shingler:
    """Hashes of shingles: words are hashed once and remembered, shingles mixed from their words' hashes."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}
        rng = np.random.default_rng(20_240_501)
        self.odd = rng.integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _hash(self, word: bytes) -> int:
        value = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def hashes(self, text: str) -> np.ndarray:
        """The sorted distinct hashes of a text's set; empty without words."""
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D split
        if not words:
            return np.empty(0, np.int64)
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        get, make = self.known.get, self._hash
        h = np.array([get(w) or make(w) for w in words], np.uint64)
        n = max(1, len(h) - self.words + 1)
        if len(h) < self.words:  # the whole sequence is the one member; its length keeps it apart from longer ones
            h = np.concatenate([h, np.full(self.words - len(h), len(h), np.uint64)])
        mixed = np.zeros(n, np.uint64)
        for i in range(self.words):
            mixed += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * self.odd[i]
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketches(df: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS, keep: int = SKETCH) -> DataFrame:
    """__id, n (size of the set), k1, k2 (128 bits that name the set), sketch (its smallest hashes, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in small(batches):
            sets = [shingler.hashes(t) for t in batch.column(1).to_pylist()]
            names = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), _lists([s[:keep] for s in sets])],
                ["__id", "n", "k1", "k2", "sketch"],
            )
        del shingler
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("__id"), text_or_empty(text_col)), run, f"__id {kind}, n long, k1 long, k2 long, sketch array<long>")


def _full_sets(df: DataFrame, id_col: str, text_col: str, ids: DataFrame, words: int) -> DataFrame:
    """rep, shingles: the full sets of the documents in ids, read from their texts again."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = df.select(F.col(id_col).alias("rep"), text_or_empty(text_col).alias("t")).join(F.broadcast(ids) if few else ids, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in small(batches):
            yield pa.record_batch([batch.column(0), _lists([shingler.hashes(t) for t in batch.column(1).to_pylist()])], ["rep", "shingles"])
        del shingler
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    found = map_batches(wanted, run, f"rep {kind}, shingles array<long>")
    return found.groupBy("rep").agg(F.max_by("shingles", F.struct(F.size("shingles"), F.xxhash64("shingles"))).alias("shingles"))


def _pairs_in_lists(posts: DataFrame, percent: int, shared: int) -> DataFrame:
    """(a, b) with a < b and sizes that allow the similarity, in at least so many lists together. Lists are short."""
    left = posts.select("value", F.col("rep").alias("a"), F.col("n").alias("na"))
    right = posts.select("value", F.col("rep").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, "value").filter(f"a < b and 100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    return met.groupBy("a", "b").agg(F.count("*").alias("c")).filter(f"c >= {shared}").select("a", "b")


def _one_for_many(lists: DataFrame) -> DataFrame:
    """(value, rep, m) of fewer long lists: one takes in the members of those that have nearly the same members.

    A group of near copies has as many such lists as a class takes part in. Two members of one list are members of the list
    that takes it in too, so no meeting is lost.
    """
    own = lists.groupBy("rep").agg(F.collect_list(F.struct("m", "value")).alias("v"))
    both = own.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    into = both.filter(F.col("both") >= SAME * F.col("b.m")).groupBy("a.value").agg(F.max("b").alias("into"))
    moved = cut(lists.join(into, "value", "left").select(F.coalesce("into.value", "value").alias("value"), "rep").distinct())
    return moved.join(moved.groupBy("value").agg(F.count("*").alias("m")), "value").select("value", "rep", "m")


def _dealt(side: DataFrame) -> DataFrame:
    """One row a list with its size m, once for each of the parts that the list's members are dealt to."""
    return side.select("*", F.explode(F.sequence(F.lit(0), (F.col("m") / SPLIT).cast("int"))).alias("part"))


def _centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(value, m, centre, common) of each long list: what most of CENTRE members have, by a hash; and that with what else two of them have,
    in the order in which members differ from the centre in it, from few to many. Nothing is decided by these members: any centre and any order give
    the same pairs, and these give short inverted lists."""
    turn = F.row_number().over(Window.partitionBy("value").orderBy(F.xxhash64("value", "rep"), "rep"))
    chosen = members.select("value", "m", "rep").withColumn("turn", turn).filter(f"turn <= {CENTRE}")

    def run(table: pa.Table) -> pa.Table:
        hashes, counts = np.unique(table.column("shingles").combine_chunks().flatten().to_numpy(), return_counts=True)
        have = 2 * counts > table.num_rows
        often = (counts > 1) | have
        differ = np.where(have, table.num_rows - counts, counts)[often]
        common = hashes[often][np.argsort(differ, kind="stable")]
        return pa.table([table.column("value")[:1], table.column("m")[:1], _lists([hashes[have]]), _lists([common])], ["value", "m", "centre", "common"])

    return cut(chosen.join(sets, "rep").select("value", "m", "shingles").groupBy("value").applyInArrow(run, "value long, m long, centre array<long>, common array<long>"))


def _difference(a: str, b: str) -> Column:
    """The elements of two sets that only one of them has."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _of_element(counted: Column) -> Column:
    """An aggregate of one element's entries in one list, beside each of them: joining the counts to the entries would make each row again."""
    return counted.over(Window.partitionBy("value", "s"))


def _within_reach(ranked: DataFrame, more: int) -> DataFrame:
    """Drops entries of inverted lists that can't meet a partner: what is left of them is less than they have to share
    with the member of their list that asks for least."""
    asked = _of_element(F.min(F.when(F.col("stray"), F.col("x"))))
    lists = ranked.select("*", _of_element(F.count("*")).alias("c"), _of_element(F.min("x")).alias("any"), asked.alias("strays")).filter("c > 1 and strays is not null")
    partner = F.when(F.col("stray"), F.col("any")).otherwise(F.col("strays"))
    return lists.filter(2 * more * F.col("left") >= F.col("x") + partner).select(ranked.columns)


def _hot_pairs(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links and further candidates within long lists without their pairs, and shorter lists that are left to do.

    members: (value, rep, m) of long lists of m members; sets: (rep, shingles). Per list, L is a set of hashes, any one (see _centres).
    With D(X) the symmetric difference of X and L, two members are similar exactly if |D(X) ^ D(Y)| <= h * (|X| + |Y|),
    h = (1 - t) / (1 + t). Let x(X) = |D(X)| - h * |X|. If x(X) + x(Y) <= 0 the two are certainly similar, so all
    X with x(X) <= -min x are linked to the member with the least x: one star. Any other member X, if it is similar to some Y,
    shares at least (x(X) + x(Y)) / 2 > 0 elements of D(Y) with it, and at least x(X) - h * |Y|, as Y is then about as far from L as X; so in one order of
    the elements the two meet within the first |D| minus that bound plus 1 of both. X has at most (1 - t) * |X| hashes that Y lacks, so where
    more of X's stand before all others, that many plus 1 are enough. Only these become entries: a share of a member's size, however far from L
    it is. Elements that the members behind L don't share come first, then the others from rare to frequent, so the inverted lists are short,
    and entries with too little left to meet anyone leave them. Short ones give their pairs as candidates. In a long one all members
    share an element that few have, so it is a shorter list of the same kind, around a centre of its own (an element of all members is
    in L, if they share it, or in no D), and goes the same way in the next round. No pair is lost. x is
    held times 100 + percent, in whole numbers, so that members exactly at the limit are on the right side of it.
    """
    more, less = 100 + percent, 100 - percent  # h = less / more
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), (F.col("m") / SPLIT).cast("int") + 1).cast("int"))
    centres = _dealt(_centres(members, sets))
    offset = (
        members.join(sets, "rep")
        .join(centres.drop("m"), ["value", "part"])
        .select("value", "rep", "m", "part", F.size("shingles").alias("n"), _difference("shingles", "centre").alias("e"), "common")
        .withColumn("rare", F.array_sort(F.array_except("e", "common")))  # hashes, so their own order is a random one
        .select("value", "rep", "m", "part", "n", F.size("rare").alias("fresh"), F.concat("rare", F.array_intersect("common", "e")).alias("e"))
        .withColumn("d", F.size("e"))
        .withColumn("x", more * F.col("d").cast("long") - less * F.col("n"))
    )
    offset = cut(offset)
    near = cut(offset.groupBy("value", "m").agg(F.min(F.struct("x", "rep")).alias("best"), F.max("x").alias("worst")))
    placed = offset.join(_dealt(near).drop("m"), ["value", "part"]).withColumn("stray", F.col("x") + F.col("best.x") > 0)
    links = placed.filter("not stray").select(F.col("best.rep").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    # the least share that any pair of a stray and this member must have: of a stray, with the best; of another, with the least stray
    least = F.when(F.col("stray"), F.col("x") + F.col("best.x")).otherwise(F.col("x") - F.col("best.x"))
    most = F.floor(100 * F.col("n") / percent)  # of a partner's size
    need = F.greatest(F.lit(1), F.ceil(least / (2 * more)), F.ceil((F.col("x") - less * most) / more)).cast("int")
    own = F.floor((100 - percent) * F.col("n") / 100) + 1
    prefix = F.least(F.col("d") - need + 1, F.when(F.col("fresh") >= own, own)).cast("int")
    short = placed.filter("worst + best.x > 0").withColumn("prefix", prefix).filter("prefix > 0")
    tasks = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the members of a list came from few tasks
    first = short.select("value", "rep", "n", "stray", "x", "d", F.slice("e", F.lit(1), F.col("prefix")).alias("e")).repartition(tasks)
    each = first.select("value", "rep", "n", "stray", "x", "d", F.posexplode("e").alias("i", "s"))
    listed = each.select("*", _of_element(F.count("*")).alias("df"), _of_element(F.max("stray")).alias("asked")).filter("df > 1 and asked")
    ranked = cut(listed.select("value", "rep", "n", "stray", "x", (F.col("d") - F.col("i")).alias("left"), "s"))
    for _ in range(2):
        ranked = cut(_within_reach(ranked, more))
    key = ["value", "s"]
    entries = cut(ranked.select("*", _of_element(F.count("*")).alias("c")).filter("c > 1"))
    pairs = entries.filter(f"c <= {HOT}")
    one = pairs.filter("stray").select(*key, F.col("rep").alias("p"), F.col("n").alias("np"), F.col("x").alias("xp"), F.col("left").alias("lp"))
    other = pairs.select(*key, F.col("rep").alias("q"), F.col("n").alias("nq"), F.col("x").alias("xq"), F.col("left").alias("lq"))
    # at the first element that two share, what is left of either (itself included) must hold all that they have to share
    room = f"{2 * more} * least(lp, lq) >= xp + xq"
    met = one.join(other, key).filter(f"p <> q and 100 * np >= {percent} * nq and 100 * nq >= {percent} * np and {room}")
    longer = entries.filter(f"c > {HOT}").select(F.xxhash64(*key).alias("value"), "rep", F.col("c").alias("m"))
    return links, met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), longer


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").withColumn("both", both).filter(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = SHINGLE_WORDS) -> DataFrame:
    """Every document's group: id, n_shingles, component_id (the smallest id it is linked to), kept (it is that one).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of shingles of lower-cased (A-Z)
    words; groups are the connected components. A text of fewer words than a shingle counts as one shingle. Null, empty and
    blank texts have no set and are linked with nothing. Rows that repeat an id are one document and get the same result if
    their texts are equal; of an id with different texts the larger set is verified. Rows without an id get the component of the documents
    with equal sets, and are not kept beside them; those without such documents are linked with nothing and kept. Texts of any length
    are read whole. An empty table gives an empty result. Other columns are not read.
    """
    t = percent / 100
    few, many = list_bounds(t)
    docs = cut(sketches(df, id_col, text_col, words))
    classes = cut(docs.filter("n > 0").groupBy("k1", "k2").agg(F.min("__id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    posts = classes.filter("rep is not null").select("rep", "n", F.explode(F.slice("sketch", 1, KEYS)).alias("value"))
    lengths = cut(posts.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1"))
    cold = posts.join(lengths.filter(f"c <= {HOT}"), "value").select("value", "rep", "n")
    hot = cut(posts.join(lengths.filter(f"c > {HOT}"), "value").select("value", "rep", "n"))
    share = hot.groupBy("rep").agg(F.count("*").alias("h"), F.first("n").alias("n")).filter(KEYS * F.col("h") > few * F.least("n", F.lit(KEYS)))
    laden = hot.join(share.select("rep"), "rep").groupBy("rep", "n").agg(F.sort_array(F.collect_list("value")).alias("v"))
    laden = cut(laden.select("rep", "n", F.explode(F.slice("v", 1, many)).alias("value")))
    long = laden.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    short_lists = laden.join(long.filter(f"c <= {HOT}"), "value").select("value", "rep", "n")
    long_lists = cut(_one_for_many(cut(laden.join(long.filter(f"c > {HOT}"), "value").select("value", "rep", F.col("c").alias("m")))))

    pairs = _pairs_in_lists(cold, percent, 2).unionByName(_pairs_in_lists(short_lists, percent, 1)).distinct()
    a = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    met = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    likely = cut(pairs.join(a, "a").join(b, "b").select("a", "b", (met / F.size(union)).alias("estimate")).filter(F.col("estimate") >= t - ESTIMATE_MARGIN))

    ids = likely.select(F.col("a").alias("rep")).union(likely.select("b")).union(long_lists.select("rep")).distinct()
    sets = cut(_full_sets(df, id_col, text_col, cut(ids), words))
    star = likely.select("a", "b").limit(0)
    while not long_lists.isEmpty():  # each round's lists are shorter than those before, nearly always at most half as long
        links, more, longer = _hot_pairs(long_lists, sets, percent)
        star, likely = star.unionByName(cut(links)), likely.unionByName(cut(more).withColumn("estimate", F.lit(0.0)))
        long_lists = cut(longer)

    # first each class's likeliest pair: it joins most groups; then only what would join groups that are still apart
    best = likely.groupBy("a").agg(F.max_by("b", "estimate").alias("b"))
    edges = cut(_verify(best, sets, percent).unionByName(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    joined = components(edges)
    group = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"g{side}"))
    apart = likely.join(group("a"), "a", "left").join(group("b"), "b", "left").filter("ga is null or gb is null or ga <> gb")
    edges = edges.unionByName(_verify(apart.select("a", "b").distinct(), sets, percent))
    whole = cut(components(edges))

    named = classes.select("k1", "k2", "rep").join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    narrow = docs.select("__id", "n", "k1", "k2")
    found = narrow.filter("n > 0").join(named, ["k1", "k2"]).unionByName(narrow.filter("n = 0").withColumn("component_id", F.col("__id")))
    return found.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of documents that stay: one of each group, the one with the smallest id.

    Null, empty and blank texts are near to nothing and stay. Rows that repeat an id stay or go together; rows without an id stay.
    Texts of any length are read whole, an empty table gives no rows, and columns of the input pass whatever their names.
    """
    gone = cut(near_groups(df, id_col, text_col, percent).filter("not kept").select(F.col(id_col).alias("id")))
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.alias("all").join(gone.alias("gone"), F.col(f"all.{id_col}") == F.col("gone.id"), "left_anti")
