"""Distributional priors over a long table of spans (book, pos, cell, p): mass, floors, cross-entropy, folds and permutations.

Everything that leaves one group out is total minus own, so no join pairs each group with all others. Cells are few, so
windows over the cells of a group stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numeric import FLOOR, PPM, entropy_term, pearson


def accumulate(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, cell, mass): summed probability."""
    return spans.groupBy(*keys, "cell").agg(F.sum("p").alias("mass"))


def normalise(mass: DataFrame, *keys: str, value: str = "mass", out: str = "q") -> DataFrame:
    """Adds out: the share of its group's mass, at least FLOOR, made to sum to 1; uniform for a group without mass."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.sum(value).over(group)
    floored = mass.withColumn("__t", total).withColumn("__f", F.when(F.col("__t") > 0, F.greatest(F.col(value) / F.when(F.col("__t") > 0, F.col("__t")).otherwise(1.0), F.lit(FLOOR))).otherwise(F.lit(1.0)))
    return floored.withColumn(out, F.col("__f") / F.sum("__f").over(group)).drop("__t", "__f")


def surprise(spans: DataFrame, prior: DataFrame, on: Sequence[str], span: Sequence[str] = ("book", "pos")) -> DataFrame:
    """(span, keys of on, bits): -sum p * log2(q) over cells with p > 0."""
    keys = list(dict.fromkeys([*span, *[k for k in on if k != "cell"]]))
    met = spans.join(F.broadcast(prior) if list(on) == ["cell"] else prior, list(on))
    return met.groupBy(*keys).agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("q")).otherwise(0.0)).alias("bits"))


def entropy_of(prior: DataFrame, *keys: str) -> DataFrame:
    return prior.groupBy(*keys).agg(F.sum(entropy_term(F.col("q"))).alias("entropy"))


def restrict(spans: DataFrame, keep: Column, cells_kept: int, span: Sequence[str] = ("book", "pos")) -> DataFrame:
    """The spans over fewer cells, made to sum to 1 again; uniform where nothing is left."""
    group = Window.partitionBy(*span)
    total = F.sum("p").over(group)
    return spans.filter(keep).withColumn("__t", total).withColumn("p", F.when(F.col("__t") > 0, F.col("p") / F.when(F.col("__t") > 0, F.col("__t")).otherwise(1.0)).otherwise(F.lit(1.0 / cells_kept))).drop("__t")


def leave_one_out(mass: DataFrame, key: str) -> DataFrame:
    """(key, cell, mass of all other groups)."""
    return mass.select(key, "cell", (F.sum("mass").over(Window.partitionBy("cell")) - F.col("mass")).alias("mass"))


def exact_ppm(prior: DataFrame, *keys: str, order: str = "cell") -> DataFrame:
    """Adds ppm: the largest remainders are rounded up until a group sums to exactly a million; ties go by order."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    raw = prior.withColumn("__r", F.col("q") * PPM).withColumn("__f", F.floor("__r").cast("long"))
    rank = F.row_number().over(group.orderBy(F.round(F.col("__r") - F.col("__f"), 9).desc(), order))
    left = F.lit(PPM) - F.sum("__f").over(group)
    return raw.withColumn("ppm", F.col("__f") + F.when(rank <= left, 1).otherwise(0)).drop("__r", "__f")


def correlations(mass: DataFrame, key: str, value: str = "mass") -> DataFrame:
    """(a, b, corr) for a < b: correlation of two groups' values over the cells, 0 for a constant one.

    A join on the cell with partial sums; the number of pairs is what is asked for.
    """
    left = mass.select(F.col(key).alias("a"), "cell", F.col(value).alias("x"))
    right = mass.select(F.col(key).alias("b"), "cell", F.col(value).alias("y"))
    sums = left.join(right, "cell").filter("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    return sums.select("a", "b", pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("corr"))


def gap(pairs: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """(by, gap): mean correlation of pairs with one label minus that of pairs with two; 0 for a side without pairs.

    pairs: (a, b, corr); labels: (by, book, label).
    """
    a = labels.select(*by, F.col("book").alias("a"), F.col("label").alias("la"))
    b = labels.select(*by, F.col("book").alias("b"), F.col("label").alias("lb"))
    met = pairs.join(a, "a").join(b, [*by, "b"])
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("corr"))), F.lit(0.0))
    same = F.col("la") == F.col("lb")
    return (met.groupBy(*by) if by else met.groupBy()).agg((mean(same) - mean(~same)).alias("gap"))


def standardised(mass: DataFrame, *keys: str, value: str = "mass") -> DataFrame:
    """(keys, z): each group's values over the cells, centred and made to length 1, zeros for a constant one; the product of two groups' z
    is their correlation."""
    cells = F.sort_array(F.collect_list(F.struct("cell", F.col(value).alias("x"))))
    held = mass.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), cells.alias("cells"))
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    flat = (F.col("n") < 2) | (spread <= 1e-15)
    length = F.sqrt(F.when(flat, F.lit(1.0)).otherwise(spread))
    return held.select(*keys, F.transform("cells", lambda c: F.when(flat, F.lit(0.0)).otherwise((c.x - F.col("mean")) / length)).alias("z"))


def label_gaps(standard: DataFrame, labels: DataFrame, key: str, *by: str) -> DataFrame:
    """(by, gap): mean correlation of pairs of groups with one label minus that of pairs with two; 0 for a side without pairs.

    standard: (key, z and perhaps columns of by); labels: (key, label and perhaps columns of by). No pairs are made: the products of
    all pairs of a label are half of what the square of its sum is above the sum of its squares.
    """
    each = standard.join(labels, key).select(*by, "label", F.posexplode("z").alias("cell", "z"))
    sums = each.groupBy(*by, "label", "cell").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"), F.count("*").alias("c"))
    pairs = lambda n: n * (n - 1) / 2
    cells = sums.groupBy(*by, "cell").agg(
        F.sum(F.col("s") * F.col("s")).alias("same"), F.pow(F.sum("s"), 2).alias("whole"), F.sum("q").alias("q"), F.sum(pairs(F.col("c"))).alias("n_same"), pairs(F.sum("c")).alias("n_all")
    )
    held = (cells.groupBy(*by) if by else cells.groupBy()).agg(*[F.sum(c).alias(c) for c in ("same", "whole", "q")], F.max("n_same").alias("n_same"), F.max("n_all").alias("n_all"))
    same, whole = (F.col("same") - F.col("q")) / 2, (F.col("whole") - F.col("q")) / 2
    mean = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    return held.select(*by, (mean(same, F.col("n_same")) - mean(whole - same, F.col("n_all") - F.col("n_same"))).alias("gap"))


def shuffled_labels(labels: DataFrame, rounds: int) -> DataFrame:
    """(perm, book, label): in each round the labels are dealt anew, in the order of an MD5 of round and book."""
    by_book = labels.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("perm"))
    place = F.row_number().over(Window.partitionBy("perm").orderBy("book"))
    dealt = F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.col("perm").cast("string"), F.col("book").cast("string"))), "book"))
    seats = by_book.select("perm", "book", place.alias("i"))
    given = by_book.select("perm", "label", dealt.alias("i"))
    return seats.join(given, ["perm", "i"]).select("perm", "book", "label")


def permutation_p(observed: DataFrame, shuffled: DataFrame, rounds: int, *by: str) -> DataFrame:
    """(by, gap, at_least, p_value) with p = (rounds that reach the observed gap + 1) / (rounds + 1)."""
    rounds_of = shuffled.select(*by, F.col("gap").alias("g"))
    met = rounds_of.join(F.broadcast(observed), list(by)) if by else rounds_of.crossJoin(F.broadcast(observed))  # one row, or one for each of a few channels
    return met.groupBy(*by, "gap").agg(F.sum(F.when(F.col("g") >= F.col("gap") - 1e-12, 1).otherwise(0)).alias("at_least")).withColumn("p_value", (F.col("at_least") + 1) / F.lit(rounds + 1))


def nearest_prior(mass: DataFrame, pairs: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """(key, k, cell, mass): for each group the summed mass of its k most correlated others; k = 0 means all.

    One running sum over the rank serves every k.
    """
    both = pairs.select(F.col("a").alias("held"), F.col("b").alias("other"), "corr").unionByName(pairs.select(F.col("b").alias("held"), F.col("a").alias("other"), "corr"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("held").orderBy(F.round("corr", 9).desc(), "other")))
    met = ranked.join(mass.select(F.col(key).alias("other"), "cell", "mass"), "other")
    running = met.withColumn("mass", F.sum("mass").over(Window.partitionBy("held", "cell").orderBy("r"))).withColumn("last", F.max("r").over(Window.partitionBy("held")))
    wanted = F.explode(F.array(*[F.lit(k) for k in ks]))
    return running.select(F.col("held").alias(key), "cell", "mass", "r", "last", wanted.alias("k")).filter((F.col("r") == F.col("k")) | ((F.col("k") == 0) & (F.col("r") == F.col("last")))).drop("r", "last")


def expanding(spans: DataFrame) -> DataFrame:
    """Adds seen (mass of the cell in the book's earlier spans) and seen_all (their total): predict, then observe."""
    before = Window.partitionBy("book", "cell").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.withColumn("seen", F.coalesce(F.sum("p").over(before), F.lit(0.0)))
    return seen.withColumn("seen_all", F.sum("seen").over(Window.partitionBy("book", "pos")))


def blend(seen: DataFrame, alpha: Column) -> DataFrame:
    """Adds q: (seen + alpha * prior) / (seen_all + alpha); expects a column prior."""
    return seen.withColumn("q", (F.col("seen") + alpha * F.col("prior")) / (F.col("seen_all") + alpha))
