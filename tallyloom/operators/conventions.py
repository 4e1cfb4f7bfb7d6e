"""Conventions: what a reader holds about tokens, kind by kind, and how the stream confirms or strains it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import norm_token
from tallyloom.sources.scratch import cut

PRIOR_SUPPORT = 3
ENTRY = "kind string, token string, origin string, weight long, support long, strain long, defeated boolean"
OPS = ("learn", "hold", "break", "defeat", "reinstate", "reinforce")


def seed(spark: SparkSession, registers: dict[str, list[str]]) -> DataFrame:
    """Entries of given registers, with the support of a prior."""
    rows = [(k, t, "prior", 0, PRIOR_SUPPORT, 0, False) for k, ts in registers.items() for t in dict.fromkeys(ts)]
    return spark.createDataFrame(rows, ENTRY)


def inherit(entries: DataFrame) -> DataFrame:
    """Another ledger's entries as priors: defeated ones stay behind, strain starts anew."""
    support = F.when(F.coalesce("support", F.lit(0)) == 0, PRIOR_SUPPORT).otherwise(F.col("support")).cast("long")
    return entries.filter(~F.coalesce("defeated", F.lit(False))).select(
        "kind", norm_token(F.col("token")).alias("token"), F.lit("prior").alias("origin"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"), support.alias("support"), F.lit(0).cast("long").alias("strain"), F.lit(False).alias("defeated")
    )


def sediment(induced: DataFrame, shelf: str) -> DataFrame:
    """Induced registers (register, token, weight) as entries with the shelf that taught them; they have the support of a prior, as seeds do."""
    entry = induced.select(F.col("register").alias("kind"), norm_token(F.col("token")).alias("token"), F.lit("prior").alias("origin"), F.lit(0).cast("long").alias("weight"))
    held = entry.distinct().withColumns({"support": F.lit(PRIOR_SUPPORT).cast("long"), "strain": F.lit(0).cast("long"), "defeated": F.lit(False)})
    return held.withColumn("shelf", F.lit(shelf))


def overlay(seeds: DataFrame, learned: DataFrame) -> DataFrame:
    """Seed entries with each register that sediment has replaced by it; registers that only seeds have stay, those that only sediment has don't
    come in, as no question was seeded for them. Entries of seeds have no shelf."""
    kinds = F.broadcast(learned.select("kind").distinct())  # as many rows as there are registers
    kept = seeds.join(kinds, "kind", "left_anti").withColumn("shelf", F.lit(None).cast("string"))
    return kept.unionByName(learned.join(F.broadcast(seeds.select("kind").distinct()), "kind", "left_semi"))


def corpus_relations(verbs: DataFrame, least: int = 4, cap: int = 50) -> DataFrame:
    """Relation verbs (via, count) of a corpus as entries, their support the count up to a cap."""
    kept = verbs.filter(F.col("via").isNotNull() & (F.col("via") != "") & (F.col("count") >= least))
    return inherit(kept.select(F.lit("relation").alias("kind"), F.col("via").alias("token"), F.lit(0).alias("weight"), F.least("count", F.lit(cap)).alias("support"), F.lit(False).alias("defeated")))


def apply_op(entry: dict | None, op: str, weight: int = 1) -> dict:
    """One step of an entry. Holding mends strain; a break strains; strain over support defeats; learning restores."""
    e = dict(entry) if entry else {"origin": "learned", "weight": 0, "support": 0, "strain": 0, "defeated": False}
    if op == "learn":
        e |= {"origin": "learned", "weight": e["weight"] + weight, "support": e["support"] + weight, "defeated": False}
    elif op == "hold":
        e |= {"support": e["support"] + 1, "strain": max(0, e["strain"] - 1)}
    elif op == "break":
        e["strain"] += 1
    elif op == "defeat":
        e["defeated"] = True
    elif op == "reinstate":
        e |= {"defeated": False, "strain": 0}
    elif op == "reinforce":
        e["support"] += 1
    if op in ("hold", "break") and e["strain"] > e["support"]:
        e["defeated"] = True
    return e


def fold_log(log: DataFrame, priors: DataFrame) -> DataFrame:
    """The entries after a log (kind, token, pos, op, weight), from priors: what apply_op gives step by step in the order of pos.

    Weight and support are running sums. Strain is a walk that holds lower to 0 at least and reinstating sets to 0, so it is a running sum less
    its lowest value since. An entry is defeated or not by the last step that says so. The log is dealt by ranges of token and pos, so a hot
    token lies in many chunks: each chunk's walk is summed to one map, s -> max(s + a, b) or a constant, the maps of a token's chunks are
    composed by running sums over them, and with what enters each chunk its steps are walked by themselves. Rows without an op that
    is known change nothing. Tokens are normalised; an empty log gives the priors.
    """
    keys = ["kind", "token"]
    op, one = F.col("op"), F.lit(1).cast("long")
    steps = log.select("kind", norm_token(F.col("token")).alias("token"), "pos", "op", F.coalesce("weight", one).cast("long").alias("weight"))
    zero = F.lit(0).cast("long")
    steps = steps.withColumns({
        "learned": F.when(op == "learn", F.col("weight")).otherwise(zero),
        "support": F.when(op == "learn", F.col("weight")).when(op.isin("hold", "reinforce"), one).otherwise(zero),
        "move": F.when(op == "break", one).when(op == "hold", -one).otherwise(zero),
        "reset": F.when(op == "reinstate", one).otherwise(zero),
    })
    placed = cut(steps.repartitionByRange(*keys, "pos").withColumn("chunk", F.spark_partition_id()))
    so_far = Window.partitionBy(*keys, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    segment = placed.withColumn("part", F.sum("reset").over(so_far))
    in_part = Window.partitionBy(*keys, "chunk", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    walked = segment.withColumn("walk", F.sum("move").over(in_part)).withColumn("low", F.min("walk").over(in_part))
    last = F.max_by(F.struct("walk", "low"), F.struct("part", "pos"))
    chunks = walked.groupBy(*keys, "chunk").agg(F.sum("learned").alias("learned"), F.sum("support").alias("support"), F.max("part").alias("resets"), F.count_if(op == "learn").alias("learns"), last.alias("last"))
    a = F.col("last.walk")
    b = a - F.col("last.low")
    fixed = F.col("resets") > 0
    maps = chunks.select(*keys, "chunk", "learned", "support", "learns", fixed.alias("fixed"), F.when(fixed, zero).otherwise(a).alias("a"), F.when(fixed, F.greatest(a, b)).otherwise(b).alias("b"))
    start = priors.select(*keys, F.lit(-1).alias("chunk"), F.col("weight").alias("learned"), "support", zero.alias("learns"), F.lit(True).alias("fixed"), zero.alias("a"), F.col("strain").alias("b"))
    order = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    groups = maps.unionByName(start).withColumn("run", F.sum(F.col("fixed").cast("int")).over(order))
    in_run = Window.partitionBy(*keys, "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    after = groups.withColumn("sum", F.sum("a").over(in_run)).withColumn("most", F.max(F.col("b") - F.col("sum")).over(in_run))
    after = after.withColumns({"strain": F.col("sum") + F.when(F.col("run") == 0, F.greatest(zero, "most")).otherwise(F.col("most")), "held": F.sum("support").over(order)})
    step = Window.partitionBy(*keys).orderBy("chunk")
    entering = {"strain_in": F.coalesce(F.lag("strain").over(step), zero), "support_in": F.col("held") - F.col("support")}
    after = cut(after.withColumns(entering))

    met = walked.join(after.select(*keys, "chunk", "strain_in", "support_in"), [*keys, "chunk"])
    level = F.when(F.col("part") == 0, F.col("strain_in")).otherwise(zero)
    strain = level + F.col("walk") - F.least(zero, level + F.col("low"))
    support = F.col("support_in") + F.sum("support").over(so_far)
    says = F.when(op.isin("learn", "reinstate"), False).when(op == "defeat", True).when(op.isin("hold", "break") & (strain > support), True)
    verdict = met.select(*keys, "pos", says.alias("says")).filter("says is not null").groupBy(*keys).agg(F.max_by("says", "pos").alias("says"))

    whole = after.groupBy(*keys).agg(F.sum("learned").alias("weight"), F.sum("support").alias("support"), F.max_by("strain", "chunk").alias("strain"), F.sum("learns").alias("learns"))
    before = priors.select(*keys, "origin", F.col("defeated").alias("was"))
    out = whole.join(before, keys, "left").join(verdict, keys, "left")
    origin = F.when(F.col("learns") > 0, "learned").otherwise(F.coalesce("origin", F.lit("learned")))
    return out.select(*keys, origin.alias("origin"), "weight", "support", "strain", F.coalesce("says", "was", F.lit(False)).alias("defeated"))


def held(entries: DataFrame, kinds: list[str]) -> DataFrame:
    """(token): tokens that some of the kinds hold and that aren't defeated there."""
    return entries.filter(F.col("kind").isin(kinds) & ~F.col("defeated")).select("token").distinct()


# The registers behind each question that a reader asks about a token.
QUESTIONS = {
    "attribution": ["attribution-verb"],
    "abbreviation": ["abbreviation"],
    "report": ["attribution-verb", "report-verb"],
    "source noun": ["source-noun"],
    "copula": ["copula"],
    "modifier": ["modifier"],
    "preposition": ["preposition"],
    "auxiliary": ["auxiliary", "copula"],
    "role": ["role"],
    "function": ["function"],
    "starter": ["starter"],
    "relation": ["relation"],
    "demonym": ["demonym"],
    "calendar": ["calendar"],
    "nonperson": ["nonperson"],
    "conjunction": ["conjunction"],
    "field label": ["field-label"],
}


def answers(tokens: DataFrame, entries: DataFrame, question: str) -> DataFrame:
    """The tokens for which the answer is yes."""
    return tokens.withColumn("__t", norm_token(F.col("token"))).join(held(entries, QUESTIONS[question]).withColumnRenamed("token", "__t"), "__t", "left_semi").drop("__t")


def all_answers(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """(question, token) of all questions that the entries answer with yes, of (token). Tokens are looked up as they are normalised, once each;
    null and empty ones have no answers."""
    asked = [(q, k) for q, kinds in QUESTIONS.items() for k in kinds]
    by_kind = F.broadcast(tokens.sparkSession.createDataFrame(asked, "question string, kind string"))
    yes = entries.filter(~F.col("defeated")).join(by_kind, "kind").select("question", "token").distinct()
    return tokens.select(norm_token(F.col("token")).alias("token")).distinct().join(yes, "token").select("question", "token")


def irregular_past(verbs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds past (the irregular past of a base form, else null) and is_past (whether the word is some verb's irregular past) to (token).

    pairs: (base, past) of the language; of a base with several the first counts. Tokens are looked up as they are normalised.
    """
    first = pairs.groupBy(F.col("base").alias("__t")).agg(F.min("past").alias("past"))
    pasts = pairs.select(F.col("past").alias("__t")).distinct().withColumn("__is", F.lit(True))
    met = verbs.withColumn("__t", norm_token(F.col("token"))).join(first, "__t", "left").join(pasts, "__t", "left")
    return met.withColumn("is_past", F.coalesce("__is", F.lit(False))).drop("__t", "__is")


def exported(entries: DataFrame) -> Column:
    """An entry as a line of JSON."""
    return F.to_json(F.struct(F.when(F.col("origin") == "learned", "REC").otherwise("DEF").alias("op"), "kind", "token", "weight", F.when(F.col("defeated"), True).alias("defeated")))


def convention_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: carries an entry (origin, weight, support, strain, defeated) over the batches of a stream."""
    fields = ("origin", "weight", "support", "strain", "defeated")
    entry = dict(zip(fields, state.get, strict=True)) if state.exists else None
    for part in pd.concat(list(batches)).sort_values("pos", kind="stable").itertuples():
        entry = apply_op(entry, part.op, int(part.weight))
    state.update(tuple(entry[f] for f in fields))
    yield pd.DataFrame([(*key, *(entry[f] for f in fields))], columns=["kind", "token", *fields])
