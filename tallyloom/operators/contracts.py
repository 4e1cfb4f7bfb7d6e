"""Contracts of published artifacts: firewalls on what they may hold, hashes, versions, readiness, rights and names.

Artifacts are JSON documents, few and small; a check is a function of one, applied in the tasks by a vectorised UDF.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.functions.canonical import content_hash
from tallyloom.functions.text import reader_major

# Keys under which a distribution could carry text.
TEXT_KEYS = "text source_text sentence sentences excerpt quote quotes body document documents work works page pages paragraph paragraphs".split()
# Paths of a role expectation that may hold strings.
STRING_PATHS = "schema basis_id operator_epoch content_hash reader_version pocket.id pocket.version pocket.date_range[] expectations[].exemplar_id".split()
# Keys that name a kind's members, and keys of an expression's node.
ROSTER_KEYS = ["propose_members", "holdout_members", "members"]
NODE_KEYS = ["op", "args", "channel_index"]
# Rights statuses and whether a full text may be kept.
RIGHTS = [("public_domain", True), ("licensed", True), ("fair_use_asserted", True), ("restricted", False), ("unknown", False)]
# What a channel must reach.
READY = {"least_median": 12, "least_seeds": 3, "least_effect": 0.0, "fragmentation_below": 0.35}


def text_key(value: object, path: str = "$") -> str | None:
    """The path of the first key that could carry text."""
    if isinstance(value, list):
        return next((p for i, v in enumerate(value) if (p := text_key(v, f"{path}[{i}]"))), None)
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() in TEXT_KEYS:
                return f"{path}.{k}"
            if p := text_key(v, f"{path}.{k}"):
                return p
    return None


def stray_string(value: object, path: str = "") -> str | None:
    """The path of the first string that no identifier field holds."""
    if isinstance(value, str):
        return None if re.sub(r"\[\d+\]", "[]", path) in STRING_PATHS else path or "<root>"
    if isinstance(value, list):
        return next((p for i, v in enumerate(value) if (p := stray_string(v, f"{path}[{i}]"))), None)
    if isinstance(value, dict):
        return next((p for k, v in value.items() if (p := stray_string(v, f"{path}.{k}" if path else k))), None)
    return None


def roster(value: object, path: str = "$") -> str | None:
    """The path of the first list of members."""
    if isinstance(value, list):
        return next((p for i, v in enumerate(value) if (p := roster(v, f"{path}[{i}]"))), None)
    if isinstance(value, dict):
        if found := next((k for k in ROSTER_KEYS if k in value), None):
            return f"{path}.{found}"
        return next((p for k, v in value.items() if (p := roster(v, f"{path}.{k}"))), None)
    return None


def bad_expression(node: object, path: str = "expression") -> str | None:
    """What is wrong with an expression: strings but for operators, other keys, or channels that aren't whole and non-negative."""
    if isinstance(node, (bool, int, float)):
        return None
    if isinstance(node, list):
        return next((p for i, v in enumerate(node) if (p := bad_expression(v, f"{path}[{i}]"))), None)
    if not isinstance(node, dict):
        return f"{path}: a string or nothing"
    if not isinstance(node.get("op"), str) or not re.fullmatch(r"[a-z][a-z0-9_]*", node["op"]):
        return f"{path}.op"
    if extra := next((k for k in node if k not in NODE_KEYS), None):
        return f"{path}.{extra}"
    channel = node.get("channel_index", 0)
    if isinstance(channel, bool) or not isinstance(channel, int) or channel < 0:
        return f"{path}.channel_index"
    if "args" in node:
        return bad_expression(node["args"], f"{path}.args") if isinstance(node["args"], list) else f"{path}.args"
    return None


def check_pocket(pocket: dict) -> str | None:
    if pocket.get("schema") != "Pocket@1":
        return "schema"
    if pocket.get("role") != "corpus":
        return "role"
    if p := text_key(pocket.get("distributions"), "$.distributions"):
        return f"text at {p}"
    return None if pocket.get("content_hash") == content_hash(pocket) else "content_hash"


def check_role_expectation(payload: dict) -> str | None:
    if payload.get("schema") != "RoleExpectation@1":
        return "schema"
    if p := stray_string(payload):
        return f"string at {p}"
    ballast = payload.get("ballast") or {}
    if ballast.get("ungated_fraction_ppm", 0) < ballast.get("floor_ppm", 0):
        return "ballast"
    return None if payload.get("content_hash") == content_hash(payload) else "content_hash"


def check_kind_vocabulary(payload: dict) -> str | None:
    if payload.get("schema") != "KindVocabulary@1":
        return "schema"
    if p := roster(payload):
        return f"roster at {p}"
    for kind in payload.get("kinds") or []:
        for parameter in kind.get("parameters") or []:
            if "provenance_expression" in parameter and (p := bad_expression(parameter["provenance_expression"])):
                return p
    return None if payload.get("content_hash") == content_hash(payload) else "content_hash"


CHECKS: dict[str, Callable[[dict], str | None]] = {"Pocket@1": check_pocket, "RoleExpectation@1": check_role_expectation, "KindVocabulary@1": check_kind_vocabulary}


@F.pandas_udf(StringType())
def artifact_fault(json_text: pd.Series) -> pd.Series:
    """Why an artifact is refused, null if it is accepted."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text or "")
        except ValueError:
            return "not JSON"
        check = CHECKS.get(value.get("schema")) if isinstance(value, dict) else None
        return check(value) if check else "schema"

    return json_text.map(one)


def publish_kinds(candidates: list[dict], header: dict) -> dict:
    """A kind vocabulary of candidates without their members, with its hash."""
    kinds = [{k: v for k, v in c.items() if k not in ROSTER_KEYS} for c in candidates]
    payload = {"schema": "KindVocabulary@1", **header, "kinds": kinds}
    return {**payload, "content_hash": content_hash(payload)}


def without_names(df: DataFrame) -> DataFrame:
    """The kinds without what is only for display."""
    return df.drop("external_name", "external_name_provenance")


def with_names(kinds: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Kinds (id, content_hash) with the names (id, external_name, content_hash) that were given for this very vocabulary."""
    return kinds.join(sidecar, ["id", "content_hash"], "left")


def compatible(df: DataFrame, version_col: str, engine: str) -> DataFrame:
    """Adds compatible: the reader's name and major number are the engine's."""
    engine_major = reader_major(F.lit(engine))
    return df.withColumn("compatible", F.coalesce(reader_major(F.col(version_col)) == engine_major, F.lit(False)))


def one_basis(df: DataFrame, group_col: str) -> DataFrame:
    """(group, n_bases, comparable): pockets may be pooled if all stand on one basis."""
    return df.groupBy(group_col).agg(F.countDistinct("basis_id").alias("n_bases")).withColumn("comparable", F.col("n_bases") <= 1)


def readiness(channels: DataFrame, splits: DataFrame) -> DataFrame:
    """(channel, ready, reasons) of channels (channel, median_steps, fragmentation) and splits (channel, seed, recovered, gain, null_gain, effect)."""
    cond = lambda c: F.coalesce(c, F.lit(False))
    by = splits.groupBy("channel").agg(
        F.countDistinct("seed").alias("seeds"),
        F.count_if(~cond(F.col("recovered"))).alias("lost"),
        F.count_if(~cond(F.col("gain") > F.col("null_gain"))).alias("below_null"),
        F.count_if(~cond(F.col("effect") >= READY["least_effect"])).alias("below_effect"),
        F.count("*").alias("n"),
    )
    c = channels.join(by, "channel", "left").na.fill(0, ["seeds", "lost", "below_null", "below_effect", "n"])
    none = F.col("n") == 0
    reasons = F.array_compact(
        F.array(
            F.when(~cond(F.col("median_steps") >= READY["least_median"]), F.lit("median_n_steps_above_floor")),
            F.when(F.col("seeds") < READY["least_seeds"], F.lit("min_independent_splits")),
            F.when(none | (F.col("lost") > 0), F.lit("kind_recovers_across_splits")),
            F.when(none | (F.col("below_null") > 0), F.lit("transfer_gain_clears_membership_null")),
            F.when(none | (F.col("below_effect") > 0), F.lit("relative_effect_floor_met_on_holdout")),
            F.when(~cond(F.col("fragmentation") < READY["fragmentation_below"]), F.lit("coreference_fragmentation_below_threshold")),
        )
    )
    return c.select("channel", (F.size(reasons) == 0).alias("ready"), reasons.alias("reasons"))


def lint(files: DataFrame, foreign: str) -> DataFrame:
    """(path, rule) of the published files (path, text) that break the contract: data only, no import of the foreign package, no reference to
    whatever is latest, no content id of zeros.

    foreign: the package's name. A null text breaks only the rules on paths; a file breaks each rule once.
    """
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    imports = rf"""\b(import|require)\s*(\(|[^\n;]*from\s*)['"]@?{foreign}[^'"]*['"]"""
    ids = F.try_parse_json(F.when(path.endswith(".json"), text))
    named = F.coalesce(*[F.try_variant_get(ids, f"$.{k}", "string") for k in ("snapshot_id", "pack_id")])
    rules = {
        "code": path.rlike(r"(?i)\.(mjs|cjs|js|ts|sh|py|wasm)$"),
        "import": text.rlike(imports),
        "implicit-latest": text.rlike(r"(?i)\b(latest\b|@latest\b|main\b|HEAD\b)"),
        "zero-id": F.coalesce(named.rlike(":sha256:0{64}$"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(wrong, F.lit(rule)) for rule, wrong in rules.items()]))
    return files.select("path", F.explode(broken).alias("rule"))


def changed_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, rule) of published files (path, text) that a later publication changed or dropped: what is named by its content never changes. New files
    are fine; of a path that repeats all texts must be the same."""
    held = lambda df, name: df.groupBy("path").agg(F.array_sort(F.collect_set(F.sha2(F.coalesce("text", F.lit("")), 256))).alias(name))
    met = held(before, "was").join(held(after, "now"), "path", "left")
    return met.filter("now is null or was <> now").select("path", F.when(F.col("now").isNull(), "dropped").otherwise("changed").alias("rule"))


def in_range(version: Column, wanted: Column) -> Column:
    """Whether a version (1.2.3) lies in a range of terms joined by spaces, each of >=, >, <=, <, = and a version whose missing parts are 0; false for
    null or other texts."""
    parts = lambda v: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.coalesce(F.try_element_at(F.split(v, r"\."), i).try_cast("int"), F.lit(0)))
    at = parts(version)

    def holds(term: Column) -> Column:
        sign, bound = F.regexp_extract(term, "^(>=|<=|>|<|=)?", 1), parts(F.regexp_extract(term, r"([0-9.]+)$", 1))
        return F.when(sign == ">=", at >= bound).when(sign == "<=", at <= bound).when(sign == ">", at > bound).when(sign == "<", at < bound).otherwise(at == bound)

    known = version.rlike(r"^\d+(\.\d+)*$") & wanted.rlike(r"^((>=|<=|>|<|=)?\d+(\.\d+)*)( +(>=|<=|>|<|=)?\d+(\.\d+)*)*$")
    return F.coalesce(known & F.forall(F.split(wanted, " +"), holds), F.lit(False))


def compatibility(snapshots: DataFrame, matrix: DataFrame) -> DataFrame:
    """Snapshots (snapshot_id, schema, operator_epoch, engine_version) with the first reason against them: unknown-epoch, schema, engine, or null.

    matrix: (operator_epoch, engine_compatibility, spec_versions array) of the engine, a row an epoch.
    """
    met = snapshots.join(matrix, "operator_epoch", "left")
    reason = F.when(F.col("engine_compatibility").isNull(), "unknown-epoch").when(~F.coalesce(F.array_contains("spec_versions", F.col("schema")), F.lit(False)), "schema")
    reason = reason.when(~in_range(F.col("engine_version"), F.col("engine_compatibility")), "engine")
    return met.select(*snapshots.columns, reason.alias("reason"))


def rights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RIGHTS, "status string, may_retain_full_text boolean")


def retained(sources: DataFrame) -> DataFrame:
    """Sources (source, status) with may_retain_full_text; without or with another status they count as unknown."""
    table = F.broadcast(rights(sources.sparkSession))
    return sources.join(table, "status", "left").withColumns({"may_retain_full_text": F.coalesce("may_retain_full_text", F.lit(False)), "status": F.when(F.col("may_retain_full_text").isNull(), "unknown").otherwise(F.col("status"))})
