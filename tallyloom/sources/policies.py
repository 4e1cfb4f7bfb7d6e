"""Policies and the active basis: small files that steer a run, kept as they were written for their hashes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tallyloom.functions import canonical
from tallyloom.sources.ledger_io import exists, read_texts


@dataclass(frozen=True)
class Policy:
    """The file's text, byte for byte, and its options: section.key -> value."""

    text: str
    options: dict[str, object]


def _value(raw: str) -> object:
    text = raw.strip()
    if text[:1] in "\"'" and len(text) > 1:
        return text[1 : text.index(text[0], 1)] if text[0] in text[1:] else text
    text = text.split(" #")[0].strip()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text, text)


def parse_options(text: str) -> dict[str, object]:
    """The scalars of a policy's mapping, nested keys joined by dots; comments, lists and folded texts are no options."""
    out: dict[str, object] = {}
    open_keys: list[tuple[int, str]] = []
    folded = None
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" "))
        if not line.strip() or line.lstrip().startswith("#") or (folded is not None and depth > folded):
            continue
        folded = None
        key, colon, value = line.strip().partition(":")
        if not colon or key.startswith("-") or (value and not value.startswith(" ")):
            continue
        while open_keys and open_keys[-1][0] >= depth:
            open_keys.pop()
        name = ".".join([*(k for _, k in open_keys), key.strip("\"'")])
        if value.strip() in (">", "|", ">-", "|-"):
            folded = depth
        elif not value.split(" #")[0].strip():
            open_keys.append((depth, key.strip("\"'")))
        else:
            out[name] = _value(value)
    return out


def read_policies(spark: SparkSession, path: str) -> dict[str, Policy]:
    """The *.yaml files of a folder by name without the ending; none if the folder is missing. They are few, as a run's own settings are."""
    if not exists(spark, path):
        return {}
    return {r.name.removesuffix(".yaml"): Policy(r.text, parse_options(r.text)) for r in sorted(read_texts(spark, path, "*.yaml").collect())}


def configuration_hash(policies: dict[str, Policy]) -> str:
    """The hash of the policies' hashes: any changed byte changes it, a comment's too."""
    return canonical.sha256_ref(canonical.dumps({name: canonical.sha256_ref(p.text) for name, p in policies.items()}))


def active_basis(spark: SparkSession, path: str) -> str | None:
    """The id in the pointer file of the active basis; None if the file is missing or names none."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first().value or "{}").get("basis_id")
