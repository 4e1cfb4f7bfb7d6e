"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import checks, corpora, ledgers, measurement, projections, readings, registers, texts

_PLANS = [measurement, ledgers, texts, readings, projections, corpora, checks, registers]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry[0] for plan in _PLANS for name, entry in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for plan in _PLANS for name, entry in plan.QUERIES.items() if entry[1]}
