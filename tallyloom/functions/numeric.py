"""Number rules of the data model, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PPM = 1_000_000
#: Least probability of a cell in a normalised prior.
FLOOR = 1e-6


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity, negative ones too."""
    return F.floor(x + 0.5).cast("long")


def clamp_ppm(x: Column) -> Column:
    return F.greatest(F.lit(-PPM), F.least(F.lit(PPM), half_up(x * PPM))).cast("long")


def settled(x: Column, digits: int = 6) -> Column:
    """Rounded for results that are compared by value; never -0.0."""
    return F.round(x, digits) + F.lit(0.0)


def entropy_term(p: Column) -> Column:
    """-p * log2(p), 0 for p <= 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def entropy_micro(p_terms_sum: Column) -> Column:
    return half_up(p_terms_sum * PPM)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; 0 for fewer than two pairs or a constant series."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    flat = (n < 2) | (vx <= 1e-15) | (vy <= 1e-15)
    return F.when(flat, F.lit(0.0)).otherwise((sxy - sx * sy / n) / F.sqrt(F.when(flat, F.lit(1.0)).otherwise(vx * vy)))


def once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, whatever uses them.

    The optimiser would put an expression in place of each mention of a column, also within the functions of arrays, where it
    would run for every element. It doesn't reach across a generator.
    """
    rest = [c for c in df.columns if c not in exprs]
    return df.select(*rest, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))
