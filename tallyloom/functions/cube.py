"""The cube of 27 cells: nine acts by three grains.

An act is a mode in a domain. A cell's site follows from the domain and the grain, its stance from the mode and the grain, and
its name is ACT_Stance_Site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the data model.
GRAINS = ("Ground", "Figure", "Pattern")
ACTS = {
    "Differentiate": {"Existence": "NUL", "Structure": "SEG", "Significance": "DEF"},
    "Relate": {"Existence": "SIG", "Structure": "CON", "Significance": "EVA"},
    "Generate": {"Existence": "INS", "Structure": "SYN", "Significance": "REC"},
}
SITES = {"Existence": ("Void", "Entity", "Kind"), "Structure": ("Field", "Link", "Network"), "Significance": ("Atmosphere", "Lens", "Paradigm")}
STANCES = {"Differentiate": ("Clearing", "Dissecting", "Unraveling"), "Relate": ("Tending", "Binding", "Tracing"), "Generate": ("Cultivating", "Making", "Composing")}

#: (idx, cell, act, grain, site, stance, mode, domain) in cube order.
CELLS = [
    (3 * (3 * m + d) + g, f"{act}_{STANCES[mode][g]}_{SITES[domain][g]}", act, grain, SITES[domain][g], STANCES[mode][g], mode, domain)
    for m, (mode, acts) in enumerate(ACTS.items())
    for d, (domain, act) in enumerate(acts.items())
    for g, grain in enumerate(GRAINS)
]
CELL_NAMES = [c[1] for c in CELLS]
#: Exemplar selection goes through the cells by name.
BY_NAME = sorted(CELL_NAMES)
SCHEMA = "idx int, cell string, act string, grain string, site string, stance string, mode string, domain string"


def cells(spark: SparkSession) -> DataFrame:
    """The 27 rows as a dimension to broadcast."""
    return spark.createDataFrame(CELLS, SCHEMA)


def values_sql() -> str:
    """The same rows as a SQL VALUES list named cells."""
    rows = ", ".join("(" + ", ".join(repr(v) for v in c) + ")" for c in CELLS)
    return f"(values {rows}) cells(idx, cell, act, grain, site, stance, mode, domain)"
