"""Repeated records in a stream of units, and the selection of exemplars."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.cube import BY_NAME, CELL_NAMES
from tallyloom.sources.scratch import cut

#: Similarities of distinct windows that are kept at once: 64 MB.
ALIKE_NUMBERS = 1 << 23
#: Candidates that a pass of the exemplar selection brings to the driver.
POOL = 1000


@dataclass(frozen=True)
class Mining:
    min_records: int = 2
    min_units: int = 2
    max_units: int = 8
    similarity: float = 0.6
    max_gap: int = 3


def jaccard(a: frozenset, b: frozenset) -> float:
    """1 for two empty sets."""
    union = len(a | b)
    return len(a & b) / union if union else 1.0


def _likeness(sets: list[frozenset]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each window's set, equal for equal ones, and the matrix of which entries the distinct sets have."""
    kinds = {s: k for k, s in enumerate(dict.fromkeys(sets))}
    entries = {x: j for j, x in enumerate(sorted(frozenset().union(*kinds)))}
    has = np.zeros((len(kinds), max(1, len(entries))))
    for s, k in kinds.items():
        has[k, [entries[x] for x in s]] = 1
    return np.array([kinds[s] for s in sets]), has


def _alike(has: np.ndarray, k: int) -> np.ndarray:
    """The Jaccard similarity of one distinct set to all of them."""
    both = has @ has[k]
    union = has.sum(axis=1) + has[k].sum() - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _alike_all(has: np.ndarray) -> np.ndarray:
    """The similarity of each distinct set to each."""
    sizes, both = has.sum(axis=1), has @ has.T
    union = sizes[:, None] + sizes - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _ahead(fits: np.ndarray, length: int, max_gap: int) -> np.ndarray:
    """Of rows of places that fit: for each place the next one that fits behind a record there, -1 without any near enough."""
    n = fits.shape[1]
    following = np.minimum.accumulate(np.where(fits, np.arange(n), n)[:, ::-1], axis=1)[:, ::-1]
    out = np.full(fits.shape, -1)
    if n > length:
        after = following[:, length:]
        near = (after < n) & (after <= np.arange(n - length) + length + max_gap)
        out[:, : n - length] = np.where(near, after, -1)
    return out


def _groups(units: list[list[str]], length: int, how: Mining) -> Iterator[tuple[float, int, dict]]:
    """(score, first start, group) of the windows of one length.

    What follows a record depends only on where it ends and on the set that it must resemble, so for each distinct set the next
    window that fits is known for every place at once, and each of its windows reads its group off that table. Of the similarities of
    distinct sets only the rows used last are kept, ALIKE_NUMBERS numbers at most; the others are made again when they are asked for.
    """
    sets = [frozenset(x for u in units[i : i + length] for x in u) for i in range(len(units) - length + 1)]
    kind, has = _likeness(sets)
    whole = len(has) * len(sets) <= ALIKE_NUMBERS // 16
    every = range(len(has))
    if whole:  # all similarities, and what follows each place, at once
        table = _alike_all(has)
        alike = table.tolist().__getitem__
        jumps = _ahead(table[:, kind] >= how.similarity, length, how.max_gap).tolist()
    else:
        alike = lru_cache(maxsize=max(16, ALIKE_NUMBERS // max(1, len(has))))(lambda k: _alike(has, k))
    kinds = kind.tolist()
    places: list[list[int]] = [[] for _ in every]
    for start, k in enumerate(kinds):
        places[k].append(start)
    for k in every:
        ahead = jumps[k] if whole else _ahead((alike(k)[kind] >= how.similarity)[None], length, how.max_gap)[0].tolist()
        for start in places[k]:
            starts = [start]
            while (after := ahead[starts[-1]]) >= 0:
                starts.append(after)
            if len(starts) >= how.min_records:
                times = Counter([kinds[s] for s in starts])
                pairs = 0.0
                for a, n in times.items():
                    near = alike(a)
                    pairs += n * (n - 1) / 2 + sum([n * m * near[b] for b, m in times.items() if b > a])
                confidence = round(float(pairs / (len(starts) * (len(starts) - 1) / 2)), 6) if len(starts) > 1 else 0.0
                yield len(starts) * length * confidence, start, {"unit_count": length, "starts": starts, "confidence": confidence, "signature": sorted(sets[start])}


def mine(units: list[list[str]], how: Mining = Mining()) -> list[dict]:
    """Groups of windows that resemble the first of them, found from left to right with few units between them.

    Groups are ordered by records * units * confidence; of equal ones longer windows come first, then earlier ones.
    """
    longest = min(how.max_units, len(units) // how.min_records or how.max_units, len(units))
    found = [g for length in range(how.min_units, longest + 1) for g in _groups(units, length, how)]
    return [group for _, _, group in sorted(found, key=lambda g: (-g[0], -g[2]["unit_count"], g[1]))]


def mine_records(df: DataFrame, doc_col: str, pos_col: str, signature_col: str, how: Mining = Mining()) -> DataFrame:
    """(doc, rank, unit_count, n_records, starts, confidence, signature) of units (doc, pos, signature array<string>).

    A document's units go to one task, since each record begins where the one before ended; documents are spread over tasks.
    """
    kind = df.schema[doc_col].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        groups = mine([list(s) for s in part["signature"]], how)
        rows = [(part["doc"].iloc[0], i, g["unit_count"], len(g["starts"]), g["starts"], g["confidence"], g["signature"]) for i, g in enumerate(groups)]
        return pd.DataFrame(rows, columns=["doc", "rank", "unit_count", "n_records", "starts", "confidence", "signature"])

    narrow = df.select(F.col(doc_col).alias("doc"), F.col(pos_col).alias("pos"), F.col(signature_col).alias("signature"))
    return narrow.groupBy("doc").applyInPandas(one, f"doc {kind}, rank int, unit_count int, n_records int, starts array<int>, confidence double, signature array<string>")


def window_signatures(df: DataFrame, doc_col: str, pos_col: str, signature_col: str, length: int) -> DataFrame:
    """(doc, pos, window): the sorted distinct entries of each full window of so many units."""
    ahead = Window.partitionBy(doc_col).orderBy(pos_col).rowsBetween(0, length - 1)
    held = df.select(F.col(doc_col).alias("doc"), F.col(pos_col).alias("pos"), F.collect_list(signature_col).over(ahead).alias("w"))
    return held.filter(F.size("w") == length).select("doc", "pos", F.array_sort(F.array_distinct(F.flatten("w"))).alias("window"))


def select_basis(candidates: DataFrame, target: int = 100, per_cell: int | None = None, enough_ppm: int = 950_000) -> list[dict]:
    """Greedy choice of exemplars: (candidate_id, amplitude_ppm in cube order) to the chosen ids with the cell each is admitted for.

    The one that raises the best amplitudes most, summed over the cells that aren't full, wins, of equal ones the smallest id. It stops at the
    target, once every cell has enough, or when nothing helps. A candidate's gain only falls, so the POOL best of a pass over all
    candidates are chosen from, without another pass, as long as the winner gains more than the last of them did; then
    the next pass looks at all again. The driver holds the pool.
    """
    per_cell = per_cell or -(-100 // len(CELL_NAMES)) + 1
    place = {name: CELL_NAMES.index(name) for name in BY_NAME}
    best, count, chosen = dict.fromkeys(BY_NAME, 0), dict.fromkeys(BY_NAME, 0), []
    held = cut(candidates.select("candidate_id", "amplitude_ppm"))
    pool: dict = {}
    bound = 0
    while len(chosen) < target and not all(v >= enough_ppm for v in best.values()):
        open_cells = [c for c in BY_NAME if count[c] < per_cell]
        if not open_cells:
            break
        gain_of = lambda v: sum(max(0, v[place[c]] - best[c]) for c in open_cells)  # noqa: B023, E731
        gain, first = max(((gain_of(v), -i) for i, v in pool.items()), default=(0, 0))
        if gain <= bound:  # another candidate may do as much
            gains = [F.greatest(F.lit(0), F.col("amplitude_ppm")[place[c]] - F.lit(best[c])) for c in open_cells]
            total: Column = sum(gains[1:], gains[0]).cast("long")
            rows = held.select("candidate_id", "amplitude_ppm", total.alias("gain")).filter("gain > 0").orderBy(F.desc("gain"), "candidate_id").limit(POOL).collect()
            if not rows:
                break
            pool = {r.candidate_id: r.amplitude_ppm for r in rows}
            bound = rows[-1].gain if len(rows) == POOL else 0
            gain, first = rows[0].gain, -rows[0].candidate_id
        top, amplitudes = -first, pool[-first]
        cell = max(open_cells, key=lambda c: (max(0, amplitudes[place[c]] - best[c]), -BY_NAME.index(c)))
        for c in BY_NAME:
            best[c] = max(best[c], amplitudes[place[c]])
        count[cell] += 1
        chosen.append({"rank": len(chosen), "candidate_id": top, "admitted_for": cell, "gain": gain})
    return chosen

