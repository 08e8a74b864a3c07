"""Splits that keep every label's share where rows have several labels.

Rows are counted by their set of labels; only these counts are planned: labels are few, so are their sets. The plan goes label by
label, the rarest first, gives each fold its share of every set that has the label, and hands what does not divide to the
fold that lacks the label most; then single rows move between folds, or change places, as long as that brings labels closer
to their targets. Rows find their fold from their place among the rows of their set, in the order of a digest.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.sources import tables

from . import ordering
from .sampling import random_order


def plan(counts: dict[tuple[str, ...], int], ratios: list[float]) -> dict[tuple[str, ...], list[int]]:
    """How many rows of each set of labels go to each fold. Ties: the fold that lacks most rows, then the first."""
    share = np.array(ratios, float) / sum(ratios)
    sets = sorted(counts)
    labels = sorted({x for s in sets for x in s})
    has = np.array([[x in s for x in labels] for s in sets], float).reshape(len(sets), len(labels))
    total = np.array([counts[s] for s in sets], float)
    target, whole = np.outer(has.T @ total, share), total.sum() * share  # labels x folds; folds
    found = np.zeros((len(sets), len(share)), np.int64)
    lacks, room = target.copy(), whole.copy()
    left = set(range(len(sets)))

    def deal(s: int, label: int | None) -> None:
        """All rows of a set: whole shares first, then row by row to whom lacks the label most."""
        own = np.floor(total[s] * share).astype(np.int64)
        for _ in range(int(total[s] - own.sum())):
            gap = room - own if label is None else lacks[label] - own
            best = max(range(len(share)), key=lambda j: (round(gap[j], 9), round(room[j] - own[j], 9), -j))
            own[best] += 1
        found[s] = own
        lacks[has[s] > 0] -= own
        room[:] = room - own
        left.discard(s)

    while any(has[s].any() for s in left):
        remaining = has[sorted(left)].T @ total[sorted(left)]
        label = min((n, i) for i, n in enumerate(remaining) if n > 0)[1] if (remaining > 0).any() else None
        mine = [s for s in sorted(left) if (has[s, label] if label is not None else has[s].any())]
        for s in mine:
            deal(s, label)
    for s in sorted(left):
        deal(s, None)
    _improve(found, has, target, whole)
    return {s: found[i].tolist() for i, s in enumerate(sets)}


def _improve(found: np.ndarray, has: np.ndarray, target: np.ndarray, whole: np.ndarray) -> None:
    """Move a row of a set to another fold, or exchange it for one of another set, while the squares of what labels and folds are off get less."""
    traits = np.append(has, np.ones((len(has), 1)), axis=1)  # labels, and being a row
    off = np.append(has.T @ found - target, (found.sum(axis=0) - whole)[None, :], axis=0)
    size = (traits**2).sum(axis=1)
    swap = 2 * (size[:, None] + size[None, :] - 2 * traits @ traits.T)  # the squares of what an exchange changes
    while True:
        best = (-1e-9, None)
        for a, b in permutations(range(found.shape[1]), 2):
            pull = 2 * traits @ (off[:, b] - off[:, a])
            alone = np.where(found[:, a] > 0, pull + 2 * size, np.inf)
            both = np.where((found[:, a] > 0)[:, None] & (found[:, b] > 0)[None, :], pull[:, None] - pull[None, :] + swap, np.inf)
            for change in (alone, both):
                if change.size and change.min() < best[0]:
                    best = (float(change.min()), (a, b, *np.unravel_index(int(change.argmin()), change.shape)))
        if best[1] is None:
            return
        a, b, there, *back = (int(x) for x in best[1])
        moved = traits[there].copy()
        found[there, [a, b]] += [-1, 1]
        for s in back:
            found[s, [a, b]] += [1, -1]
            moved -= traits[s]
        off[:, a] -= moved
        off[:, b] += moved


def split(rows: DataFrame, labels: Column, key: Column, ratios: list[float], seed: int) -> DataFrame:
    """rows with fold, from 0: each fold has its ratio of every label within a row, but for rare cases of a little more.

    labels: an array of text, null being none; order and repeats in it do not matter. key tells rows apart and, with the
    seed, decides which rows of a set go where; rows of equal keys may be in any of their set's folds.
    """
    if not ratios or min(ratios) < 0 or sum(ratios) <= 0:
        raise ValueError("ratios must not be negative, nor all zero")
    none = F.array().cast("array<string>")
    names = rows.withColumns({"_set": F.array_sort(F.array_distinct(F.coalesce(labels, none))), "_draw": random_order(key, seed), "_key": key.cast("string")})
    ranged = tables.stored(ordering.in_ranges(names, [F.col("_set"), F.col("_draw"), F.col("_key")]), "sets")
    name = F.to_json("_set")
    held = ranged.groupBy("_set", name.alias("_name")).agg(F.count("*").alias("n")).collect()  # a row a set of labels
    counts, named = {tuple(r["_set"]): r["n"] for r in held}, {tuple(r["_set"]): r["_name"] for r in held}
    dealt, first, out = plan(counts, ratios), 0, []
    for s in sorted(counts):  # as arrays are ordered
        for fold, n in enumerate(dealt[s]):
            out.append((named[s], first, first + n, fold))
            first += n
    bounds = rows.sparkSession.createDataFrame([(n, a, z, f) for n, a, z, f in out if a < z], "_name string, _from long, _to long, fold int")
    places = ordering.placed(ranged, name="_place")
    inside = (name == F.col("_name")) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))
    return places.join(F.broadcast(bounds), inside).drop("_set", "_draw", "_key", "_place", "_name", "_from", "_to")  # a row for each set and fold
