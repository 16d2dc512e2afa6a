"""Scores of whole forecast distributions, and forecasts combined from several members."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crps(members: str | Column, actual: str | Column) -> Column:
    """Continuous ranked probability score of an ensemble (array of doubles) against what came.

    Mean distance of the members to the value, less half their mean distance to each other. The latter is read off the
    sorted members: the i-th of n is the larger one in i - 1 pairs and the smaller one in n - i. Null and NaN members
    are left out; without members or value there is no score."""
    x = F.col(members) if isinstance(members, str) else members
    y = F.col(actual) if isinstance(actual, str) else actual
    known = F.array_sort(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v)))
    n = F.size(known)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    apart = total(F.transform(known, lambda v: F.abs(v - y))) / n
    inner = total(F.transform(known, lambda v, i: (2 * (i + 1) - n - 1) * v)) / (n * n)
    return F.when((n > 0) & y.isNotNull(), apart - inner)


def quantile_crps(values: Sequence[str], levels: Sequence[float], actual: str) -> Column:
    """The score of a forecast given by quantiles: twice the integral of the pinball loss over the level, each
    quantile standing for the levels half-way to its neighbours (to 0 and 1 at the ends)."""
    if sorted(levels) != list(levels) or not all(0 < t < 1 for t in levels) or len(levels) != len(values):
        raise ValueError("levels must rise between 0 and 1, one per quantile")
    edges = [0.0, *[(a + b) / 2 for a, b in zip(levels, levels[1:])], 1.0]
    out = F.lit(0.0)
    for name, level, low, high in zip(values, levels, edges, edges[1:]):
        miss = F.col(actual) - F.col(name)
        out = out + 2 * (high - low) * F.greatest(level * miss, (level - 1) * miss)
    return out


def crps_per_series(df: DataFrame, keys: Sequence[str], members: str, actual: str) -> DataFrame:
    """Mean score and number of scored rows of each series."""
    scored = df.withColumn("_crps", crps(members, actual)).where("_crps IS NOT NULL")
    return scored.groupBy(*keys).agg(F.avg("_crps").alias("crps"), F.count(F.lit(1)).alias("n"))


def simplex_weights(moments: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """The non-negative weights of sum one that give the least w' M w.

    Members enter one by one where the slope is steepest; on the members taken the equality-constrained minimum is
    solved, and one whose weight would turn negative leaves at the point where it reaches zero."""
    m = (moments + moments.T) / 2
    scale = max(float(np.abs(m).max(initial=0.0)), 1e-300)
    m = m / scale
    size = len(m)
    w = np.zeros(size)
    taken = [int(np.argmin(np.diag(m)))]
    w[taken] = 1.0
    for _ in range(100 * size):
        while True:
            k = len(taken)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = 2 * m[np.ix_(taken, taken)], 1.0, 1.0
            goal = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            if (goal > 0).all() or k == 1:
                w[:] = 0.0
                w[taken] = goal / goal.sum() if k > 1 else 1.0
                break
            old = w[taken]
            falls = goal <= 0
            step = min(1.0, float(np.min(old[falls] / np.maximum(old[falls] - goal[falls], 1e-300))))
            moved = old + step * (goal - old)
            w[:] = 0.0
            w[taken] = np.maximum(moved, 0.0)
            taken = [t for t, v, f in zip(taken, moved, falls) if not (f and v <= 1e-15)]
        slope = 2 * m @ w
        level = float(w @ slope)
        others = [i for i in range(size) if i not in taken]
        if not others or min(slope[others]) >= level - tolerance:
            break
        taken.append(others[int(np.argmin(slope[others]))])
    return w


def ensemble_weights(df: DataFrame, keys: Sequence[str], members: Sequence[str], actual: str) -> DataFrame:
    """keys and ``weights`` (map of member to weight) of least squared error over the rows that have all members and
    the value.

    A series is reduced to the cross products of its members' errors before anything meets in one task, so the solver
    sees one small matrix per series."""
    errors = df.select(*keys, *[(F.col(m) - F.col(actual)).alias(f"_e{i}") for i, m in enumerate(members)]).dropna()
    size = len(members)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = errors.groupBy(*keys).agg(F.array(*[F.avg(F.col(f"_e{i}") * F.col(f"_e{j}")) for i, j in pairs]).alias("_m"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            weights = []
            for values in frame["_m"]:
                moments = np.zeros((size, size))
                for (i, j), v in zip(pairs, values):
                    moments[i, j] = moments[j, i] = v
                weights.append(simplex_weights(moments))
            yield frame.drop(columns="_m").assign(_w=weights)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields[:-1])
    solved = sums.mapInPandas(solve, f"{kinds}, _w array<double>")
    names = F.array(*[F.lit(m) for m in members])
    return solved.select(*keys, F.map_from_arrays(names, F.col("_w")).alias("weights"))


def combined(df: DataFrame, weights: DataFrame, keys: Sequence[str], members: Sequence[str], name: str = "combined") -> DataFrame:
    """The rows with the weighted forecast of their series. Weights of members that a row lacks go to the others in
    proportion; where all that is left has no weight, its plain mean counts; without members there is no forecast."""
    joined = df.join(weights, list(keys), "left")
    zero = F.lit(0.0)
    weighed = {m: F.coalesce(F.element_at("weights", F.lit(m)), zero) for m in members}
    there = [F.when(F.col(m).isNotNull(), weighed[m]).otherwise(zero) for m in members]
    total = sum(there[1:], there[0])
    value = sum([F.coalesce(w * F.col(m), zero) for m, w in zip(members, there)][1:], F.coalesce(there[0] * F.col(members[0]), zero))
    count = sum([F.col(m).isNotNull().cast("int") for m in members][1:], F.col(members[0]).isNotNull().cast("int"))
    plain = sum([F.coalesce(F.col(m), zero) for m in members][1:], F.coalesce(F.col(members[0]), zero))
    best = F.when(total > 0, value / F.nullif(total, zero)).when(count > 0, plain / F.nullif(count, F.lit(0)))
    return joined.withColumn(name, best).drop("weights")
