"""Lag, rolling, calendar and target columns, splits, supervised windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from breezeline.functions.numeric import safe_ratio
from breezeline.operators.blocks import (
    PART_EDGES,
    Series,
    drop_helpers,
    ensure_positions,
    framed,
)

# The lag and window sets of the feature recipes.
LAGS = (1, 2, 3, 6, 12, 24)
SHORT_LAGS = (1, 3, 6, 12, 24)
ROLLING = (3, 6, 12, 24)


def calendar(ts: str) -> list[Column]:
    """Hour, day of week (Monday = 0), month."""
    return [
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        F.month(ts).alias("month"),
    ]


def lag_columns(w, cols: Sequence[str], lags: Sequence[int]) -> list[Column]:
    return [F.lag(c, k).over(w).alias(f"{c}_lag_{k}h") for c in cols for k in lags]


def rolling_mean_columns(w, cols: Sequence[str], widths: Sequence[int]) -> list[Column]:
    return [
        F.avg(c).over(w.rowsBetween(1 - k, 0)).alias(f"{c}_roll_{k}h") for c in cols for k in widths
    ]


def rolling_std_columns(w, cols: Sequence[str], widths: Sequence[int]) -> list[Column]:
    return [
        F.stddev_samp(c).over(w.rowsBetween(1 - k, 0)).alias(f"{c}_std_{k}h")
        for c in cols
        for k in widths
    ]


def delta_columns(w, cols: Sequence[str], lag: int = 24) -> list[Column]:
    return [(F.col(c) - F.lag(c, lag).over(w)).alias(f"{c}_delta_{lag}h") for c in cols]


def lead_columns(w, target: str, horizon: int | Sequence[int]) -> list[Column]:
    hours = range(1, horizon + 1) if isinstance(horizon, int) else horizon
    return [F.lead(target, h).over(w).alias(f"{target}_h{h}") for h in hours]


# The ratios of the feature recipe, where both metrics are there.
RATIOS = {"pm25_pm10_ratio": ("pm2_5", "pm10"), "co_no2_ratio": ("carbon_monoxide", "nitrogen_dioxide")}


def ratio_columns(cols: Sequence[str]) -> list[Column]:
    return [safe_ratio(*pair).alias(name) for name, pair in RATIOS.items() if set(pair) <= set(cols)]


def feature_frame(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    lags: Sequence[int] = LAGS,
    rolling: Sequence[int] = ROLLING,
    stds: Sequence[int] = (),
    delta: int | None = 24,
    target: str | None = None,
    horizon: int | Sequence[int] = 0,
    with_calendar: bool = True,
) -> DataFrame:
    """All ordered features and targets of a recipe from one window specification; with
    the calendar come the ratios of the metrics that are there."""
    before = max([*lags, *(k - 1 for k in rolling), *(k - 1 for k in stds), delta or 0, 0])
    after = (horizon if isinstance(horizon, int) else max(horizon)) if target else 0

    def build(w):
        out = lag_columns(w, cols, lags) + rolling_mean_columns(w, cols, rolling)
        out += rolling_std_columns(w, cols, stds)
        out += delta_columns(w, cols, delta) if delta else []
        return out + (lead_columns(w, target, horizon) if target else [])

    d = framed(df, s, before, after, build)
    return d.select("*", *calendar(s.ts), *ratio_columns(cols)) if with_calendar else d


def chronological_split(
    df: DataFrame, s: Series, train: float = 0.70, val: float = 0.15, keep_helpers: bool = False
) -> DataFrame:
    """Add ``split`` (train / val / test) by row position; shares are cut with double
    arithmetic and truncation.  The kept helpers include the edges of the row's part."""
    d = ensure_positions(df, s)
    pos, n = F.col("_pos"), F.col("_len")
    first = F.floor(n * F.lit(float(train)))
    second = F.floor(n * F.lit(float(train + val)))
    in_train, in_val = pos < first, pos < second
    out = d.select(
        "*",
        F.when(in_train, "train").when(in_val, "val").otherwise("test").alias("split"),
        F.when(in_train, F.lit(0)).when(in_val, first).otherwise(second).alias("_from"),
        F.when(in_train, first).when(in_val, second).otherwise(n).alias("_to"),
    )
    return out if keep_helpers else drop_helpers(out)


def supervised_windows(
    df: DataFrame, s: Series, inputs: Sequence[str], target: str, lookback: int, horizon: int
) -> DataFrame:
    """One row per window start: ``x`` (lookback structs), ``y`` (horizon doubles),
    ``window_index`` and ``window_count``.

    On a split frame that kept its helpers no window crosses the edge of a part: frames
    run over the whole series and windows that would reach past the edge are dropped."""
    split = [c for c in ("split",) if c in df.columns]
    d = ensure_positions(df, s)
    if not set(PART_EDGES) <= set(d.columns):
        if split:
            raise ValueError("a split frame must keep its helpers to be cut into windows")
        d = d.withColumn("_from", F.lit(0)).withColumn("_to", F.col("_len"))

    def build(w):
        ahead = w.rowsBetween(0, lookback - 1)
        later = w.rowsBetween(lookback, lookback + horizon - 1)
        y = F.collect_list(F.struct(F.col(target).alias("v"))).over(later)
        return [
            F.collect_list(F.struct(*inputs)).over(ahead).alias("_x"),
            F.transform(y, lambda e: e["v"]).alias("_y"),
        ]

    index = F.col("_pos") - F.col("_from")
    count = F.col("_to") - F.col("_from") - lookback - horizon + 1
    out = framed(d, s, 0, lookback + horizon - 1, build, keep_helpers=True)
    return out.where(index < count).select(
        *s.keys,
        *split,
        s.ts,
        index.alias("window_index"),
        count.alias("window_count"),
        F.col("_x").alias("x"),
        F.col("_y").alias("y"),
    )


def limit_windows(df: DataFrame, max_count: int) -> DataFrame:
    """Evenly spaced windows, first and last included, when a series has more than
    ``max_count``; a row decides by itself whether it is one of them."""
    if max_count <= 0:
        return df
    i, n = F.col("window_index"), F.col("window_count")
    if max_count == 1:
        return df.where((n <= 1) | (i == 0))
    gap = (n - 1) / F.lit(float(max_count - 1))
    nearest = F.ceil(i / gap)
    hit = F.lit(False)
    for shift in (-1, 0, 1):  # the two roundings may be off by one from each other
        j = nearest + shift
        hit = hit | ((j >= 0) & (j <= max_count - 1) & (F.floor(j * gap) == i))
    return df.where((n <= max_count) | hit)


def flat_windows(df: DataFrame, inputs: Sequence[str], as_vector: bool = False) -> DataFrame:
    """``x`` flattened row by row into one array of doubles, or a vector for Spark ML."""
    rows = F.transform("x", lambda e: F.array(*[e[c].cast("double") for c in inputs]))
    flat = F.flatten(rows)
    return df.withColumn("features", array_to_vector(flat) if as_vector else flat)


def tail(df: DataFrame, s: Series, k: int) -> DataFrame:
    """Last ``k`` rows of every series (each task keeps at most k before the shuffle)."""
    w = Window.partitionBy(*s.keys).orderBy(F.col(s.ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def seasonal_naive_scale(df: DataFrame, s: Series, target: str, season: int) -> DataFrame:
    """Mean absolute seasonal difference per series."""

    def build(w):
        return [F.abs(F.col(target) - F.lag(target, season).over(w)).alias("_d")]

    return framed(df, s, season, 0, build).groupBy(*s.keys).agg(F.avg("_d").alias("scale"))
