"""Scalers as parameter tables: fitted on training rows, joined to whatever is scaled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.operators.blocks import Series
from breezeline.operators.features import chronological_split, supervised_windows
from breezeline.operators.quantiles import exact_quantiles, long_metrics

KINDS = ("standard", "minmax", "robust", "none")


def fit_scaler(train: DataFrame, keys: Sequence[str], cols: Sequence[str], kind: str = "standard") -> DataFrame:
    """One row per (keys, metric): ``center`` and ``width``.  Population std; a zero
    width becomes 1."""
    if kind not in KINDS:
        raise ValueError(f"unknown scaler: {kind}")
    by = [*keys, "metric"]
    if kind == "robust":
        q = exact_quantiles(train, keys, cols, {"a": 0.25, "m": 0.5, "b": 0.75})
        fitted = q.select(*by, F.col("m").alias("center"), (F.col("b") - F.col("a")).alias("width"))
    else:
        lo, hi = F.min("value"), F.max("value")
        center, width = {
            "standard": (F.avg("value"), F.stddev_pop("value")),
            "minmax": (lo, hi - lo),
            "none": (F.max(F.lit(0.0)), F.max(F.lit(1.0))),
        }[kind]
        fitted = (
            long_metrics(train, keys, cols)
            .where("value is not null")
            .groupBy(*by)
            .agg(center.alias("center"), width.alias("width"))
        )
    return fitted.withColumn("width", F.when(F.col("width") == 0, F.lit(1.0)).otherwise(F.col("width")))


def _wide(scaler: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return scaler.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("metric") == c, F.col(part))).alias(f"_{part}_{c}")
            for c in cols
            for part in ("center", "width")
        ]
    )


def _transform(df, scaler, keys, cols, forward: bool) -> DataFrame:
    joined = df.join(_wide(scaler, keys, cols), list(keys), "left")

    def moved(c):
        center, width = F.col(f"_center_{c}"), F.col(f"_width_{c}")
        return (F.col(c) - center) / width if forward else F.col(c) * width + center

    return joined.select(*[moved(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def apply_scaler(df: DataFrame, scaler: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _transform(df, scaler, keys, cols, True)


def invert_scaler(df: DataFrame, scaler: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return _transform(df, scaler, keys, cols, False)


def build_dataset(
    df: DataFrame,
    s: Series,
    inputs: Sequence[str],
    target: str,
    lookback: int,
    horizon: int,
    kind: str = "standard",
    train: float = 0.70,
    val: float = 0.15,
) -> DataFrame:
    """Split, fit on the training part, scale everything with it, cut windows inside
    each split.  Series too short for a window in a split simply have none there;
    ``too_short`` names them."""
    split = chronological_split(df, s, train, val, keep_helpers=True)
    cols = list(dict.fromkeys([*inputs, target]))
    scaler = fit_scaler(split.where("split = 'train'"), s.keys, cols, kind)
    scaled = apply_scaler(split, scaler, s.keys, cols)
    return supervised_windows(scaled, s, inputs, target, lookback, horizon)


def too_short(df: DataFrame, s: Series, need: int) -> DataFrame:
    """Series with fewer than ``need`` rows."""
    return (
        df.groupBy(*s.keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where(F.col("row_count") < need)
        .withColumn("status", F.lit("insufficient_history"))
    )
