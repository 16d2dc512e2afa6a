"""Latest rows, deduplication, ranking and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from breezeline.operators.blocks import global_positions


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key.  Spark keeps only k rows per key in every map task, so
    a hot key is cut down before the shuffle.  ``order`` must be a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def ranked_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def latest(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[Column] = (), within: str | None = None,
    as_of: Column | None = None, date_col: str | None = None,
) -> DataFrame:
    """Newest row per key, optionally only among rows not older than ``within`` (and, with
    ``date_col``, the date partition column, without opening older days)."""
    d = df
    if within is not None:
        bound = as_of - F.expr(f"INTERVAL {within}")
        d = d.where(F.col(ts) >= bound)
        d = d.where(F.col(date_col) >= bound.cast("date")) if date_col else d
    return first_per_key(d, keys, [F.col(ts).desc(), *ties])


def newest_file_rows(df: DataFrame, kind: str, modified: str) -> DataFrame:
    """All rows of the newest file of each kind."""
    newest = df.groupBy(kind).agg(F.max(modified).alias("_newest"))
    return df.join(newest, kind).where(F.col(modified) == F.col("_newest")).drop("_newest")


def rank_by_value(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """Position by value, highest first, null counted as zero."""
    return global_positions(df, [F.coalesce(F.col(value), F.lit(0.0)).desc(), F.col(tie)], name)


def best_by(df: DataFrame, keys: Sequence[str], metric: str, ties: Sequence[Column]) -> DataFrame:
    """Row with the smallest finite metric per key."""
    x = F.col(metric)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return first_per_key(df.where(finite), keys, [x.asc(), *ties])


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def sort_option(option: str) -> list[Column]:
    """The three orders of the city grid."""
    orders = {
        "aqi": [F.coalesce("current_aqi", F.lit(0.0)).desc()],
        "pm2_5": [F.coalesce("pm2_5", F.lit(0.0)).desc()],
        "name": [F.col("city_name").asc()],
    }
    if option not in orders:
        raise ValueError(f"unknown sort option: {option}")
    return [*orders[option], F.col("city_slug").asc()]
