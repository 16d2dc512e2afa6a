"""Exact quantiles without holding a group's values in one task.

Readings are counted in ordered cells of a relative grid (map-side combine, nothing but
counts is shuffled); a running count over the cells finds the one or two that hold each
wanted rank.  Each such cell is cut into even finer ones between its own least and
largest value, and counted again.  Only the readings of the finer cells that hold a
wanted rank are shuffled, equal ones as one row, and ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CELLS_PER_EFOLD = 2048
FINE_CELLS = 4096


def _cell(v: Column) -> Column:
    """A non-decreasing integer function of the value, fine on a relative scale."""
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * CELLS_PER_EFOLD)).cast("long")


def long_metrics(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, metric, value) rows, nulls kept."""
    return df.select(
        *by,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]
            )
        ).alias("_m"),
    ).select(*by, "_m.metric", "_m.value")


def _running(start: Column, count: str, within: Sequence[str], order: str) -> Column:
    """Rows before a cell: those before the first one and those of the cells in between."""
    along = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return start + F.coalesce(F.sum(count).over(along), F.lit(0))


def wanted_readings(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """The readings of the finer cells that hold a wanted rank, equal ones counted, with
    their cell, the rows before it (``_base``) and the group's rows (``_total``)."""
    keys = ["_by", "metric"]
    group = F.struct(*by) if by else F.lit(0)

    def holds(count: str) -> Column:
        found = F.lit(False)
        for p in probs.values():
            rank = (F.col("_total") - 1) * F.lit(float(p))
            for end in (F.floor(rank), F.ceil(rank)):
                found = found | ((F.col("_base") <= end) & (end < F.col("_base") + F.col(count)))
        return found

    values = (
        long_metrics(df, by, cols)
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .select(group.alias("_by"), "metric", "value", _cell(F.col("value")).alias("_cell"))
    )
    cells = values.groupBy(*keys, "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    placed = cells.withColumns(
        {"_base": _running(F.lit(0), "_n", keys, "_cell"), "_total": F.sum("_n").over(Window.partitionBy(*keys))}
    )
    inside = values.join(placed.where(holds("_n")).drop("_n"), [*keys, "_cell"])
    share = (F.col("value") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    even = F.least(F.lit(FINE_CELLS - 1), F.floor(share * FINE_CELLS))
    inside = inside.withColumn("_fine", F.when(F.col("_high") > F.col("_low"), even).otherwise(0).cast("long"))
    inside = inside.drop("_low", "_high")
    cell = [*keys, "_cell"]
    fine = inside.groupBy(*cell, "_fine", "_base", "_total").agg(F.count(F.lit(1)).alias("_n"))
    fine = fine.withColumn("_base", _running(F.col("_base"), "_n", cell, "_fine"))
    wanted = fine.where(holds("_n")).select(*cell, "_fine", "_base", "_total")
    return (
        inside.select(*cell, "_fine", "value")
        .join(wanted, [*cell, "_fine"])
        .groupBy(*cell, "_fine", "_base", "_total", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def order_statistics(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """One row per (by, metric): for each name in ``probs`` the two readings around that
    quantile (``lo_``, ``hi_``) and the share of the way between them (``share_``).
    Groups without a value are absent.  The group columns travel as one struct, which
    also equals itself where a column is null."""
    keys = ["_by", "metric"]
    rank = {name: (F.col("_total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    readings = wanted_readings(df, by, cols, probs)
    start = _running(F.col("_base"), "_n", [*keys, "_cell", "_fine"], "value")
    ranked = readings.withColumn("_start", start)

    def at(position: Column) -> Column:
        here = (F.col("_start") <= position) & (position < F.col("_start") + F.col("_n"))
        return F.max(F.when(here, F.col("value")))

    return (
        ranked.groupBy(*keys, "_total")
        .agg(
            *[
                agg
                for name in probs
                for agg in (
                    at(F.floor(rank[name])).alias(f"lo_{name}"),
                    at(F.ceil(rank[name])).alias(f"hi_{name}"),
                )
            ]
        )
        .select(
            *[F.col(f"_by.{c}").alias(c) for c in by],
            "metric",
            *[f"{end}_{name}" for name in probs for end in ("lo", "hi")],
            *[(rank[name] - F.floor(rank[name])).alias(f"share_{name}") for name in probs],
        )
    )


def between(lo: Column, hi: Column, share: Column) -> Column:
    return lo + (hi - lo) * share


def exact_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """One row per (by, metric) with a linearly interpolated quantile per name."""
    return order_statistics(df, by, cols, probs).select(
        *by,
        "metric",
        *[
            between(F.col(f"lo_{name}"), F.col(f"hi_{name}"), F.col(f"share_{name}")).alias(name)
            for name in probs
        ],
    )


def wide_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: dict[str, float]
) -> DataFrame:
    """Same, one row per group with columns ``<name>_<metric>``."""
    return widen(exact_quantiles(df, by, cols, probs), by, cols, list(probs))


def widen(q: DataFrame, by: Sequence[str], cols: Sequence[str], names: Sequence[str]) -> DataFrame:
    return q.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("metric") == c, F.col(name))).alias(f"{name}_{c}")
            for name in names
            for c in cols
        ]
    )
