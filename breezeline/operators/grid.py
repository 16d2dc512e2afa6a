"""Regular time grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.operators.blocks import Series, drop_helpers
from breezeline.session import materialise


def _floor_to(seconds: int, ts: str):
    micros = F.unix_micros(F.col(ts))
    return (micros - F.pmod(micros, F.lit(seconds * 1_000_000))).cast("long")


def regular_grid(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Every step from the first to the last reading of a series, missing steps as null
    rows; readings off the grid are not taken.  Adds ``_blk``, ``_pos`` and ``_len``.

    Grid rows are made block by block (a long series is never one array in one task)
    and meet the readings in one aggregate on (series, block, step): a union with a
    single shuffle instead of a join.
    """
    step = s.step_seconds * 1_000_000
    span = s.span_micros
    bounds = (
        df.groupBy(*s.keys)
        .agg(F.min(_floor_to(s.step_seconds, s.ts)).alias("_a"), F.max(_floor_to(s.step_seconds, s.ts)).alias("_z"))
    )
    per_block = bounds.select(
        *s.keys,
        "_a",
        "_z",
        F.explode(F.sequence(F.floor(F.col("_a") / span), F.floor(F.col("_z") / span))).alias("_blk"),
    ).repartition(*s.keys, "_blk")
    skeleton = per_block.select(
        *s.keys,
        "_blk",
        F.explode(
            F.sequence(
                F.greatest(F.col("_a"), F.col("_blk") * span),
                F.least(F.col("_z"), (F.col("_blk") + 1) * span - step),
                F.lit(step),
            )
        ).alias("_t"),
        "_a",
        "_z",
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols],
    )
    readings = df.select(
        *s.keys,
        s.block().alias("_blk"),
        F.unix_micros(s.ts).alias("_t"),
        F.lit(None).cast("long").alias("_a"),
        F.lit(None).cast("long").alias("_z"),
        *cols,
    )
    return (
        skeleton.unionByName(readings)
        .repartition(*s.keys, "_blk")
        .groupBy(*s.keys, "_blk", "_t")
        .agg(F.max("_a").alias("_a"), F.max("_z").alias("_z"), *[F.max(c).alias(c) for c in cols])
        .where(F.col("_a").isNotNull())
        .select(
            *s.keys,
            F.timestamp_micros("_t").alias(s.ts),
            *cols,
            "_blk",
            ((F.col("_t") - F.col("_a")) / step).cast("long").alias("_pos"),
            ((F.col("_z") - F.col("_a")) / step + 1).cast("long").alias("_len"),
        )
    )


def bucket_mean(
    df: DataFrame, s: Series, cols: Sequence[str], seconds: int, cut: bool = False
) -> DataFrame:
    """Mean per regular bin; bins without a reading become null rows.  ``cut`` writes the
    bins out before they are read twice, for inputs that are dear to recompute."""
    binned = (
        df.withColumn("_bin", F.timestamp_micros(_floor_to(seconds, s.ts)))
        .groupBy(*s.keys, "_bin")
        .agg(*[F.avg(c).alias(c) for c in cols])
        .withColumnRenamed("_bin", s.ts)
    )
    binned = materialise(binned) if cut else binned
    return drop_helpers(regular_grid(binned, replace(s, step_seconds=seconds), cols))
