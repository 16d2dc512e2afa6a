"""Roll-ups that merge: per bucket and metric the count, sum, squared deviations, least and greatest value.

Hours are made from readings; days from the moments of their hours and months from those of their days, so a late
reading costs the hours it falls into and a few stored rows, not the readings of its month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_moments(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], spread: Sequence[str] = ("pm2_5", "pm10")
) -> DataFrame:
    """keys, hour, observation_count, and per metric ``_n``, ``_sum``, ``_min``, ``_max``; for the metrics in
    ``spread`` also ``_m2``, the squared deviations from the hour's own mean."""
    aggs = [F.count(F.lit(1)).alias("observation_count")]
    for m in metrics:
        aggs += [F.count(m).alias(f"{m}_n"), F.sum(m).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    aggs += [(F.var_pop(m) * F.count(m)).alias(f"{m}_m2") for m in spread]
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(*aggs)


def merge_moments(
    df: DataFrame, keys: Sequence[str], bucket: Column, name: str, metrics: Sequence[str],
    spread: Sequence[str] = ("pm2_5", "pm10"),
) -> DataFrame:
    """Moments of larger buckets from those of the smaller ones in them (24 hours, 31 days: a short list).

    The deviations of a whole are those within its parts and those of the parts' means from the whole's mean, so
    nothing cancels, whatever the level of the values."""
    aggs = [F.sum("observation_count").alias("observation_count")]
    for m in metrics:
        aggs += [
            F.sum(f"{m}_n").alias(f"{m}_n"), F.sum(f"{m}_sum").alias(f"{m}_sum"),
            F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"),
        ]
    for m in spread:
        part = F.struct(F.col(f"{m}_n").alias("n"), (F.col(f"{m}_sum") / F.nullif(f"{m}_n", F.lit(0))).alias("mean"))
        aggs += [F.sum(f"{m}_m2").alias(f"_{m}_within"), F.sort_array(F.collect_list(part)).alias(f"_{m}_parts")]
    merged = df.groupBy(*keys, bucket.alias(name)).agg(*aggs)
    for m in spread:
        mean = F.col(f"{m}_sum") / F.nullif(f"{m}_n", F.lit(0))
        held = F.filter(f"_{m}_parts", lambda p: p["n"] > 0)
        square = F.transform(held, lambda p: p["n"] * F.pow(p["mean"] - mean, F.lit(2)))  # noqa: B023  (used at once)
        between = F.aggregate(square, F.lit(0.0), lambda total, x: total + x)
        merged = merged.withColumn(f"{m}_m2", F.col(f"_{m}_within") + between).drop(f"_{m}_within", f"_{m}_parts")
    return merged


def finished(
    moments: DataFrame, keys: Sequence[str], name: str, metrics: Sequence[str], spread: Sequence[str] = ("pm2_5", "pm10")
) -> DataFrame:
    """The columns of a bucket aggregate: observation_count, avg, max, min, and the sample deviation of some."""
    out = [*keys, name, F.col("observation_count")]
    for m in metrics:
        out += [(F.col(f"{m}_sum") / F.nullif(f"{m}_n", F.lit(0))).alias(f"{m}_avg"), f"{m}_max", f"{m}_min"]
    out += [F.when(F.col(f"{m}_n") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col(f"{m}_n") - 1))).alias(f"{m}_stddev") for m in spread]
    return moments.select(*out)
