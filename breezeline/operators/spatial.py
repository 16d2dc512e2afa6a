"""Readings against those of the stations around."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.operators.blocks import Series, drop_helpers, framed
from breezeline.operators.quantiles import exact_quantiles
from breezeline.session import materialise

EARTH_KM = 6371.0


def _unit(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def neighbour_pairs(stations: DataFrame, key: str, lat: str, lon: str, radius_km: float) -> DataFrame:
    """(key, neighbour, km): every two different stations at most ``radius_km`` apart, in both directions.

    Stations are points of the unit sphere in a grid of cubes as wide as the radius' chord, so a neighbour stands in
    the same or an adjacent cube, over the poles and the date line as anywhere. One side is dealt to its 27 cubes and
    met by equality; the distance is checked on what meets. Stations without a place have no neighbours."""
    if not 0 < radius_km <= EARTH_KM * math.pi:
        raise ValueError("the radius must be above zero and within half the globe")
    chord = 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2)
    width = chord * (1 + 1e-9)
    placed = stations.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(key), *[c.alias(n) for c, n in zip(_unit(F.col(lat), F.col(lon)), "xyz")]
    )
    cells = {f"c{n}": F.floor(F.col(n) / width).cast("int") for n in "xyz"}
    home = placed.withColumns(cells)
    near = home
    for n in "xyz":
        near = near.withColumn(f"c{n}", F.explode(F.sequence(F.col(f"c{n}") - 1, F.col(f"c{n}") + 1)))
    other = home.select(F.col(key).alias("neighbour"), *[F.col(n).alias(f"o{n}") for n in "xyz"], *cells)
    met = near.join(other, list(cells)).where(F.col(key) != F.col("neighbour"))
    apart = F.sqrt(sum((F.pow(F.col(n) - F.col(f"o{n}"), 2) for n in "xyz"), F.lit(0.0)))
    km = 2 * EARTH_KM * F.asin(F.least(apart / 2, F.lit(1.0)))
    return met.withColumn("km", km).where(F.col("km") <= radius_km).select(key, "neighbour", "km")


# The polynomial of Abramowitz and Stegun 7.1.26, right to 1.5e-7.
_P = 0.3275911
_POLYNOMIAL = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_tail(z: Column) -> Column:
    """Two-sided tail probability of a standard normal value."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + _P * x)
    poly = F.lit(0.0)
    for c in reversed(_POLYNOMIAL):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def neighbour_residuals(
    df: DataFrame, s: Series, stations: DataFrame, metric: str, lat: str, lon: str, radius_km: float, past_rows: int = 24,
    least_tail: float = 0.05,
) -> DataFrame:
    """keys, ts, metric, neighbour_median, residual, scale, tail, outlier of every reading.

    The residual is what a reading stands above the median of its neighbours at that time, less what it stood above
    them on average over the ``past_rows`` rows before: a rise of a whole area moves no residual, nor does a station
    that is always higher. ``scale`` is the station's median absolute deviation times 1.4826 (as a normal spread), and
    a reading whose tail probability is below ``least_tail`` is an outlier. Without a neighbour's reading, earlier
    rows or a spread there is no residual, tail or verdict (outlier is null). One row per (keys, ts)."""
    (key,) = s.keys
    pairs = neighbour_pairs(stations, key, lat, lon, radius_km).select(key, "neighbour")
    known = df.select(key, s.ts, metric).where(F.col(metric).isNotNull())
    theirs = known.select(F.col(key).alias("neighbour"), s.ts, F.col(metric).alias("_theirs"))
    around = theirs.join(pairs, "neighbour").groupBy(key, s.ts).agg(F.median("_theirs").alias("neighbour_median"))
    above = known.join(around, [key, s.ts], "left").withColumn("_above", F.col(metric) - F.col("neighbour_median"))
    usual = framed(above, s, past_rows, 0, lambda w: [F.avg("_above").over(w.rowsBetween(-past_rows, -1)).alias("_usual")])
    told = materialise(drop_helpers(usual).withColumn("residual", F.col("_above") - F.col("_usual")).drop("_above", "_usual"))
    middle = exact_quantiles(told, [key], ["residual"], {"_middle": 0.5}).drop("metric")
    off = told.join(middle, key, "left").withColumn("_off", F.abs(F.col("residual") - F.col("_middle")))
    spread = exact_quantiles(off, [key], ["_off"], {"_spread": 0.5}).drop("metric")
    scaled = off.join(spread, key, "left").withColumn("scale", 1.4826 * F.col("_spread"))
    tail = normal_tail((F.col("residual") - F.col("_middle")) / F.nullif("scale", F.lit(0.0)))
    return scaled.withColumn("tail", tail).select(
        key, s.ts, metric, "neighbour_median", "residual", "scale", "tail", (F.col("tail") < least_tail).alias("outlier")
    )
