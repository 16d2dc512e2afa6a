"""Normalising incoming frames: columns, times, numbers, duplicates, read windows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.functions.numeric import to_double
from breezeline.operators.rank import first_per_key
from breezeline.schema import METRICS, RAW_OBSERVATIONS, require_columns
from breezeline.session import materialise


def parse_time(x: Column | str, strict: bool = True) -> Column:
    """Strict parsing fails the job on a bad time; lenient gives null."""
    col = F.col(x) if isinstance(x, str) else x
    text = col.cast("string")
    return F.to_timestamp(text) if strict else F.try_to_timestamp(text)


def normalise_observations(df: DataFrame, strict: bool = True) -> DataFrame:
    """The fixed nine columns; extra ones dropped, missing ones an error."""
    require_columns(df, RAW_OBSERVATIONS.fieldNames(), "observations")
    out = df.select(
        F.col("city").cast("string").alias("city"),
        parse_time("timestamp", strict).alias("timestamp"),
        *[to_double(F.col(m).cast("string")).alias(m) for m in METRICS],
    )
    return out if strict else out.dropna(subset=["timestamp"])


def coerce_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c).cast("string")) for c in cols})


def repair_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Rename columns that differ from the expected ones only in case or spacing."""

    def plain(name: str) -> str:
        return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")

    wanted = {plain(e): e for e in expected}
    present = set(df.columns)
    mapping = {
        c: wanted[plain(c)] for c in df.columns if plain(c) in wanted and wanted[plain(c)] not in present
    }
    return df.withColumnsRenamed(mapping)


def pick_column(columns: Sequence[str], words: Sequence[str]) -> str | None:
    """First column whose lower-case name contains all words."""
    return next((c for c in columns if all(w in c.lower() for w in words)), None)


# Words that identify a metric column of a station file.
STATION_COLUMNS = {
    "pm2_5": ("pm2", "5"),
    "pm10": ("pm10",),
    "no2": ("no2",),
    "so2": ("so2",),
    "co_mg_m3": ("co", "mg"),
    "ozone": ("ozone",),
    "temperature_c": ("at",),
    "humidity_pct": ("rh",),
}
# Sensor feed fields and the metrics they carry.
SENSOR_FIELDS = {
    "field1": "pm2_5",
    "field2": "pm10",
    "field3": "temperature",
    "field4": "humidity",
}
# Sensor readings above these are faults.
SENSOR_LIMITS = {"pm2_5": 500.0, "pm10": 500.0, "temperature": 50.0, "humidity": 100.0}


def station_frame(
    df: DataFrame, target: Column, source_url: Column, words: dict[str, Sequence[str]] = STATION_COLUMNS,
    time_words: Sequence[str] = ("timestamp",),
) -> DataFrame:
    """Map a station file with its own column names onto the station schema."""
    time_col = pick_column(df.columns, time_words)
    if time_col is None:
        raise ValueError("no timestamp column")

    def metric(name: str) -> Column:
        found = pick_column(df.columns, words[name])
        if found is None:
            return F.lit(None).cast("double").alias(name)
        return to_double(F.col(f"`{found}`").cast("string")).alias(name)

    return df.select(
        target.alias("station_target"),
        parse_time(F.col(f"`{time_col}`"), strict=False).alias("timestamp"),
        *[metric(name) for name in words],
        source_url.alias("source_url"),
    ).dropna(subset=["timestamp"])


def rename_sensor_fields(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SENSOR_FIELDS)


def trailing_days(df: DataFrame, keys: Sequence[str], ts: str, days: int = 365) -> DataFrame:
    """Rows within ``days`` of the newest row of their own series.

    The newest times, one row per series, are found first and written out. A join with the bare aggregate is
    planned before its size is known, deals all rows out by key, and puts a whole series into one task that AQE
    does not split; with the table, few series go to the rows, and a join of many is one that AQE can split."""
    newest = materialise(df.groupBy(*keys).agg(F.max(ts).alias("_newest")))
    edge = F.col("_newest") - F.make_dt_interval(F.lit(days))
    return df.join(newest, list(keys)).where(F.col(ts) >= edge).drop("_newest")


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in a total order."""
    return first_per_key(df, keys, order)


def split_by_history(df: DataFrame, keys: Sequence[str], need: int) -> tuple[DataFrame, DataFrame]:
    """(rows of series with enough history, one row per series without)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    enough = df.join(counts.where(F.col("row_count") >= need).select(*keys), list(keys), "left_semi")
    short = counts.where(F.col("row_count") < need).withColumn("status", F.lit("insufficient_history"))
    return enough, short


def read_window(
    watermarks: DataFrame, run_end: Column, overlap_hours: int = 6, lookback_hours: int = 24
) -> DataFrame:
    """Where each series resumes reading: no watermark looks back a day, otherwise the
    overlap is re-read; a start at or past the end falls back to the last hour."""
    start = F.when(
        F.col("last_observed_at").isNull(), run_end - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    ).otherwise(F.col("last_observed_at") - F.make_dt_interval(F.lit(0), F.lit(overlap_hours)))
    hour_before = run_end - F.make_dt_interval(F.lit(0), F.lit(1))
    return watermarks.withColumn("window_start", F.when(start >= run_end, hour_before).otherwise(start)).withColumn(
        "window_end", run_end
    )
