"""Bootstrap and incremental ingest: rows, archive, upsert, watermarks, run ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.functions.text import city_slug
from breezeline.operators.aggregate import run_rollup
from breezeline.schema import METRICS, OBSERVATION_KEY, OVERLAP_HOURS, RAW_OBSERVATIONS
from breezeline.session import staged
from breezeline.sources.clean import normalise_observations, read_window, repair_columns
from breezeline.sources.tables import (
    archive_csv,
    new_watermarks,
    read_if_there,
    upsert_table,
    within_days,
    write_run_rows,
    write_watermarks,
)


@dataclass(frozen=True)
class Warehouse:
    """Folder layout of the tables."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        return read_if_there(spark, self.path(table))


def as_observations(rows: DataFrame, cities: DataFrame, source: str, run: str, ingested_at: Column) -> DataFrame:
    """Normalised rows of known cities in the fact-table layout.  Unknown names go out
    by the inner join (``cities`` carries city_slug, city_name)."""
    known = cities.select("city_slug", "city_name")
    return (
        rows.withColumn("city_slug", city_slug("city"))
        .join(known, "city_slug")
        .select(
            "city_slug",
            "city_name",
            F.col("timestamp").alias("observed_at"),
            *METRICS,
            F.lit(source).alias("source"),
            ingested_at.alias("ingested_at"),
            F.lit(run).alias("run_id"),
        )
    )


def write_observations(spark: SparkSession, wh: Warehouse, rows: DataFrame, now: Column) -> None:
    upsert_table(
        spark,
        wh.path("observations"),
        rows.withColumn("observed_date", F.to_date("observed_at")),
        list(OBSERVATION_KEY),
        ["ingested_at", "run_id"],
        ["observed_date"],
        now,
        cluster_by=("city_slug", "observed_at"),
    )


def record_run(
    spark: SparkSession, wh: Warehouse, details: DataFrame, run: str, pipeline: str, started: Column, now: Column
) -> None:
    """Per-series outcome rows, and the roll-up row of the run."""
    write_run_rows(spark, wh.path("run_details"), details, now)
    runs = run_rollup(details).select(
        "run_id",
        F.lit(pipeline).alias("pipeline_name"),
        started.alias("started_at"),
        now.alias("finished_at"),
        "status",
        "cities_total",
        "cities_succeeded",
        "cities_failed",
        "rows_fetched",
        "rows_upserted",
    )
    write_run_rows(spark, wh.path("runs"), runs, now)


def bootstrap_csv(
    spark: SparkSession,
    wh: Warehouse,
    path: str,
    cities: DataFrame,
    run: str,
    source: str,
    now: Column,
    archive: bool = True,
) -> None:
    """Whole-file load: repair names, drop unreadable times, keep known cities, archive,
    upsert, watermarks, ledger — one job per table, whatever the number of cities."""
    raw = repair_columns(spark.read.option("header", True).csv(path), RAW_OBSERVATIONS.fieldNames())
    rows = as_observations(normalise_observations(raw, strict=False), cities, source, run, now)
    with staged(rows) as rows:  # read once, used by four writes
        _load(spark, wh, rows, run, source, now, archive)


def _load(
    spark: SparkSession, wh: Warehouse, rows: DataFrame, run: str, source: str, now: Column, archive: bool
) -> None:
    if archive:
        archive_csv(rows.drop("run_id"), wh.path("archive"), "city_slug", run, now)
    write_observations(spark, wh, rows, now)
    marks = new_watermarks(rows, "city_slug", "observed_at", source, OVERLAP_HOURS)
    write_watermarks(spark, wh.path("watermarks"), marks, now)
    details = rows.groupBy("city_slug").agg(F.count(F.lit(1)).alias("rows_fetched")).select(
        F.lit(run).alias("run_id"),
        "city_slug",
        F.lit("success").alias("status"),
        "rows_fetched",
        F.col("rows_fetched").alias("rows_upserted"),
        F.lit(None).cast("string").alias("error"),
    )
    record_run(spark, wh, details, run, "bootstrap", now, now)


def incremental_cycle(
    spark: SparkSession, wh: Warehouse, available: DataFrame, cities: DataFrame, run: str, source: str,
    run_end: Column, now: Column, date_col: str | None = None,
) -> None:
    """One full incremental run: stored watermarks, each series' read window (look-back
    without a mark, overlap behind it, clamped to the last hour), the rows in it, upsert,
    watermarks that never move back, refreshed roll-ups, ledger.

    ``available`` is what the source offers (city, timestamp, metrics).  A repeated or
    overlapping run changes nothing it has no new values for."""
    from breezeline.streaming.jobs import refresh_touched

    marks = wh.read(spark, "watermarks")
    named = available.withColumn("city_slug", city_slug("city"))
    due = incremental_rows(named, cities, marks, run_end, "city_slug", "timestamp", date_col)
    fresh = as_observations(due.drop("city_slug"), cities, source, run, now)
    with staged(fresh) as rows:
        write_observations(spark, wh, rows, now)
        new = new_watermarks(rows, "city_slug", "observed_at", source, OVERLAP_HOURS)
        write_watermarks(spark, wh.path("watermarks"), new, now)
        refresh_touched(spark, wh, rows)
        counted = rows.groupBy("city_slug").agg(F.count(F.lit(1)).alias("rows_fetched"))
        n = F.coalesce("rows_fetched", F.lit(0))
        details = cities.select("city_slug").join(counted, "city_slug", "left").select(
            F.lit(run).alias("run_id"),
            "city_slug",
            F.lit("success").alias("status"),
            n.alias("rows_fetched"),
            n.alias("rows_upserted"),
            F.lit(None).cast("string").alias("error"),
        )
        record_run(spark, wh, details, run, "incremental", run_end, now)


def incremental_rows(
    available: DataFrame, series: DataFrame, watermarks: DataFrame | None, run_end: Column, key: str, ts: str,
    date_col: str | None = None,
) -> DataFrame:
    """Rows inside each series' own read window.  The earliest window start and the run
    end, one row, bound the scan (and its days, where ``date_col`` partitions them) before
    the rows meet their windows."""
    if watermarks is None:
        marked = series.select(key).withColumn("last_observed_at", F.lit(None).cast("timestamp"))
    else:
        marked = series.select(key).join(watermarks.select(key, "last_observed_at"), key, "left")
    windows = read_window(marked, run_end)
    bounds = windows.agg(F.min("window_start"), F.max("window_end")).first()
    if bounds[0] is not None:
        available = available.where((F.col(ts) >= F.lit(bounds[0])) & (F.col(ts) <= F.lit(bounds[1])))
        if date_col:
            available = within_days(available, date_col, *bounds)
    return (
        available.join(windows, key)
        .where((F.col(ts) >= F.col("window_start")) & (F.col(ts) <= F.col("window_end")))
        .drop("window_start", "window_end", "last_observed_at")
    )
