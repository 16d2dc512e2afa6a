"""Structured Streaming: incremental ingest, windows, latest state, drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from breezeline.operators.aggregate import bucket_aggregate
from breezeline.operators.evaluate import mape
from breezeline.operators.moments import finished, hour_moments, merge_moments
from breezeline.operators.rank import first_per_key
from breezeline.schema import METRICS
from breezeline.session import staged
from breezeline.sources.ingest import Warehouse, as_observations, record_run, write_observations
from breezeline.sources.payload import decode_payloads
from breezeline.sources.tables import (
    hash_part,
    new_watermarks,
    only_touched,
    read_if_there,
    upsert_table,
    within_days,
    write_dimension,
    write_run_rows,
    write_watermarks,
)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", per_batch: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def run_available(
    df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Drain what has arrived, batch by batch, then stop."""
    query = (
        df.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


#: Roll-ups kept next to the facts: table and unit; a unit's column has its name.
ROLLUPS = (("hourly", "hour"), ("daily", "day"), ("monthly", "month"))


def refresh_touched(
    spark: SparkSession, wh: Warehouse, touched: DataFrame, metrics: Sequence[str] = METRICS
) -> None:
    """Recompute the hours a batch touched from the facts, combine their days and months from
    stored moments, overwrite just these rows, and bring the latest row per city up to date;
    late and corrected rows therefore always end up right.

    Of the facts only the touched dates are read. Every write to them has to be followed by
    this; where there are facts but no moments yet, all of them are rolled up once."""
    facts = wh.read(spark, "observations")
    if facts is None:
        return
    hour = F.date_trunc("hour", "observed_at")
    hours = touched.select("city_slug", hour.alias("hour")).distinct()
    dates = touched.select(F.to_date("observed_at").alias("observed_date")).distinct()
    if wh.read(spark, "hourly_moments") is None:
        hours = facts.select("city_slug", hour.alias("hour")).distinct()
        dates = facts.select("observed_date").distinct()
    with staged(hours) as hours:
        rows = only_touched(facts, dates, "observed_date").withColumn("hour", hour)
        fresh = hour_moments(rows.join(hours, ["city_slug", "hour"], "left_semi"), ["city_slug"], "observed_at", metrics)
        _store_rollup(spark, wh, "hourly", "hour", fresh, metrics)
        for name, unit, source, inner in (("daily", "day", "hourly", "hour"), ("monthly", "month", "daily", "day")):
            # the whole units touched, and the stored dates they stand in
            bucket = F.date_trunc(unit, "hour").cast("date")
            units = hours.select("city_slug", bucket.alias(unit)).distinct()
            last = F.last_day(unit) if unit == "month" else F.col(unit)
            days = units.select(F.explode(F.sequence(F.col(unit), last)).alias("bucket_date")).distinct()
            parts = only_touched(wh.read(spark, f"{source}_moments"), days, "bucket_date")
            whole = F.date_trunc(unit, inner).cast("date")
            parts = parts.withColumn(unit, whole).join(units, ["city_slug", unit], "left_semi")
            _store_rollup(spark, wh, name, unit, merge_moments(parts, ["city_slug"], F.col(unit), unit, metrics), metrics)
    cities = touched.select("city_slug").distinct()
    dates = touched.select(F.to_date("observed_at").alias("observed_date")).distinct()
    now_there = only_touched(facts, dates, "observed_date").join(cities, "city_slug", "left_semi")
    newest = first_per_key(now_there, ["city_slug"], [F.col("observed_at").desc(), F.col("source")])
    cols = ["city_slug", "observed_at", "source", *metrics]
    keep_latest(spark, wh.path("latest"), newest.select(*cols), ["city_slug"], ["observed_at"])


def _store_rollup(
    spark: SparkSession, wh: Warehouse, name: str, unit: str, moments: DataFrame, metrics: Sequence[str]
) -> None:
    """Moments of a unit and the aggregates read off them, each upserted into the dates they belong to."""
    dated = moments.withColumn("bucket_date", F.to_date(unit))
    with staged(dated) as rows:
        for table, fresh in ((f"{name}_moments", rows), (name, finished(rows, ["city_slug"], unit, metrics))):
            fresh = fresh.withColumn("bucket_date", F.to_date(unit))
            upsert_table(
                spark, wh.path(table), fresh, ["city_slug", unit], ["updated_at"], ["bucket_date"], cluster_by=("city_slug", unit)
            )


def keep_latest(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int = 16
) -> None:
    """One row per key, the one of the largest ``order`` (a row of equal order replaces
    the stored one where it differs).  Rows that change nothing do not reach the write, so
    only partitions with a new row are rewritten."""
    with staged(rows) as rows:
        stored = read_if_there(spark, path)
        if stored is not None:
            # the table is hashed by key: only the parts that these keys fall into are opened
            stored = only_touched(stored, rows.select(hash_part(keys, parts).alias("part")), "part")
            old = stored.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias("_old"))
            mine = F.struct(*[c for c in rows.columns if c not in keys])
            place = F.struct(*[F.col(c) for c in order])
            before = F.struct(*[F.col(f"_old.{c}") for c in order])
            joined = rows.join(old, list(keys), "left")
            news = F.col("_old").isNull() | (place > before) | ((place == before) & ~mine.eqNullSafe(F.col("_old")))
            rows = joined.where(news).drop("_old")
        with staged(rows) as changed:
            write_dimension(spark, path, changed, keys, list(order), parts=parts)


def ingest_batches(
    spark: SparkSession, wh: Warehouse, cities: DataFrame, source: str, now: Column
) -> Callable[[DataFrame, int], None]:
    """Handler of one micro-batch of payload documents: decode, set bad documents aside,
    upsert, advance watermarks, ledger, refresh.  Writes are keyed by the batch id, so a
    replayed batch changes nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = f"stream-{batch_id:08d}"
        with staged(batch) as docs:
            good, bad = decode_payloads(docs)
            with staged(as_observations(good, cities, source, run, now)) as rows:
                load(rows, bad, run)

    def load(rows: DataFrame, bad: DataFrame, run: str) -> None:
        write_observations(spark, wh, rows, now)
        write_run_rows(spark, wh.path("quarantine"), bad.withColumn("run_id", F.lit(run)), now)
        write_watermarks(spark, wh.path("watermarks"), new_watermarks(rows, "city_slug", "observed_at", source), now)
        ok = rows.groupBy("city_slug").agg(F.count(F.lit(1)).alias("rows_fetched"))
        failed = bad.groupBy(F.lower(F.replace("city", F.lit(" "), F.lit("_"))).alias("city_slug")).agg(
            F.min("problem").alias("error")
        )
        details = ok.join(failed, "city_slug", "full").select(
            F.lit(run).alias("run_id"),
            "city_slug",
            F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"),
            F.coalesce("rows_fetched", F.lit(0)).alias("rows_fetched"),
            F.coalesce("rows_fetched", F.lit(0)).alias("rows_upserted"),
            "error",
        )
        record_run(spark, wh, details, run, "stream", now, now)
        refresh_touched(spark, wh, rows)

    return handle


def tumbling(df: DataFrame, keys: Sequence[str], ts: str, width: str, metrics: Sequence[str], delay: str | None = None) -> DataFrame:
    """Tumbling window aggregate; with ``delay`` the state of closed windows is dropped
    (append mode then emits closed windows only)."""
    d = df.withWatermark(ts, delay) if delay else df
    return d.groupBy(F.window(ts, width).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("observation_count"), *[F.avg(m).alias(f"{m}_avg") for m in metrics]
    ).select(*keys, F.col("w.start").alias("window_start"), "observation_count", *[f"{m}_avg" for m in metrics])


def sliding(df: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str, metrics: Sequence[str], delay: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, delay) if delay else df
    return d.groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("observation_count"), *[F.avg(m).alias(f"{m}_avg") for m in metrics]
    ).select(*keys, F.col("w.start").alias("window_start"), "observation_count", *[f"{m}_avg" for m in metrics])


def run_windows(df: DataFrame, checkpoint: str, path: str, keys: Sequence[str]) -> StreamingQuery:
    """Keep a table of window aggregates up to date: only windows that a batch changed
    leave the query, and are upserted by (keys, window_start) into the partition of their
    day.  ``df`` must carry a watermark, so that the state of closed windows is dropped.

    Rows later than the watermark are not counted here; where they matter, the touched
    windows are recomputed from the facts (``refresh_touched``)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch_id", F.lit(batch_id)).withColumn("window_date", F.to_date("window_start"))
        with staged(rows) as rows:
            upsert_table(spark, path, rows, [*keys, "window_start"], ["batch_id"], ["window_date"])

    query = (
        df.writeStream.foreachBatch(handle)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def latest_per_key_batches(
    spark: SparkSession, path: str, keys: Sequence[str], ts: str, ties: Sequence[str], parts: int = 16
) -> Callable[[DataFrame, int], None]:
    """Keep the newest row per key across batches."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = first_per_key(batch, keys, [F.col(ts).desc(), *[F.col(t).desc() for t in ties]])
        keep_latest(spark, path, newest, keys, [ts, *ties], parts)

    return handle


def touched_bucket_batches(
    spark: SparkSession, facts: str, buckets: str, key: Sequence[str], ts: str, order: Sequence[str],
    group: Sequence[str], metrics: Sequence[str],
) -> Callable[[DataFrame, int], None]:
    """Keyed upsert of the batch, then recompute of the hours it touched."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with staged(batch.withColumn("d", F.to_date(ts))) as rows:
            upsert_table(spark, facts, rows, key, order, ["d"])
            days = only_touched(spark.read.parquet(facts), rows, "d")
            fresh = bucket_aggregate(days, "hour", group, ts, metrics, stddev=()).withColumn(
                "d", F.to_date("hour")
            )
            upsert_table(spark, buckets, fresh, [*group, "hour"], ["updated_at"], ["d"])

    return handle


def enriched(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream joined to a static dimension."""
    return stream.join(dimension, key, "left")


def drift_batches(
    spark: SparkSession, path: str, forecasts: DataFrame, keys: Sequence[str], ts: str, actual: str,
    predicted: str, limit: float = 15.0, issue_date: str | None = None, longest_hours: int = 168,
) -> Callable[[DataFrame, int], None]:
    """Score arriving actuals against stored forecasts; one decision row per series and
    batch (``skip`` where a series of the batch met no forecast).

    Only forecasts for the batch's own time range are read; where they are partitioned by
    ``issue_date``, only the days from ``longest_hours`` before it on."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        low, high = batch.agg(F.min(ts), F.max(ts)).first()
        if low is None:
            return
        due = forecasts.where((F.col(ts) >= F.lit(low)) & (F.col(ts) <= F.lit(high)))
        if issue_date:
            due = within_days(due, issue_date, low - timedelta(hours=longest_hours), high)
        joined = batch.join(due, [*keys, ts]).dropna(subset=[actual, predicted])
        scored = batch.select(*keys).distinct().join(mape(joined, keys, actual, predicted), list(keys), "left")
        decision = F.when(F.col("mape").isNull(), "skip").when(F.col("mape") > limit, "retrain").otherwise("keep")
        scored = scored.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("decision", decision)
        write_run_rows(spark, path, scored.withColumn("batch_id", F.lit(batch_id)), F.current_timestamp(), "batch_id")

    return handle
