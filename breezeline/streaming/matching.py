"""Streams met with streams: forecasts with the readings they are due for, and readings with the silence between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from breezeline.sources.tables import upsert_table, write_run_rows


def matched_forecasts(
    forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], due: str, issued: str, actual: str, predicted: str,
    longest_hours: int = 168, delay: str = "6 hours",
) -> DataFrame:
    """Join a stream of forecasts with a stream of readings by (keys, ``due``), in whichever order they arrive.

    A forecast is due after it was issued and at most ``longest_hours`` later. With that bound and a watermark on each
    side, a forecast leaves the state once no reading can be due for it any more, and a reading once no forecast
    issued before it can still come, so the state holds about the longest horizon, whatever the length of the stream.
    ``delay`` is how late rows of either stream may be. Rows without a value match nothing."""
    left = forecasts.where(F.col(predicted).isNotNull()).withWatermark(issued, delay).alias("f")
    right = actuals.where(F.col(actual).isNotNull()).withWatermark(due, delay).alias("a")
    same = [F.col(f"f.{k}") == F.col(f"a.{k}") for k in [*keys, due]]
    bound = [
        F.col(f"a.{due}") >= F.col(f"f.{issued}"),
        F.col(f"a.{due}") <= F.col(f"f.{issued}") + F.expr(f"INTERVAL {longest_hours} HOURS"),
    ]
    condition = same[0]
    for part in [*same[1:], *bound]:
        condition = condition & part
    return left.join(right, condition).select(*[F.col(f"f.{c}") for c in forecasts.columns], F.col(f"a.{actual}"))


def run_matched_drift(
    matched: DataFrame, checkpoint: str, path: str, keys: Sequence[str], actual: str, predicted: str
) -> StreamingQuery:
    """Drain the matched pairs and keep, per series and batch, how many there were and the sum of their relative
    errors; a batch that runs again replaces its rows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        share = F.when(F.col(actual) != 0, F.abs(F.col(predicted) - F.col(actual)) / F.col(actual))
        sums = batch.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count(share).alias("measured"), F.coalesce(F.sum(share), F.lit(0.0)).alias("total")
        )
        write_run_rows(batch.sparkSession, path, sums.withColumn("batch_id", F.lit(batch_id)), F.current_timestamp(), "batch_id")

    query = (
        matched.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drift_so_far(spark: SparkSession, path: str, keys: Sequence[str], limit: float = 15.0) -> DataFrame:
    """Percentage error and decision of every series over all batches."""
    sums = spark.read.parquet(path).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("measured").alias("measured"), F.sum("total").alias("total")
    )
    mape = F.coalesce(F.try_divide(F.col("total") * 100.0, "measured"), F.lit(0.0))
    return sums.select(*keys, mape.alias("mape"), "n", F.when(mape > limit, "retrain").otherwise("keep").alias("decision"))


def reading_sessions(stream: DataFrame, keys: Sequence[str], ts: str, step_seconds: int, delay: str) -> DataFrame:
    """Unbroken runs of readings: a run ends where the next reading is more than a step away.

    The state holds the open runs of each series as one row each; a run leaves it once the watermark has passed its
    end."""
    gap = f"{step_seconds} seconds 1 microsecond"
    return stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("first_reading"), F.max(ts).alias("last_reading"), F.count(F.lit(1)).alias("readings")
    ).drop("w")


def run_sessions(sessions: DataFrame, checkpoint: str, path: str, keys: Sequence[str]) -> StreamingQuery:
    """Keep a table of closed runs, by (keys, first_reading), in the partition of the day they began."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"batch_id": F.lit(batch_id), "first_date": F.to_date("first_reading")})
        upsert_table(batch.sparkSession, path, rows, [*keys, "first_reading"], ["batch_id"], ["first_date"])

    query = (
        sessions.writeStream.foreachBatch(handle)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def outages(runs: DataFrame, keys: Sequence[str], step_seconds: int) -> DataFrame:
    """keys, gap_start, gap_end, gap_rows: the missing steps between one run of readings and the next.

    Only runs are ordered here, one row per stretch without a gap."""
    w = Window.partitionBy(*keys).orderBy("first_reading")
    step = F.expr(f"INTERVAL {step_seconds} SECONDS")
    after = runs.select(*keys, "last_reading", F.lead("first_reading").over(w).alias("_next")).where("_next IS NOT NULL")
    apart = F.unix_timestamp("_next") - F.unix_timestamp("last_reading")
    return after.select(
        *keys,
        (F.col("last_reading") + step).alias("gap_start"),
        (F.col("_next") - step).alias("gap_end"),
        (F.floor(apart / step_seconds) - 1).cast("long").alias("gap_rows"),
    )
