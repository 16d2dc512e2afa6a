"""Read-side reports: city report, ranking, trends, prediction timeline, snapshots."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from breezeline.functions import bands
from breezeline.functions.numeric import round_half_up_floor
from breezeline.functions.text import model_attribute
from breezeline.operators.joins import timeline as union_timeline
from breezeline.operators.rank import first_per_key, rank_by_value

# Accepted ranges and the hours they mean.
RANGES = {"24h": 24, "7d": 168, "30d": 720}


def range_hours(choice: str | None) -> int:
    return RANGES.get(choice or "", 24)


def range_days(hours: int) -> int:
    return -(-hours // 24)


def in_range(hourly: DataFrame, as_of: Column, hours: int, ts: str = "hour") -> DataFrame:
    return hourly.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def metric_columns(df: DataFrame, metric: str, keep: Sequence[str]) -> DataFrame:
    """Only the columns whose name contains the metric."""
    return df.select(*[c for c in df.columns if c in keep or metric in c])


def trend_over_range(hourly: DataFrame, keys: Sequence[str], ts: str = "hour", value: str = "us_aqi_avg") -> DataFrame:
    """Last minus first hourly mean, percent, per-row slope and direction; fewer than
    two rows are stable with zeros."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    ends = hourly.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(v, ts).alias("_last"), F.min_by(v, ts).alias("_first")
    )
    change = F.col("_last") - F.col("_first")
    percent = F.when(F.col("_first") != 0, change / F.col("_first") * 100.0).otherwise(F.lit(0.0))
    few = F.col("_n") < 2
    zero = F.lit(0.0)
    return ends.select(
        *keys,
        F.when(few, "stable").otherwise(bands.percent_direction(change, percent)).alias("direction"),
        F.when(few, zero).otherwise(round_half_up_floor(change / F.col("_n"), 2)).alias("slope"),
        F.when(few, zero).otherwise(round_half_up_floor(percent, 1)).alias("change_percent"),
        F.when(few, zero).otherwise(round_half_up_floor(change, 1)).alias("change_absolute"),
    )


def ranked_cities(latest: DataFrame, value: str = "us_aqi") -> DataFrame:
    """Latest readings ranked worst first with category and colour."""
    ranked = rank_by_value(latest, value, "city_slug")
    name = bands.category(value)
    return ranked.withColumn("category", name).withColumn("color", bands.category_color(name))


def city_report(
    latest: DataFrame, hourly: DataFrame, as_of: Column, hours: int = 24, key: str = "city_slug"
) -> DataFrame:
    """Current reading, category, advice and trend for all cities at once; filter on the
    result, the optimizer carries it down."""
    recent = in_range(hourly, as_of, hours)
    trend = trend_over_range(recent, [key])
    name = bands.category_inclusive("us_aqi")
    return latest.join(trend, key, "left").select(
        key,
        "observed_at",
        "us_aqi",
        name.alias("category"),
        bands.advisory(name).alias("advice"),
        bands.advisory(name, "sensitive_groups").alias("advice_sensitive"),
        bands.advisory(name, "children").alias("advice_children"),
        F.coalesce("direction", F.lit("stable")).alias("direction"),
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
        F.coalesce("change_percent", F.lit(0.0)).alias("change_percent"),
    )


def next_forecasts(forecasts: DataFrame, as_of: Column, key: str = "city_slug", k: int = 168) -> DataFrame:
    """The next ``k`` forecast points of every city, from ``as_of`` on."""
    due = forecasts.where(F.col("horizon_timestamp") >= as_of)
    return first_per_key(due, [key], [F.col("horizon_timestamp").asc(), F.col("forecast_id").asc()], k)


def prediction_timeline(
    hourly: DataFrame, forecasts: DataFrame, as_of: Column, key: str = "city_slug", k: int = 168
) -> DataFrame:
    """24 hours of actuals, then the next predictions with their uncertainty."""
    shown = F.col("us_aqi_avg").isNotNull() & (F.col("us_aqi_avg") != 0)
    past = in_range(hourly, as_of, 24).select(
        key,
        F.col("hour").alias("timestamp"),
        F.when(shown, round_half_up_floor("us_aqi_avg")).alias("actual_aqi"),
        F.lit(0.0).alias("uncertainty"),
    )
    future = next_forecasts(forecasts, as_of, key, k).select(
        key,
        F.col("horizon_timestamp").alias("timestamp"),
        round_half_up_floor("predicted_us_aqi").alias("predicted_aqi"),
        round_half_up_floor(bands.uncertainty("confidence")).alias("uncertainty"),
        "model_type",
        "confidence",
    )
    return union_timeline(past, future)


def prediction_summary(line: DataFrame, key: str = "city_slug", points: int = 4, margin: float = 5.0) -> DataFrame:
    """Current value, mean of the first forecast points, trend label, model shown."""
    future = line.where(F.col("predicted_aqi").isNotNull())
    head = (
        first_per_key(future, [key], [F.col(c).asc() for c in ("timestamp", "model_type", "predicted_aqi")], points)
        .groupBy(key)
        .agg(F.avg("predicted_aqi").alias("next_mean"))
    )
    usable_conf = F.col("confidence").isNotNull() & (F.col("confidence") != 0)
    last = F.struct("timestamp", "model_type", "predicted_aqi")
    newest = line.groupBy(key).agg(
        F.max_by("actual_aqi", F.when(F.col("actual_aqi").isNotNull(), F.col("timestamp"))).alias("_cur"),
        F.max_by("model_type", F.when(F.col("model_type").isNotNull(), last)).alias("_model"),
        F.max_by("confidence", F.when(usable_conf, last)).alias("_conf"),
        F.count("predicted_aqi").alias("forecast_points"),
    )
    current = F.coalesce("_cur", F.lit(0.0))
    mean = F.coalesce("next_mean", F.lit(0.0))
    return newest.join(head, key, "left").select(
        key,
        current.alias("current_aqi"),
        mean.alias("next_mean"),
        bands.against_band(mean, current, margin).alias("trend"),
        F.when(F.col("forecast_points") > 0, F.coalesce("_model", F.lit("No Model Available")))
        .otherwise("Awaiting Training")
        .alias("model_name"),
        F.coalesce("_conf", F.lit(0.0)).alias("model_confidence"),
        "forecast_points",
    )


def half_window_trend(points: DataFrame, keys: Sequence[str], hour: str, value: str, margin: float = 2.0) -> DataFrame:
    """First twelve hours against the next twelve."""
    h = F.col(hour)
    halves = points.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(h.between(1, 12), F.col(value))), F.lit(0.0)).alias("first_mean"),
        F.coalesce(F.avg(F.when(h.between(13, 24), F.col(value))), F.lit(0.0)).alias("second_mean"),
    )
    return halves.withColumn("trend", bands.against_band("second_mean", "first_mean", margin))


def least_squares_trend(points: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Slope per hour, direction, mean, peak and risk band of a forecast path."""
    fit = points.groupBy(*keys).agg(
        F.coalesce(F.regr_slope(F.col(value), F.col(index).cast("double")), F.lit(0.0)).alias("slope_per_hour"),
        F.avg(value).alias("mean_forecast_aqi"),
        F.max(value).alias("max_forecast_aqi"),
    )
    return fit.withColumn("trend_direction", bands.slope_direction("slope_per_hour")).withColumn(
        "risk_band", bands.risk_band("max_forecast_aqi")
    )


def snapshot_documents(predictions: DataFrame, model: str, generated_at: Column, key: str = "city_slug") -> DataFrame:
    """One nested document per (model, city) with its forecast path.

    A path has ``horizon`` points, so the array is bounded; one document for all cities
    would not be."""
    point = F.struct(
        F.col("horizon_hours").cast("int").alias("hour"),
        F.date_format("horizon_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.round("predicted", 2).alias("pm2_5"),
    )
    body = predictions.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("forecasts"))
    entry = F.struct(
        F.initcap(F.replace(F.col(key), F.lit("_"), F.lit(" "))).alias("city_name"),
        "forecasts",
        F.lit(None).cast("string").alias("error"),
    )
    return body.select(
        F.lit(model).alias("model"),
        model_attribute(F.lit(model), "name").alias("model_name"),
        model_attribute(F.lit(model), "family").alias("model_family"),
        model_attribute(F.lit(model), "tier").alias("tier"),
        F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.create_map(F.col(key), entry).alias("predictions"),
    )


def snapshot_timeline(documents: DataFrame) -> DataFrame:
    """Documents back to rows: the first value as current point (hour 0), then the path."""
    city = documents.select("model", "generated_at", F.explode("predictions").alias("city", "_p"))
    path = city.select(
        "model", "city", "generated_at", F.explode("_p.forecasts").alias("_f")
    )
    future = path.select(
        "model",
        "city",
        F.col("_f.timestamp").alias("timestamp"),
        F.col("_f.hour").alias("hour"),
        F.col("_f.pm2_5").alias("predicted_pm2_5"),
        F.lit(None).cast("double").alias("actual_aqi"),
    )
    current = city.where(F.size("_p.forecasts") > 0).select(
        "model",
        "city",
        F.col("generated_at").alias("timestamp"),
        F.lit(0).alias("hour"),
        F.lit(None).cast("double").alias("predicted_pm2_5"),
        F.coalesce(F.col("_p.forecasts")[0]["pm2_5"], F.lit(0.0)).alias("actual_aqi"),
    )
    return current.unionByName(future)


def snapshot_for_city(rows: DataFrame, slug: str) -> DataFrame:
    """Exact slug first, the underscore form of it otherwise."""
    fallback = slug.replace("-", "_", 1)
    hits = rows.where(F.col("city").isin(slug, fallback))
    has_exact = hits.groupBy("model").agg(F.max((F.col("city") == slug)).alias("_exact"))
    chosen = F.when(F.col("_exact"), F.lit(slug)).otherwise(F.lit(fallback))
    return hits.join(has_exact, "model").where(F.col("city") == chosen).drop("_exact")


def field_payload(df: DataFrame, metrics: Sequence[str], fields: Sequence[str], city: str, ts: str) -> DataFrame:
    """Metrics renamed to display fields by position; a row with a missing or non-finite
    metric is marked with the first such metric instead of being published."""
    if len(metrics) < len(fields):
        raise ValueError("at least one metric per field is needed")
    used = list(zip(metrics, fields))
    problem = F.lit(None).cast("string")
    for m, _ in reversed(used):
        x = F.col(m).cast("double")
        problem = (
            F.when(x.isNull() | F.isnan(x), F.concat(F.lit("missing value for "), F.lit(m)))
            .when(F.abs(x) == F.lit(float("inf")), F.concat(F.lit("non-finite value for "), F.lit(m)))
            .otherwise(problem)
        )
    status = F.concat(
        F.lit("city="), F.col(city), F.lit(";timestamp="), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
    )
    return df.select(
        city, *[F.col(m).alias(f) for m, f in used], status.alias("status"), problem.alias("problem")
    )


def publish(
    payload: DataFrame, make_sender: Callable[[], Callable[[list[dict]], None]], batch_rows: int = 100, tries: int = 3
) -> None:
    """Send the good rows in batches of ``batch_rows``.

    ``make_sender`` is called once per partition, in the task, so that a connection or session is made where it is
    used and nothing of it travels from the driver; what it gives back takes a list of rows as dicts. A batch whose
    sending fails is tried again, ``tries`` times in all; then the task fails, and Spark's retry of the task may send
    batches a second time, so the receiver has to take rows by their key."""

    def send(rows: Iterator[Row]) -> None:
        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return
        sender, rest = make_sender(), itertools.chain([first], rows)
        while batch := [row.asDict() for row in itertools.islice(rest, batch_rows)]:
            for attempt in range(1, tries + 1):
                try:
                    sender(batch)
                    break
                except Exception:
                    if attempt == tries:
                        raise

    payload.where("problem is null").drop("problem").foreachPartition(send)
