"""Column contracts of the tables the library reads and writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The seven metrics of an hourly reading, in the order of the feed.
METRICS = (
    "pm2_5",
    "pm10",
    "carbon_monoxide",
    "nitrogen_dioxide",
    "sulphur_dioxide",
    "ozone",
    "us_aqi",
)
# Pollutant inputs and target of the supervised frames.
BENCHMARK_INPUTS = ("pm2_5", "pm10", "carbon_monoxide", "nitrogen_dioxide", "ozone")
BENCHMARK_TARGET = "us_aqi"
# Ingest defaults.
OVERLAP_HOURS = 6
INITIAL_LOOKBACK_HOURS = 24
INITIAL_WINDOW_DAYS = 365

_D, _S, _TS, _I = T.DoubleType(), T.StringType(), T.TimestampType(), T.IntegerType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


RAW_OBSERVATIONS = _struct(city=_S, timestamp=_TS, **{m: _D for m in METRICS})
OBSERVATIONS = _struct(
    city_slug=_S,
    city_name=_S,
    observed_at=_TS,
    **{m: _D for m in METRICS},
    source=_S,
    ingested_at=_TS,
    run_id=_S,
    created_at=_TS,
    updated_at=_TS,
)
OBSERVATION_KEY = ("city_slug", "observed_at", "source")
WATERMARKS = _struct(
    city_slug=_S, last_observed_at=_TS, overlap_hours=_I, source=_S, updated_at=_TS
)
RUNS = _struct(
    run_id=_S,
    pipeline_name=_S,
    started_at=_TS,
    finished_at=_TS,
    status=_S,
    cities_total=T.LongType(),
    cities_succeeded=T.LongType(),
    cities_failed=T.LongType(),
    rows_fetched=T.LongType(),
    rows_upserted=T.LongType(),
)
RUN_DETAILS = _struct(run_id=_S, city_slug=_S, status=_S, rows_fetched=T.LongType(), rows_upserted=T.LongType(), error=_S)
FORECASTS = _struct(
    forecast_id=_S,
    city_slug=_S,
    city_name=_S,
    forecast_timestamp=_TS,
    horizon_timestamp=_TS,
    horizon_hours=_I,
    predicted_us_aqi=_D,
    predicted_pm2_5=_D,
    predicted_pm10=_D,
    model_type=_S,
    model_version=_S,
    confidence=_D,
)
FORECAST_REQUIRED = (
    "forecast_id",
    "city_slug",
    "city_name",
    "forecast_timestamp",
    "horizon_timestamp",
    "horizon_hours",
    "predicted_us_aqi",
    "model_type",
    "confidence",
)
BENCHMARK_SUMMARY = _struct(
    city=_S,
    phase=_S,
    model=_S,
    family=_S,
    status=_S,
    rmse=_D,
    mae=_D,
    r2=_D,
    train_seconds=_D,
    inference_seconds=_D,
    reason=_S,
)
HOURLY_PAYLOAD = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(_S))]
                + [T.StructField(m, T.ArrayType(_D)) for m in METRICS]
            ),
        )
    ]
)
SNAPSHOT = T.StructType(
    [
        T.StructField("model", _S),
        T.StructField("model_name", _S),
        T.StructField("model_family", _S),
        T.StructField("tier", _I),
        T.StructField("generated_at", _S),
        T.StructField(
            "predictions",
            T.MapType(
                _S,
                T.StructType(
                    [
                        T.StructField("city_name", _S),
                        T.StructField(
                            "forecasts",
                            T.ArrayType(_struct(hour=_I, timestamp=_S, pm2_5=_D)),
                        ),
                        T.StructField("error", _S),
                    ]
                ),
            ),
        ),
    ]
)
RESOURCE_LISTING = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField(
            "result",
            T.StructType([T.StructField("resources", T.ArrayType(_struct(name=_S, format=_S, url=_S)))]),
        ),
    ]
)


def require_columns(df: DataFrame, required: Iterable[str], label: str = "frame") -> DataFrame:
    """Fail on the driver when a contract column is absent."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")
    return df
