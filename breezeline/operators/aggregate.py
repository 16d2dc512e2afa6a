"""Roll-ups, profiles, completeness, audits and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.operators.blocks import Series
from breezeline.operators.quantiles import exact_quantiles, long_metrics, wide_quantiles


def bucket_aggregate(
    df: DataFrame,
    unit: str,
    keys: Sequence[str],
    ts: str,
    metrics: Sequence[str],
    as_of: Column | None = None,
    keep: str | None = None,
    stddev: Sequence[str] = ("pm2_5", "pm10"),
    name: str | None = None,
    date_col: str | None = None,
) -> DataFrame:
    """Count, avg/max/min of every metric and sample stddev of some, per calendar unit
    (hour, day, month), over the trailing ``keep`` interval before ``as_of``.  A literal
    ``as_of`` reaches the scan; with ``date_col``, the facts' date partition, older days
    are not opened."""
    d = df if keep is None else since(df, ts, as_of - F.expr(f"INTERVAL {keep}"), date_col)
    bucket = F.date_trunc(unit, ts)
    bucket = bucket if unit == "hour" else bucket.cast("date")
    aggs = [F.count(F.lit(1)).alias("observation_count")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_avg"), F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min")]
    aggs += [F.stddev_samp(m).alias(f"{m}_stddev") for m in stddev]
    return d.groupBy(*keys, bucket.alias(name or unit)).agg(*aggs)


def since(df: DataFrame, ts: str, bound: Column, date_col: str | None = None) -> DataFrame:
    """Rows from ``bound`` on, cut by the date partition column as well where there is one."""
    d = df.where(F.col(ts) >= bound)
    return d.where(F.col(date_col) >= bound.cast("date")) if date_col else d


def fold_buckets(
    df: DataFrame, ts: str, unit: str, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Mean per calendar unit: the one-row-per-(series, time) frame the ordered
    operators work on."""
    return df.groupBy(*keys, F.date_trunc(unit, ts).alias("ts")).agg(*[F.avg(m).alias(m) for m in metrics])


def newest(df: DataFrame, ts: str) -> DataFrame:
    """One-row frame with the newest time, to be cross-joined as ``as_of``: a scalar
    subquery result rather than a driver round trip."""
    return df.agg(F.max(ts).alias("as_of"))


def city_statistics(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """count, mean, median, std, min, max per (key, metric) over readings."""
    parts = {"readings": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    reduced = df.groupBy(key).agg(
        *[F.struct(*[fn(m).alias(p) for p, fn in parts.items()]).alias(m) for m in metrics]
    )
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in metrics])
    basic = reduced.select(key, F.explode(rows).alias("r")).select(key, "r.metric", "r.s.*")
    return basic.join(exact_quantiles(df, [key], metrics, {"median": 0.5}), [key, "metric"])


def wide_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """count, mean, median, std, min, max of every metric in one wide row per group; the
    null group is kept."""
    basic = df.groupBy(*keys).agg(
        *[
            agg
            for m in metrics
            for agg in (
                F.count(m).alias(f"{m}_count"),
                F.avg(m).alias(f"{m}_mean"),
                F.stddev_samp(m).alias(f"{m}_std"),
                F.min(m).alias(f"{m}_min"),
                F.max(m).alias(f"{m}_max"),
            )
        ]
    )
    medians = wide_quantiles(df, keys, metrics, {"q": 0.5})
    right = medians.select(
        F.struct(*keys).alias("_k"), *[F.col(f"q_{m}").alias(f"{m}_median") for m in metrics]
    )
    return basic.withColumn("_k", F.struct(*keys)).join(right, "_k", "left").drop("_k")


def monthly_trend(df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, F.date_format(ts, "yyyy-MM").alias("month")).agg(
        *[F.avg(m).alias(m) for m in metrics]
    )


def completeness_long(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    return (
        long_metrics(df, [key], metrics)
        .groupBy(key, "metric")
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count("value").alias("non_null_rows"))
        .withColumn("completeness_pct", 100.0 * F.col("non_null_rows") / F.col("total_rows"))
    )


def completeness_wide(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[(100.0 * F.avg(F.col(m).isNotNull().cast("int"))).alias(f"{m}_completeness_pct") for m in metrics]
    )


def lowest_completeness(long: DataFrame) -> DataFrame:
    return long.groupBy("metric").agg(F.min("completeness_pct").alias("min_completeness_pct"))


def quality_rows(df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        *[(100.0 * F.avg(F.col(m).isNull().cast("int"))).alias(f"{m}_missing_pct") for m in metrics],
    )


def required_metric_report(
    df: DataFrame, key: str, required: Sequence[str], optional: Sequence[str]
) -> DataFrame:
    """Diagnostics: a wholly missing required metric is an error, an optional one a
    warning."""
    counts = df.groupBy(key).agg(*[F.count(m).alias(m) for m in (*required, *optional)])
    level = F.when(F.col("metric").isin(*required), "error").otherwise("warning")
    return (
        long_metrics(counts, [key], [*required, *optional])
        .where("value = 0")
        .select(key, "metric", level.alias("level"))
    )


def dataset_overview(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.agg(
        F.countDistinct(key).alias("series_count"),
        F.count(F.lit(1)).alias("row_count"),
        F.min(F.to_date(ts)).alias("first_date"),
        F.max(F.to_date(ts)).alias("last_date"),
    )


def series_audit(df: DataFrame, s: Series) -> DataFrame:
    """Rows, duplicates, span, expected steps and missing steps per series."""
    span = F.unix_seconds("last_ts") - F.unix_seconds("first_ts")
    return (
        df.groupBy(*s.keys)
        .agg(
            F.count(F.lit(1)).alias("source_rows"),
            F.countDistinct(s.ts).alias("_distinct"),
            F.min(s.ts).alias("first_ts"),
            F.max(s.ts).alias("last_ts"),
        )
        .withColumn("duplicate_rows", F.col("source_rows") - F.col("_distinct"))
        .withColumn("expected_steps", (F.floor(span / s.step_seconds) + 1).cast("long"))
        .withColumn("missing_steps", F.col("expected_steps") - F.col("_distinct"))
        .drop("_distinct")
    )


def null_counts(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_{suffix}") for c in cols])


def bin_coverage(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Share of bins with any metric present."""
    anything = F.coalesce(*[F.col(m) for m in metrics]).isNotNull()
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bins"), (100.0 * F.avg(anything.cast("int"))).alias("coverage_pct")
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value (one aggregate; one row reaches the driver)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in counts.items() if n == 0])


def run_rollup(details: DataFrame) -> DataFrame:
    """Per run: series attempted, succeeded, failed, rows, final status."""
    return (
        details.groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("cities_total"),
            F.count_if(F.col("status") == "success").alias("cities_succeeded"),
            F.count_if(F.col("status") == "failed").alias("cities_failed"),
            F.coalesce(F.sum("rows_fetched"), F.lit(0)).alias("rows_fetched"),
            F.coalesce(F.sum("rows_upserted"), F.lit(0)).alias("rows_upserted"),
        )
        .withColumn(
            "status", F.when(F.col("cities_failed") > 0, "partial_failure").otherwise("success")
        )
    )


# The run states counted by name.
RUN_STATES = ("queued", "running", "failed", "success")


def run_state_counters(runs: DataFrame, state: str = "state") -> DataFrame:
    s = F.coalesce(F.col(state), F.lit(""))
    return runs.agg(
        *[F.count_if(s == name).alias(f"{name}_runs") for name in RUN_STATES],
        F.count_if(~s.isin(*RUN_STATES)).alias("other_runs"),
        F.countDistinct("dag_id").alias("dags"),
        F.countDistinct(F.when(F.col("dag_id").startswith("aq_"), F.col("dag_id"))).alias("city_dags"),
        F.countDistinct(F.when(F.col("is_paused"), F.col("dag_id"))).alias("paused_dags"),
    )


def latency_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.avg(value).alias("mean_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        F.stddev_pop(value).alias("std_ms"),
    )
    q = exact_quantiles(df, keys, [value], {"p95_ms": 0.95}).drop("metric")
    return base.join(q, list(keys))


def forecast_file_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    first = F.struct("horizon_timestamp", "forecast_id")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("predicted_us_aqi").alias("min_predicted"),
        F.max("predicted_us_aqi").alias("max_predicted"),
        F.min_by("model_type", first).alias("first_model"),
        F.min_by("confidence", first).alias("first_confidence"),
    )


def grid_statistics(latest: DataFrame, value: str, name: str) -> DataFrame:
    """Worst, best and mean over the ranked series, null counted as zero."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return latest.agg(
        F.max_by(name, F.struct(v, F.col(name))).alias("worst"),
        F.max(v).alias("worst_value"),
        F.min_by(name, F.struct(v, F.col(name))).alias("best"),
        F.min(v).alias("best_value"),
        F.avg(v).alias("mean_value"),
    )


def status_inventory(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.col("status") == st).alias(st) for st in ("ok", "skipped", "failed")],
    )


def archive_ledger(df: DataFrame, keys: Sequence[str], ts: str, as_of: Column, root: str, days: int = 365) -> DataFrame:
    """Soft-delete ledger: which days of a series have left the retention window."""
    return (
        df.where(F.col(ts) < as_of - F.make_dt_interval(F.lit(days)))
        .groupBy(*keys, F.to_date(ts).alias("observed_date"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.max(ts).alias("last_observed_at"))
        .withColumn(
            "archive_path",
            F.concat_ws("/", F.lit(root), *[F.col(k) for k in keys], F.date_format("observed_date", "yyyy/MM/dd")),
        )
        .withColumn("is_deleted", F.lit(False))
    )


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, nulls, mean, std, min, quartiles, max per numeric column."""
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    reduced = df.agg(
        *[
            F.struct(
                F.count_if(F.col(c).isNull()).alias("nulls"), *[fn(c).alias(p) for p, fn in parts.items()]
            ).alias(c)
            for c in cols
        ]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("s")) for c in cols])
    basic = reduced.select(F.explode(rows).alias("r")).select("r.metric", "r.s.*")
    quartiles = exact_quantiles(df, [], cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "metric", "left")
