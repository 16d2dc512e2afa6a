"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeline.operators import aggregate as A
from breezeline.operators import evaluate as E
from breezeline.operators.fill import fill_chain, linear_step
from breezeline.operators.grid import bucket_mean, regular_grid
from breezeline.operators.rank import latest
from breezeline.plans import inputs as I
from breezeline.plans.inputs import HOURLY, SENSOR, cte, query, r6
from breezeline.schema import METRICS
from breezeline.operators.blocks import global_positions
from breezeline.sources.tables import new_watermarks


def in_order(df):
    """Rows with their place in the order the frame has."""
    return global_positions(df.withColumn("_i", F.monotonically_increasing_id()), [F.col("_i")], "place").drop("_i")


def _bucket_sql(bucket: str, name: str, keep: str, stddev: bool) -> str:
    parts = [
        f"{r6(f'avg({m})', f'{m}_avg')}, {r6(f'max({m})', f'{m}_max')}, {r6(f'min({m})', f'{m}_min')}"
        for m in METRICS
    ]
    if stddev:
        parts += [r6(f"stddev_samp({m})", f"{m}_stddev") for m in ("pm2_5", "pm10")]
    return cte("newest") + (
        f"SELECT city_slug, city_name, {bucket} AS {name}, count(*) AS observation_count, "
        + ", ".join(parts)
        + f" FROM obs, newest WHERE observed_at >= as_of - INTERVAL {keep} GROUP BY 1, 2, 3"
    )


def _bucket(spark, d, unit, keep, stddev=("pm2_5", "pm10")):
    newest, since = I.trailing(spark, d, keep)
    return A.bucket_aggregate(
        I.observations(spark, d, since), unit, ["city_slug", "city_name"], "observed_at", METRICS, newest, keep, stddev
    )


H = "date_trunc('hour', observed_at)"
D = "CAST(CAST(observed_at AS DATE) AS TIMESTAMP)"
M = "CAST(date_trunc('month', observed_at) AS TIMESTAMP)"


@query("a01_hourly_aggregates", _bucket_sql(H, "hour", "90 DAYS", True))
def a01(spark, d):
    return _bucket(spark, d, "hour", "90 DAYS")


@query("a02_daily_aggregates", _bucket_sql(D, "day", "365 DAYS", True))
def a02(spark, d):
    return _bucket(spark, d, "day", "365 DAYS")


@query("a03_monthly_aggregates", _bucket_sql(M, "month", "2 YEARS", False))
def a03(spark, d):
    return _bucket(spark, d, "month", "2 YEARS", ())


@query("a04_hourly_aggregates_plain", _bucket_sql(H, "hour", "90 DAYS", False))
def a04(spark, d):
    return _bucket(spark, d, "hour", "90 DAYS", ())


VERIFIED_SQL = """verified AS (SELECT f.*, a.us_aqi AS actual_us_aqi, a.pm2_5 AS actual_pm2_5,
 f.predicted_us_aqi - a.us_aqi AS prediction_error, abs(f.predicted_us_aqi - a.us_aqi) AS absolute_error,
 CASE WHEN a.us_aqi IS NOT NULL THEN as_of END AS verified_at
 FROM newest, forecasts f LEFT JOIN hourly a ON a.city_slug = f.city_slug
  AND a.ts = date_trunc('hour', f.horizon_timestamp))"""


def verified(spark, d):
    from breezeline.operators.joins import verify_forecasts

    h = I.hourly(spark, d, ("us_aqi", "pm2_5")).select(
        "city_slug",
        F.col("ts").alias("hour"),
        F.col("us_aqi").alias("us_aqi_avg"),
        F.col("pm2_5").alias("pm2_5_avg"),
    )
    return verify_forecasts(I.forecasts(spark, d), h, I.as_of(I.observations(spark, d)))


@query(
    "a05_forecast_accuracy",
    cte("forecasts", "newest", extra=[VERIFIED_SQL])
    + """SELECT city_slug, model_type, count(*) AS total_forecasts, count(verified_at) AS verified_forecasts,
 CAST(round(CAST(avg(absolute_error) AS DECIMAL(38,12)), 2) AS DOUBLE) AS mae_aqi,
 CAST(round(CAST(stddev_samp(absolute_error) AS DECIMAL(38,12)), 2) AS DOUBLE) AS stddev_error,
 CAST(round(CAST(stddev_samp(absolute_error) / nullif(avg(absolute_error), 0) * 100 AS DECIMAL(38,12)), 2) AS DOUBLE) AS cv_pct,
 max(verified_at) AS last_verified_at FROM verified GROUP BY 1, 2""",
)
def a05(spark, d):
    return E.forecast_accuracy(verified(spark, d), ["city_slug", "model_type"])


@query(
    "a06_city_statistics",
    cte("obs", extra=["u AS (UNPIVOT (SELECT city_slug, " + ", ".join(METRICS) + " FROM obs) ON " + ", ".join(METRICS) + " INTO NAME metric VALUE v)"])
    + f"SELECT city_slug, metric, count(*) AS readings, {r6('avg(v)', 'mean')}, {r6('stddev_samp(v)', 'std')}, "
    f"{r6('min(v)', 'min')}, {r6('max(v)', 'max')}, {r6('median(v)', 'median')} FROM u GROUP BY 1, 2",
)
def a06(spark, d):
    return A.city_statistics(I.observations(spark, d), "city_slug", METRICS)


ST = ("pm2_5", "pm10", "no2", "so2")


@query(
    "a07_station_summary",
    cte("stations")
    + "SELECT station, "
    + ", ".join(
        f"count({m}) AS {m}_count, " + ", ".join(
            r6(f"{fn}({m})", f"{m}_{name}")
            for name, fn in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
        )
        for m in ST
    )
    + " FROM stations GROUP BY 1",
)
def a07(spark, d):
    return A.wide_summary(I.stations(spark, d), ["station"], ST)


@query(
    "a08_city_monthly_trend",
    cte("obs")
    + f"SELECT city_slug, strftime(observed_at, '%Y-%m') AS month, {r6('avg(pm2_5)', 'pm2_5')}, {r6('avg(pm10)', 'pm10')} FROM obs GROUP BY 1, 2",
)
def a08(spark, d):
    return A.monthly_trend(I.observations(spark, d), ["city_slug"], "observed_at", ["pm2_5", "pm10"])


@query(
    "a09_station_monthly_trend",
    cte("stations")
    + "SELECT station, strftime(ts, '%Y-%m') AS month, "
    + ", ".join(r6(f"avg({m})", m) for m in ST)
    + " FROM stations GROUP BY 1, 2",
)
def a09(spark, d):
    return A.monthly_trend(I.stations(spark, d), ["station"], "ts", ST)


COMPLETE_SQL = (
    "complete AS ("
    + " UNION ALL ".join(
        f"SELECT city_slug, '{m}' AS metric, count(*) AS total_rows, count({m}) AS non_null_rows, "
        f"100.0 * count({m}) / count(*) AS completeness_pct FROM obs GROUP BY 1"
        for m in METRICS
    )
    + ")"
)


@query(
    "a10_completeness",
    cte("obs", extra=[COMPLETE_SQL])
    + f"SELECT city_slug, metric, total_rows, non_null_rows, {r6('completeness_pct')} FROM complete",
)
def a10(spark, d):
    return A.completeness_long(I.observations(spark, d), "city_slug", METRICS)


@query(
    "a11_station_completeness",
    cte("stations")
    + "SELECT station, "
    + ", ".join(r6(f"100.0 * count({m}) / count(*)", f"{m}_completeness_pct") for m in ST)
    + " FROM stations GROUP BY 1",
)
def a11(spark, d):
    return A.completeness_wide(I.stations(spark, d), ["station"], ST)


@query(
    "a12_lowest_completeness",
    cte("obs", extra=[COMPLETE_SQL])
    + f"SELECT metric, {r6('min(completeness_pct)', 'min_completeness_pct')} FROM complete GROUP BY 1",
)
def a12(spark, d):
    return A.lowest_completeness(A.completeness_long(I.observations(spark, d), "city_slug", METRICS))


@query(
    "a13_quality_rows",
    cte("stations")
    + "SELECT station, side, count(*) AS row_count, min(ts) AS start_ts, max(ts) AS end_ts, "
    + ", ".join(r6(f"100.0 * (count(*) - count({m})) / count(*)", f"{m}_missing_pct") for m in (*ST, "humidity_pct"))
    + " FROM stations GROUP BY 1, 2",
)
def a13(spark, d):
    return A.quality_rows(I.stations(spark, d), ["station", "side"], "ts", (*ST, "humidity_pct"))


@query("a14_rows_per_city", cte("obs") + "SELECT city_slug, count(*) AS row_count FROM obs GROUP BY 1")
def a14(spark, d):
    return I.observations(spark, d).groupBy("city_slug").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "a15_dataset_overview",
    cte("obs")
    + "SELECT count(DISTINCT city_slug) AS series_count, count(*) AS row_count, CAST(min(CAST(observed_at AS DATE)) AS TIMESTAMP) AS first_date, CAST(max(CAST(observed_at AS DATE)) AS TIMESTAMP) AS last_date FROM obs",
)
def a15(spark, d):
    return A.dataset_overview(I.observations(spark, d), "city_slug", "observed_at")


DETAILS_SQL = """details AS (SELECT 'run-' || strftime(logical_date, '%Y%m%d') AS run_id, dag_id || run_key AS city_slug,
 CASE WHEN state = 'failed' THEN 'failed' ELSE 'success' END AS status,
 CAST(floor(rows_fetched) AS BIGINT) AS rows_fetched,
 CASE WHEN state = 'failed' THEN 0 ELSE CAST(floor(rows_fetched) AS BIGINT) END AS rows_upserted FROM runs)"""


@query(
    "a16_run_rollup",
    cte("runs", extra=[DETAILS_SQL])
    + """SELECT run_id, count(*) AS cities_total, count(*) FILTER (status = 'success') AS cities_succeeded,
 count(*) FILTER (status = 'failed') AS cities_failed, CAST(sum(rows_fetched) AS BIGINT) AS rows_fetched,
 CAST(sum(rows_upserted) AS BIGINT) AS rows_upserted,
 CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial_failure' ELSE 'success' END AS status
 FROM details GROUP BY 1""",
)
def a16(spark, d):
    failed = F.col("state") == "failed"
    fetched = F.floor("rows_fetched")
    details = I.runs(spark, d).select(
        F.concat(F.lit("run-"), F.date_format("logical_date", "yyyyMMdd")).alias("run_id"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        fetched.alias("rows_fetched"),
        F.when(failed, F.lit(0)).otherwise(fetched).alias("rows_upserted"),
    )
    return A.run_rollup(details)


@query(
    "a17_run_state_counters",
    cte("runs")
    + "SELECT "
    + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}_runs" for s in A.RUN_STATES)
    + """, count(*) FILTER (state NOT IN ('queued','running','failed','success')) AS other_runs,
 count(DISTINCT dag_id) AS dags, count(DISTINCT CASE WHEN dag_id LIKE 'aq\\_%' ESCAPE '\\' THEN dag_id END) AS city_dags,
 count(DISTINCT CASE WHEN is_paused THEN dag_id END) AS paused_dags FROM runs""",
)
def a17(spark, d):
    return A.run_state_counters(I.runs(spark, d))


@query(
    "a18_new_watermarks",
    cte("obs")
    + "SELECT city_slug, max(observed_at) AS last_observed_at, 6::BIGINT AS overlap_hours, 'feed' AS source FROM obs GROUP BY 1",
)
def a18(spark, d):
    return new_watermarks(I.observations(spark, d), "city_slug", "observed_at", "feed")


@query(
    "a19_mean_rmse_by_model",
    cte("bench") + f"SELECT model, {r6('avg(rmse)', 'mean_rmse')} FROM bench WHERE status = 'ok' AND rmse IS NOT NULL GROUP BY 1",
)
def a19(spark, d):
    return E.mean_rmse(I.benchmark_rows(spark, d))


@query(
    "a19_rmse_matrix",
    cte("bench")
    + "SELECT model, "
    + ", ".join(r6(f"avg(rmse) FILTER (city = 'nation_{i}')", f"nation_{i}") for i in range(25))
    + " FROM bench WHERE status = 'ok' AND rmse IS NOT NULL GROUP BY 1",
)
def a19m(spark, d):
    return E.rmse_matrix(I.benchmark_rows(spark, d), [f"nation_{i}" for i in range(25)])


@query(
    "a20_series_audit",
    cte("obs", extra=["t AS (SELECT city_slug, date_trunc('hour', observed_at) AS ts FROM obs)"])
    + """SELECT city_slug, count(*) AS source_rows, min(ts) AS first_ts, max(ts) AS last_ts,
 count(*) - count(DISTINCT ts) AS duplicate_rows,
 CAST(date_diff('hour', min(ts), max(ts)) + 1 AS BIGINT) AS expected_steps,
 CAST(date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT ts) AS BIGINT) AS missing_steps FROM t GROUP BY 1""",
)
def a20(spark, d):
    t = I.observations(spark, d).select("city_slug", F.date_trunc("hour", "observed_at").alias("ts"))
    return A.series_audit(t, HOURLY)


@query(
    "a21_null_counts_before_after",
    cte(
        "hgrid",
        extra=[
            """p AS (SELECT city_slug, pos, pm2_5, pm10,
 last_value(CASE WHEN pm2_5 IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p1,
 last_value(CASE WHEN pm10 IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p2 FROM hgrid
 WINDOW w AS (PARTITION BY city_slug ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
        ],
    )
    + """SELECT city_slug, count(*) FILTER (pm2_5 IS NULL) AS pm2_5_before, count(*) FILTER (pm10 IS NULL) AS pm10_before,
 count(*) FILTER (p1 IS NULL OR pos - p1 > 6) AS pm2_5_after, count(*) FILTER (p2 IS NULL OR pos - p2 > 6) AS pm10_after
 FROM p GROUP BY 1""",
)
def a21(spark, d):
    cols = ["pm2_5", "pm10"]
    grid = regular_grid(I.hourly(spark, d, cols), HOURLY, cols)
    before = A.null_counts(grid, ["city_slug"], cols, "before")
    after = A.null_counts(fill_chain(grid, HOURLY, cols, [linear_step(6)]), ["city_slug"], cols, "after")
    return before.join(after, "city_slug")


@query(
    "a22_bin_coverage",
    cte(
        "sensors",
        extra=[
            """q AS (SELECT sensor, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(pm2_5) AS pm2_5 FROM sensors GROUP BY 1, 2),
b AS (SELECT sensor, min(ts) AS a, max(ts) AS z FROM q GROUP BY 1),
s AS (SELECT sensor, unnest(generate_series(a, z, INTERVAL 15 MINUTE)) AS ts FROM b)"""
        ],
    )
    + f"SELECT s.sensor, count(*) AS bins, {r6('100.0 * count(pm2_5) / count(*)', 'coverage_pct')} FROM s LEFT JOIN q USING (sensor, ts) GROUP BY 1",
)
def a22(spark, d):
    bins = bucket_mean(I.sensors(spark, d), SENSOR, ["pm2_5"], 900)
    return A.bin_coverage(bins, ["sensor"], ["pm2_5"])


@query(
    "a23_latency_summary",
    "SELECT o_orderpriority AS model, "
    + ", ".join(
        [
            r6("avg(o_totalprice)", "mean_ms"),
            r6("min(o_totalprice)", "min_ms"),
            r6("max(o_totalprice)", "max_ms"),
            r6("stddev_pop(o_totalprice)", "std_ms"),
            r6("quantile_cont(o_totalprice, 0.95)", "p95_ms"),
        ]
    )
    + " FROM orders GROUP BY 1",
)
def a23(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("ms"))
    return A.latency_summary(o, ["model"], "ms")


@query(
    "a24_warehouse_sanity",
    cte("forecasts", "newest")
    + """SELECT c.city_slug, c.row_count, c.first_ts, c.last_ts, coalesce(f.recent_forecasts, 0) AS recent_forecasts, f.latest_forecast
 FROM (SELECT city_slug, count(*) AS row_count, min(observed_at) AS first_ts, max(observed_at) AS last_ts FROM obs GROUP BY 1) c
 LEFT JOIN (SELECT city_slug, count(*) FILTER (forecast_timestamp >= as_of - INTERVAL 24 HOURS) AS recent_forecasts,
  max(forecast_timestamp) AS latest_forecast FROM forecasts, newest GROUP BY 1) f USING (city_slug)""",
)
def a24(spark, d):
    o = I.observations(spark, d)
    counts = o.groupBy("city_slug").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("observed_at").alias("first_ts"),
        F.max("observed_at").alias("last_ts"),
    )
    recent = F.col("forecast_timestamp") >= I.as_of(o) - F.expr("INTERVAL 24 HOURS")
    f = I.forecasts(spark, d).withColumn("_recent", recent)
    issued = f.groupBy("city_slug").agg(
        F.count_if("_recent").alias("recent_forecasts"),
        F.max("forecast_timestamp").alias("latest_forecast"),
    )
    return counts.join(issued, "city_slug", "left").withColumn(
        "recent_forecasts", F.coalesce("recent_forecasts", F.lit(0))
    )


@query(
    "a25_forecast_file_check",
    cte("forecasts")
    + f"""SELECT city_slug, count(*) AS row_count, {r6('min(predicted_us_aqi)', 'min_predicted')}, {r6('max(predicted_us_aqi)', 'max_predicted')},
 arg_min(model_type, (horizon_timestamp, forecast_id)) AS first_model,
 {r6('arg_min(confidence, (horizon_timestamp, forecast_id))', 'first_confidence')} FROM forecasts GROUP BY 1""",
)
def a25(spark, d):
    return A.forecast_file_check(I.forecasts(spark, d), ["city_slug"])


LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY observed_at DESC, event_id DESC) AS rn FROM obs) WHERE rn = 1)"""


@query(
    "a26_grid_statistics",
    cte("obs", extra=[LATEST_SQL])
    + f"""SELECT arg_max(city_slug, (coalesce(us_aqi,0), city_slug)) AS worst, {r6('max(coalesce(us_aqi,0))', 'worst_value')},
 arg_min(city_slug, (coalesce(us_aqi,0), city_slug)) AS best, {r6('min(coalesce(us_aqi,0))', 'best_value')},
 {r6('avg(coalesce(us_aqi,0))', 'mean_value')} FROM latest""",
)
def a26(spark, d):
    newest = latest(I.observations(spark, d), ["city_slug"], "observed_at", [F.col("event_id").desc()])
    return A.grid_statistics(newest, "us_aqi", "city_slug")


@query(
    "a27_archive_ledger",
    cte("stations", extra=["e AS (SELECT max(ts) AS as_of FROM stations)"])
    + """SELECT side, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS observed_date, count(*) AS row_count, max(ts) AS last_observed_at,
 'archive/' || side || '/' || strftime(CAST(ts AS DATE), '%Y/%m/%d') AS archive_path, false AS is_deleted
 FROM stations, e WHERE ts < as_of - INTERVAL 365 DAYS GROUP BY side, CAST(ts AS DATE)""",
)
def a27(spark, d):
    st = I.stations(spark, d)
    return A.archive_ledger(st, ["side"], "ts", I.as_of(st, "ts"), "archive")


@query(
    "a28_profile",
    cte("stations")
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count({m}) AS count, count(*) - count({m}) AS nulls, {r6(f'avg({m})', 'mean')}, "
        f"{r6(f'stddev_samp({m})', 'std')}, {r6(f'min({m})', 'min')}, {r6(f'max({m})', 'max')}, "
        + ", ".join(r6(f"quantile_cont({m}, 0.{q})", f"q{q}") for q in (25, 50, 75))
        + " FROM stations"
        for m in (*ST, "humidity_pct")
    ),
)
def a28(spark, d):
    return A.profile(I.stations(spark, d), (*ST, "humidity_pct"))


@query(
    "a29_status_inventory",
    cte("bench")
    + "SELECT city, count(*) AS row_count, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("ok", "skipped", "failed"))
    + " FROM bench GROUP BY 1",
)
def a29(spark, d):
    return A.status_inventory(I.benchmark_rows(spark, d), ["city"])


@query(
    "a30_models_by_category",
    "SELECT p_type AS category, string_agg(b, ',' ORDER BY b) AS models FROM (SELECT DISTINCT p_type, p_brand AS b FROM part) GROUP BY 1",
)
def a30(spark, d):
    """Brands stand for models: a fixed list per category, whatever the row count."""
    pairs = I.table(spark, d, "part").select("p_type", "p_brand").distinct()
    return pairs.groupBy(F.col("p_type").alias("category")).agg(
        F.array_join(F.array_sort(F.collect_list("p_brand")), ",").alias("models")
    )


@query(
    "u01_union_resorted",
    cte("obs", "sensors")
    + f"""SELECT *, row_number() OVER (ORDER BY series, ts, value) AS place FROM (SELECT city_slug AS series, observed_at AS ts, {r6('us_aqi', 'value')} FROM obs
 UNION ALL SELECT sensor, ts, {r6('pm10', 'value')} FROM sensors)""",
)
def u01(spark, d):
    one = I.observations(spark, d).select(
        F.col("city_slug").alias("series"), F.col("observed_at").alias("ts"), F.col("us_aqi").alias("value")
    )
    two = I.sensors(spark, d).select(F.col("sensor").alias("series"), "ts", F.col("pm10").alias("value"))
    both = one.unionByName(two).withColumn("value", F.round(F.col("value") + 1e-9, 6) + 0.0)
    return in_order(both.orderBy("series", "ts", "value"))


@query(
    "u03_union_with_source",
    cte("bench")
    + f"""SELECT 'local' AS source, city, model, {r6('avg(rmse)', 'rmse')} FROM bench WHERE family = 'classical' GROUP BY ALL
 UNION ALL SELECT 'hosted', city, model, {r6('avg(rmse)', 'rmse')} FROM bench WHERE family = 'deep_learning' GROUP BY ALL""",
)
def u03(spark, d):
    b = I.benchmark_rows(spark, d)

    def side(family, tag):
        return (
            b.where(F.col("family") == family)
            .groupBy("city", "model")
            .agg(F.avg("rmse").alias("rmse"))
            .withColumn("source", F.lit(tag))
        )

    return side("classical", "local").unionByName(side("deep_learning", "hosted"))


@query("u04_distinct_cities", cte("obs") + "SELECT DISTINCT city_slug FROM obs")
def u04(spark, d):
    return I.observations(spark, d).select("city_slug").distinct()


@query(
    "u05_catalogue_union",
    "SELECT 'supplier' AS kind, s_name AS name, lower(replace(s_name,' ','_')) AS slug FROM supplier UNION ALL SELECT 'customer', c_name, lower(replace(c_name,' ','_')) FROM customer",
)
def u05(spark, d):
    from breezeline.functions.text import city_slug

    s = I.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    c = I.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return s.union(c).withColumn("slug", city_slug("name"))
