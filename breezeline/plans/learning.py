"""Scaling, metric and forecasting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeline.operators import evaluate as E
from breezeline.operators import features as X
from breezeline.operators import forecast as P
from breezeline.operators import scaling as Z
from breezeline.plans import inputs as I
from breezeline.plans.inputs import HOURLY, cte, query, r6, rounded
from breezeline.plans.ordered import BASE_SQL, POS_SQL, SPLIT_SQL, WIDE, WINDOWS_SQL, baseline, windows_summary
from breezeline.operators.fill import impute_for_benchmark
from breezeline.plans.shaping import PAIR_SQL, pairs
from breezeline.session import materialise, scratch_path

KEY = ["city_slug"]


def _train(spark, d):
    return X.chronological_split(I.hourly(spark, d, WIDE), HOURLY).where("split = 'train'")


FIT = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "none": ("0.0", "1.0"),
}


def _fit_sql(kind: str, source: str = "sp WHERE split = 'train'") -> str:
    center, width = FIT[kind]
    return "fit AS (" + " UNION ALL ".join(
        f"SELECT city_slug, '{c}' AS metric, {center.format(c=c)} AS center, "
        f"CASE WHEN {width.format(c=c)} = 0 THEN 1.0 ELSE {width.format(c=c)} END AS width FROM {source} GROUP BY 1 HAVING count({c}) > 0"
        for c in WIDE
    ) + ")"


for _kind in Z.KINDS:

    def _fit(spark, d, kind=_kind):
        return Z.fit_scaler(_train(spark, d), KEY, WIDE, kind)

    query(
        f"m01_scaler_{_kind}",
        cte("hourly", extra=[POS_SQL, SPLIT_SQL, _fit_sql(_kind)]) + f"SELECT city_slug, metric, {rounded(('center', 'width'))} FROM fit",
    )(_fit)

SCALED_SQL = (
    "sc AS (SELECT sp.city_slug, ts, split, "
    + ", ".join(f"({c} - f_{c}.center) / f_{c}.width AS {c}" for c in WIDE)
    + " FROM sp "
    + " ".join(f"LEFT JOIN fit f_{c} ON f_{c}.city_slug = sp.city_slug AND f_{c}.metric = '{c}'" for c in WIDE)
    + ")"
)


@query(
    "m02_scaled",
    cte("hourly", extra=[POS_SQL, SPLIT_SQL, _fit_sql("standard"), SCALED_SQL]) + f"SELECT city_slug, ts, split, {rounded(WIDE)} FROM sc",
)
def m02(spark, d):
    split = X.chronological_split(I.hourly(spark, d, WIDE), HOURLY)
    fit = Z.fit_scaler(split.where("split = 'train'"), KEY, WIDE)
    return Z.apply_scaler(split, fit, KEY, WIDE)


@query("m02_inverted", cte("hourly") + f"SELECT city_slug, ts, {r6('us_aqi')} FROM hourly")
def m02i(spark, d):
    h = I.hourly(spark, d, WIDE)
    fit = Z.fit_scaler(h, KEY, ["us_aqi"], "minmax")
    scaled = Z.apply_scaler(h, fit, KEY, ["us_aqi"])
    return Z.invert_scaler(scaled, fit, KEY, ["us_aqi"]).select("city_slug", "ts", "us_aqi")


M3_WINDOWS = WINDOWS_SQL.replace("FROM sp WINDOW", "FROM sc WINDOW")


@query(
    "m03_dataset",
    cte("hourly", extra=[POS_SQL, SPLIT_SQL, _fit_sql("standard"), SCALED_SQL, M3_WINDOWS])
    + f"SELECT city_slug, split, ts, window_index, window_count, x_len, y_len, {rounded(('x_sum', 'x_first', 'x_last', 'y_sum', 'y_first', 'y_last'))} FROM ws",
)
def m03(spark, d):
    return windows_summary(Z.build_dataset(I.hourly(spark, d, WIDE), HOURLY, WIDE, "us_aqi", 24, 6))


@query(
    "m03_too_short",
    cte("obs") + "SELECT user_id, count(*) AS row_count, 'insufficient_history' AS status FROM obs GROUP BY 1 HAVING count(*) < 67",
)
def m03s(spark, d):
    return Z.too_short(I.observations(spark, d), HOURLY.with_keys("user_id"), 67)


METRIC_SQL = "count(*) AS n, {r}, {m}, {q}".format(
    r=r6("sqrt(avg(pow(predicted_us_aqi - actual, 2)))", "rmse"),
    m=r6("avg(abs(predicted_us_aqi - actual))", "mae"),
    q=r6("1 - sum(pow(predicted_us_aqi - actual, 2)) / nullif(var_pop(actual) * count(*), 0)", "r2"),
)


@query("m04_regression_metrics", cte("forecasts", extra=[PAIR_SQL]) + f"SELECT city_slug, model_type, {METRIC_SQL} FROM pair GROUP BY 1, 2")
def m04(spark, d):
    return E.regression_metrics(pairs(spark, d), ["city_slug", "model_type"], "actual", "predicted_us_aqi")


@query(
    "m04_r2_per_horizon",
    cte("forecasts", extra=[PAIR_SQL, "h AS (SELECT city_slug, model_type, horizon_hours, 1 - sum(pow(predicted_us_aqi - actual, 2)) / nullif(var_pop(actual) * count(*), 0) AS r2 FROM pair GROUP BY 1, 2, 3)"])
    + f"SELECT city_slug, model_type, {r6('avg(r2)', 'r2_uniform')}, count(*) AS horizons FROM h GROUP BY 1, 2",
)
def m04h(spark, d):
    return E.horizon_r2(pairs(spark, d), ["city_slug", "model_type"], "horizon_hours", "actual", "predicted_us_aqi")


@query(
    "m05_mase",
    cte("forecasts", extra=[PAIR_SQL,
        "df AS (SELECT city_slug, abs(us_aqi - lag(us_aqi, 24) OVER (PARTITION BY city_slug ORDER BY ts)) AS x FROM hourly)",
        "s AS (SELECT city_slug, avg(x) AS scale FROM df GROUP BY 1)",
        "e AS (SELECT city_slug, avg(abs(predicted_us_aqi - actual)) AS mae FROM pair GROUP BY 1)"])
    + f"SELECT city_slug, {r6('mae')}, {r6('scale')}, {r6('mae / scale', 'mase')} FROM e JOIN s USING (city_slug)",
)
def m05(spark, d):
    scale = X.seasonal_naive_scale(I.hourly(spark, d, ["us_aqi"]), HOURLY, "us_aqi", 24)
    return E.mase(pairs(spark, d), scale, KEY, "actual", "predicted_us_aqi")


@query(
    "m06_pinball",
    cte("forecasts", extra=[PAIR_SQL])
    + f"SELECT city_slug, {r6('avg(greatest(0.9 * (actual - predicted_us_aqi), -0.1 * (actual - predicted_us_aqi)))', 'pinball')} FROM pair GROUP BY 1",
)
def m06(spark, d):
    return E.pinball(pairs(spark, d), KEY, "actual", "predicted_us_aqi", 0.9)


@query(
    "m07_interval_coverage",
    cte("forecasts", extra=[PAIR_SQL])
    + f"SELECT city_slug, {r6('avg(CASE WHEN actual BETWEEN predicted_us_aqi - 20 AND predicted_us_aqi + 20 THEN 1 ELSE 0 END)', 'coverage')} FROM pair GROUP BY 1",
)
def m07(spark, d):
    p = pairs(spark, d).withColumn("lo", F.col("predicted_us_aqi") - 20).withColumn("hi", F.col("predicted_us_aqi") + 20)
    return E.coverage(p, KEY, "actual", "lo", "hi")


@query(
    "m08_mape",
    cte("forecasts", extra=[PAIR_SQL])
    + f"SELECT city_slug, {r6('coalesce(100 * avg(abs(predicted_us_aqi - actual) / actual) FILTER (actual <> 0), 0)', 'mape')}, count(*) AS n FROM pair GROUP BY 1",
)
def m08(spark, d):
    return E.mape(pairs(spark, d), KEY, "actual", "predicted_us_aqi")


@query(
    "m09_drift_decision",
    cte("forecasts", extra=[PAIR_SQL])
    + f"""SELECT c.city_slug, {r6('p.mape', 'mape')}, coalesce(p.n, 0) AS n, CASE WHEN p.mape IS NULL THEN 'skip' WHEN p.mape > 150 THEN 'retrain' ELSE 'keep' END AS decision
 FROM (SELECT DISTINCT city_slug FROM forecasts) c LEFT JOIN (SELECT city_slug, coalesce(100 * avg(abs(predicted_us_aqi - actual) / actual) FILTER (actual <> 0), 0) AS mape, count(*) AS n
  FROM pair WHERE city_slug <> 'nation_7' GROUP BY 1) p USING (city_slug)""",
)
def m09(spark, d):
    a = I.hourly(spark, d, ["us_aqi"]).where("city_slug <> 'nation_7'").select(
        "city_slug", F.col("ts").alias("horizon_timestamp"), F.col("us_aqi").alias("actual")
    )
    return E.drift_decision(I.forecasts(spark, d), a, KEY, "horizon_timestamp", "actual", "predicted_us_aqi", 150.0)


COLS = ("us_aqi", "pm2_5", "pm10", "carbon_monoxide", "nitrogen_dioxide", "ozone")
DAY = range(1, 25)
# Small trees: the queries go over all rows, metrics and horizons; the settings of the specs
# (180 trees, 220 and 260 rounds) are the defaults of the library, and the README has their cost.
SMALL = {"random_forest": {"numTrees": 10, "maxDepth": 5}, "lightgbm": {"maxIter": 5}, "xgboost": {"maxIter": 5}}
# Complete rows of the imputed grid have 24 rows before them.
SPAN_SQL = """sz AS (SELECT city_slug, max(len) AS len, greatest(floor(max(len) * 0.7::DOUBLE), 24) AS val_from,
 floor(max(len) * (0.7::DOUBLE + 0.15::DOUBLE)) AS val_to, greatest(floor(max(len) * (0.7::DOUBLE + 0.15::DOUBLE)), 24) AS test_from FROM hgrid GROUP BY 1)"""


def _clean(spark, d):
    return impute_for_benchmark(I.hourly(spark, d, COLS), HOURLY, COLS)


def _frame(spark, d, horizons):
    return P.supervised_frame(_clean(spark, d), HOURLY, COLS, "us_aqi", horizons)


def _direct(spec, horizons):
    def run(spark, d):
        frame, names = _frame(spark, d, horizons)
        models = P.fit_direct(frame, HOURLY, names, "us_aqi", horizons, spec, **SMALL.get(spec, {}))
        scored = P.predict_direct(models, frame.where("split = 'test'"), HOURLY, "us_aqi")
        m = E.regression_metrics(scored, ["horizon_hours"], "actual", "predicted")
        return m.select("horizon_hours", "n", ((F.col("rmse") >= F.col("mae")) & (F.col("mae") > 0)).alias("scored"))

    return run


def _direct_sql(horizons):
    return cte("hgrid", extra=[SPAN_SQL]) + (
        f"SELECT h AS horizon_hours, CAST(sum(greatest(len - h - test_from, 0)) AS BIGINT) AS n, true AS scored FROM sz, (SELECT unnest({list(horizons)}) AS h) GROUP BY 1"
    )


# Fitted values have no SQL form; what they were fitted and scored on has.  Tests hold the fits.
query("m10_direct_linear", _direct_sql(DAY))(_direct("linear", DAY))
query("m10_direct_random_forest", _direct_sql(DAY))(_direct("random_forest", DAY))
query("m10_direct_boosted_trees", _direct_sql(DAY))(_direct("xgboost", DAY))


@query(
    "m11_vector_autoregression",
    cte("hgrid", extra=["e AS (SELECT city_slug, max(ts) AS last_ts FROM hgrid GROUP BY 1)"])
    + "SELECT city_slug, h AS horizon_hours, last_ts + h * INTERVAL 1 HOUR AS horizon_timestamp, 6 AS metrics FROM e, generate_series(1, 24) g(h)",
)
def m11(spark, d):
    """Six metrics, up to 24 lags by AIC; every city gets a finite path of a day."""
    clean = materialise(_clean(spark, d))
    b, a, lags = P.fit_var(clean, HOURLY, COLS)
    path = P.forecast_var(clean, HOURLY, COLS, b, a, lags, 24)
    finite = sum((F.when(F.abs(c) < 1e9, 1).otherwise(0) for c in COLS), F.lit(0))
    return path.select("city_slug", "horizon_hours", "horizon_timestamp", finite.alias("metrics"))


@query(
    "m12_baseline_forecast",
    cte("hourly", extra=[BASE_SQL]) + f"SELECT city_slug, last_ts, horizon_hours, horizon_timestamp, {r6('predicted')} FROM bf",
)
def m12(spark, d):
    return baseline(spark, d)


SHARES = (0.111, 0.333, 1.0)


@query(
    "m13_parameter_search",
    cte("hgrid", extra=[SPAN_SQL])
    + f"""SELECT r AS round, {r6('any_value(share)', 'share')}, any_value(trials) AS trials, true AS scored,
 CAST(sum(greatest(least(floor(floor(len * 0.7::DOUBLE) * share), floor(len * 0.7::DOUBLE) - 1) - 24, 0)) AS BIGINT) AS train_rows,
 CAST(sum(greatest(val_to - val_from, 0)) AS BIGINT) AS val_rows
 FROM sz, (SELECT unnest([0, 1, 2]) AS r, unnest([{", ".join(f"{x}::DOUBLE" for x in SHARES)}]) AS share, unnest([20, 7, 3]) AS trials) GROUP BY r""",
)
def m13(spark, d):
    """Twenty seeded draws of small forests over three growing shares; the counts are those of the rows used."""
    frame, names = _frame(spark, d, (1,))
    ranges = {"numTrees": ("int", 2, 10), "maxDepth": ("int", 2, 5), "minInstancesPerNode": ("int", 1, 10)}
    trials = P.search_halving(frame, HOURLY, names, "us_aqi", (1,), "random_forest", ranges, shares=SHARES, parallelism=8)
    val_rows = frame.where("split = 'val' AND us_aqi_h1 IS NOT NULL").count()
    out = []
    for turn, share in enumerate(SHARES):
        part = (F.col("_pos") < F.floor(F.col("_to") * share)) & (F.col("_pos") + 1 < F.col("_to"))
        rows = frame.where("split = 'train' AND us_aqi_h1 IS NOT NULL").where(part).count()
        errors = [t["val_mse"] for t in trials if t["round"] == turn]
        out.append((turn, share, len(errors), None not in errors and errors == sorted(errors), rows, val_rows))
    return spark.createDataFrame(out, "round int, share double, trials int, scored boolean, train_rows long, val_rows long")


MATRIX = ["linear", "sarima", "lightgbm"]


def _matrix(spark, d):
    return P.benchmark_matrix(_clean(spark, d), HOURLY, COLS, "us_aqi", DAY, MATRIX, params=SMALL)


@query(
    "m14_benchmark_matrix",
    cte("hourly")
    + """SELECT city, model, CASE WHEN model = 'sarima' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN model = 'sarima' THEN 'no estimator for sarima' END AS reason,
 CASE WHEN model <> 'sarima' THEN 'classical' END AS phase, CASE model WHEN 'linear' THEN 'linear' WHEN 'lightgbm' THEN 'tree_ensemble' END AS family, model <> 'sarima' AS measured
 FROM (SELECT DISTINCT city_slug AS city FROM hourly), (SELECT unnest(['linear', 'sarima', 'lightgbm']) AS model)""",
)
def m14(spark, d):
    """The middle spec does not exist and becomes skipped rows."""
    m = _matrix(spark, d)
    taken = [F.col(c) > 0 for c in ("rmse", "mae", "train_seconds", "inference_seconds")]
    measured = F.coalesce(taken[0] & taken[1] & taken[2] & taken[3] & F.col("r2").isNotNull(), F.lit(False))
    return m.select("city", "model", "status", "reason", "phase", "family", measured.alias("measured"))


@query(
    "m14_best_to_forecasts",
    cte("hgrid", extra=["e AS (SELECT city_slug, max(ts) AS last_ts FROM hgrid GROUP BY 1)"])
    + """SELECT city_slug, 'Nation ' || split_part(city_slug, '_', 2) AS city_name, last_ts AS forecast_timestamp, h AS horizon_hours,
 last_ts + h * INTERVAL 1 HOUR AS horizon_timestamp, 'benchmark-v1' AS model_version, true AS by_best, true AS in_range FROM e, generate_series(1, 24) g(h)""",
)
def m14b(spark, d):
    """Matrix, best row per city, and the forecast rows of that city's best model over all horizons."""
    matrix, rows = P.best_model_forecasts(
        _clean(spark, d), HOURLY, COLS, "us_aqi", DAY, ["linear", "random_forest", "xgboost"], "benchmark-v1", params=SMALL
    )
    least = matrix.groupBy(F.col("city").alias("city_slug")).agg(F.min("rmse").alias("rmse"), F.min_by("model", "rmse").alias("model"))
    told = rows.join(least, "city_slug")
    confident = F.abs(F.col("confidence") - P.confidence_from_rmse(F.col("rmse"))) < 1e-12
    return told.select(
        "city_slug", "city_name", "forecast_timestamp", "horizon_hours", "horizon_timestamp", "model_version",
        ((F.col("model_type") == F.col("model")) & confident).alias("by_best"),
        (F.abs("predicted_us_aqi") < 1000).alias("in_range"),
    )


@query(
    "m15_forecast_rows",
    cte("hourly", extra=[BASE_SQL])
    + f"""SELECT city_slug || '-persistenceplustrend-' || strftime(last_ts, '%Y%m%dT%H%M%SZ') || '-' || lpad(CAST(horizon_hours AS VARCHAR), 3, '0') AS forecast_id,
 city_slug, 'Nation ' || split_part(city_slug, '_', 2) AS city_name, last_ts AS forecast_timestamp, horizon_timestamp, horizon_hours, {r6('predicted', 'predicted_us_aqi')},
 'Persistence+Trend' AS model_type, '1.0' AS model_version, {r6('1 / (1 + 30.0 / 100)', 'confidence')} FROM bf""",
)
def m15(spark, d):
    return P.forecast_rows(baseline(spark, d), F.col("last_ts"), "Persistence+Trend", "1.0", rmse=F.lit(30.0))


@query(
    "m16_saved_model",
    cte("hgrid", extra=[SPAN_SQL])
    + "SELECT CAST(sum(greatest(len - 1 - test_from, 0)) AS BIGINT) AS n, 78 AS features, 0.0::DOUBLE AS largest_gap FROM sz",
)
def m16(spark, d):
    """The loaded model predicts what the fitted one does."""
    frame, names = _frame(spark, d, (1,))
    models = P.fit_direct(frame, HOURLY, names, "us_aqi", (1,), "linear")
    path = scratch_path(spark, "model")
    P.save_model(models[1], path, names, {"horizon": 1})
    loaded, meta = P.load_model(path)
    test = frame.where("split = 'test'")
    own, read = (P.predict_direct({1: m}, test, HOURLY, "us_aqi") for m in (models[1], loaded))
    both = own.join(read.select("city_slug", "ts", F.col("predicted").alias("again")), ["city_slug", "ts"])
    return both.where("actual IS NOT NULL").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(len(meta["features"])).alias("features"),
        F.max(F.abs(F.col("predicted") - F.col("again"))).alias("largest_gap"),
    )


@query(
    "m17_comparison_report",
    cte("bench", extra=[
        """pool AS (SELECT city, phase, model, round(avg(rmse) + 1e-9, 6) AS rmse FROM bench WHERE status = 'ok' GROUP BY 1, 2, 3)""",
        "k AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY rmse, city, model) AS rn, row_number() OVER (ORDER BY rmse, city, model) AS al FROM pool)"])
    + f"""SELECT 'best_of_phase' AS section, city, phase, model, {r6('rmse')} FROM k WHERE rn = 1
 UNION ALL SELECT 'overall_top', city, phase, model, {r6('rmse')} FROM k WHERE al <= 5""",
)
def m17(spark, d):
    from breezeline.plans.shaping import _pool

    return E.comparison_report(_pool(spark, d))


@query(
    "m18_flat_window_features",
    cte("hourly", extra=[POS_SQL, SPLIT_SQL, WINDOWS_SQL])
    + f"SELECT city_slug, split, window_index, 168 AS width, {r6('x_first', 'first_value')}, {r6('x_last', 'last_us_aqi')} FROM ws",
)
def m18(spark, d):
    split = X.chronological_split(I.hourly(spark, d, WIDE), HOURLY, keep_helpers=True)
    w = X.flat_windows(X.supervised_windows(split, HOURLY, WIDE, "us_aqi", 24, 6), WIDE)
    return w.select(
        "city_slug",
        "split",
        "window_index",
        F.size("features").alias("width"),
        F.col("features")[0].alias("first_value"),
        F.col("features")[161].alias("last_us_aqi"),
    )


@query(
    "m19_learning_curve",
    cte("hgrid", extra=[SPAN_SQL])
    + f"SELECT {r6('f', 'fraction')}, (SELECT CAST(sum(greatest(val_to - val_from, 0)) AS BIGINT) FROM sz) AS n FROM (SELECT unnest([0.1::DOUBLE, 0.325, 0.55, 0.775, 1.0]) AS f)",
)
def m19(spark, d):
    frame, names = _frame(spark, d, (1,))
    return P.learning_curve(frame, HOURLY, names, "us_aqi", 1, "linear").select("fraction", "n")
