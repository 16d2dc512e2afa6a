"""Queries over ordered series: features, fills, grids, splits, windows, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeline.operators import features as X
from breezeline.operators import fill as G
from breezeline.operators import serve as S
from breezeline.operators.blocks import drop_helpers, with_positions
from breezeline.operators.forecast import baseline_forecast, recent_trend
from breezeline.operators.grid import bucket_mean, regular_grid
from breezeline.operators.rank import latest, newest_file_rows, rank_by_value
from breezeline.plans import inputs as I
from breezeline.plans.inputs import FILLED, HOURLY, SENSOR, cte, fill_sql, query, r6, rounded
from breezeline.plans.rollups import LATEST_SQL
from breezeline.sources.clean import dedupe_first

# All seven metrics, the target first.
WIDE = ("us_aqi", *[m for m in I.METRICS if m != "us_aqi"])
W = "WINDOW w AS (PARTITION BY city_slug ORDER BY ts)"


def frame_sql(before: int, after: int = 0) -> str:
    return (
        f"(PARTITION BY city_slug ORDER BY ts ROWS BETWEEN {before} PRECEDING AND "
        + ("CURRENT ROW" if after == 0 else f"{after} FOLLOWING")
        + ")"
    )


def framed_query(build, before, after=0, cols=WIDE):
    from breezeline.operators.blocks import framed

    def run(spark, d):
        return framed(I.hourly(spark, d, cols), HOURLY, before, after, build)

    return run


query(
    "w01_lag_features",
    cte("hourly")
    + f"SELECT city_slug, ts, {rounded(WIDE)}, "
    + ", ".join(r6(f"lag({c}, {k}) OVER w", f"{c}_lag_{k}h") for c in WIDE for k in X.LAGS)
    + f" FROM hourly {W}",
)(framed_query(lambda w: X.lag_columns(w, WIDE, X.LAGS), 24))

query(
    "w02_rolling_means",
    cte("hourly")
    + f"SELECT city_slug, ts, {rounded(WIDE)}, "
    + ", ".join(r6(f"avg({c}) OVER {frame_sql(k - 1)}", f"{c}_roll_{k}h") for c in WIDE for k in X.ROLLING)
    + " FROM hourly",
)(framed_query(lambda w: X.rolling_mean_columns(w, WIDE, X.ROLLING), 23))

query(
    "w03_rolling_std",
    cte("hourly")
    + f"SELECT city_slug, ts, {rounded(WIDE)}, "
    + ", ".join(r6(f"stddev_samp({c}) OVER {frame_sql(2)}", f"{c}_std_3h") for c in WIDE)
    + " FROM hourly",
)(framed_query(lambda w: X.rolling_std_columns(w, WIDE, (3,)), 2))


@query(
    "w04_centered_mean_fill",
    cte("hgrid")
    + "SELECT city_slug, ts, "
    + ", ".join(r6(f"coalesce({c}, avg({c}) OVER {frame_sql(5, 4)})", c) for c in WIDE)
    + " FROM hgrid",
)
def w04(spark, d):
    grid = regular_grid(I.hourly(spark, d, WIDE), HOURLY, WIDE)
    return drop_helpers(G.centered_mean_fill(grid, HOURLY, WIDE))


query(
    "w05_daily_delta",
    cte("hourly")
    + f"SELECT city_slug, ts, {rounded(WIDE)}, "
    + ", ".join(r6(f"{c} - lag({c}, 24) OVER w", f"{c}_delta_24h") for c in WIDE)
    + f" FROM hourly {W}",
)(framed_query(lambda w: X.delta_columns(w, WIDE), 24))

query(
    "w06_lead_targets",
    cte("hourly")
    + f"SELECT city_slug, ts, {rounded(WIDE)}, "
    + ", ".join(r6(f"lead(us_aqi, {h}) OVER w", f"us_aqi_h{h}") for h in range(1, 25))
    + f" FROM hourly {W}",
)(framed_query(lambda w: X.lead_columns(w, "us_aqi", 24), 0, 24))


@query(
    "w01_w06_feature_frame",
    cte("hourly")
    + f"SELECT city_slug, ts, {rounded(WIDE)}, "
    + ", ".join(r6(f"lag({c}, {k}) OVER w", f"{c}_lag_{k}h") for c in WIDE for k in X.LAGS)
    + ", "
    + ", ".join(r6(f"avg({c}) OVER {frame_sql(k - 1)}", f"{c}_roll_{k}h") for c in WIDE for k in X.ROLLING)
    + ", "
    + ", ".join(r6(f"{c} - lag({c}, 24) OVER w", f"{c}_delta_24h") for c in WIDE)
    + ", "
    + ", ".join(r6(f"lead(us_aqi, {h}) OVER w", f"us_aqi_h{h}") for h in (1, 6, 24))
    + ", hour(ts) AS hour, (dayofweek(ts) + 6) % 7 AS day_of_week, month(ts) AS month, "
    + r6("pm2_5 / nullif(pm10, 0)", "pm25_pm10_ratio")
    + ", "
    + r6("carbon_monoxide / nullif(nitrogen_dioxide, 0)", "co_no2_ratio")
    + f" FROM hourly {W}",
)
def w_features(spark, d):
    return X.feature_frame(I.hourly(spark, d, WIDE), HOURLY, WIDE, target="us_aqi", horizon=(1, 6, 24))


def grid_fill(steps, cols=FILLED):
    def run(spark, d):
        grid = regular_grid(I.hourly(spark, d, cols), HOURLY, cols)
        return drop_helpers(G.fill_chain(grid, HOURLY, cols, steps))

    return run


def grid_fill_sql(kind, limit, cols=FILLED):
    return cte("hgrid", extra=[fill_sql("hgrid", "f1", cols, kind, limit)]) + (
        f"SELECT city_slug, ts, {rounded(cols)} FROM f1"
    )


query("w07_forward_fill_24", grid_fill_sql("ffill", 24))(grid_fill([G.forward_step(24)]))
query("w07_forward_fill", grid_fill_sql("ffill", None))(grid_fill([G.forward_step(None)]))
query("w07_backward_fill_24", grid_fill_sql("bfill", 24))(grid_fill([G.backward_step(24)]))
query("w07_backward_fill", grid_fill_sql("bfill", None))(grid_fill([G.backward_step(None)]))
query("w08_interpolate_forward_6", grid_fill_sql("linear", 6))(grid_fill([G.linear_step(6)]))
query("w08_interpolate_both_3", grid_fill_sql("both", 3))(grid_fill([G.linear_step(3, both=True)]))
query("w08_interpolate_both", grid_fill_sql("both", None))(grid_fill([G.linear_step(None, both=True)]))


@query(
    "w08_interpolate_rows",
    cte(
        "hourly",
        extra=[
            f"hp AS (SELECT city_slug, ts, {', '.join(FILLED)}, row_number() OVER (PARTITION BY city_slug ORDER BY ts) - 1 AS pos FROM hourly)",
            fill_sql("hp", "f1", FILLED, "linear", 6),
        ],
    )
    + f"SELECT city_slug, ts, {rounded(FILLED)} FROM f1",
)
def w08_rows(spark, d):
    """By row position on the frame as it is, without a grid."""
    return G.interpolate(I.hourly(spark, d, FILLED), HOURLY, FILLED, 6)


@query(
    "w09_dedupe_first",
    cte("obs")
    + f"""SELECT city_slug, hour, event_id, {r6('us_aqi')} FROM (SELECT *, date_trunc('hour', observed_at) AS hour,
 row_number() OVER (PARTITION BY city_slug, date_trunc('hour', observed_at) ORDER BY observed_at, event_id) AS rn FROM obs) WHERE rn = 1""",
)
def w09(spark, d):
    o = I.observations(spark, d).withColumn("hour", F.date_trunc("hour", "observed_at"))
    first = dedupe_first(o, ["city_slug", "hour"], [F.col("observed_at"), F.col("event_id")])
    return first.select("city_slug", "hour", "event_id", "us_aqi")


@query(
    "w10_latest_observations",
    cte("newest", extra=[
        """recent AS (SELECT obs.*, row_number() OVER (PARTITION BY city_slug ORDER BY observed_at DESC, event_id DESC) AS rn
 FROM obs, newest WHERE observed_at >= as_of - INTERVAL 7 DAYS)"""])
    + f"SELECT city_slug, city_name, observed_at, event_id, {rounded(I.METRICS)} FROM recent WHERE rn = 1",
)
def w10(spark, d):
    as_of, since = I.trailing(spark, d, "7 DAYS")
    o = I.observations(spark, d, since)
    newest = latest(o, ["city_slug"], "observed_at", [F.col("event_id").desc()], "7 DAYS", as_of)
    return newest.select("city_slug", "city_name", "observed_at", "event_id", *I.METRICS)


USERS_SQL = """users AS (SELECT 'user_' || user_id AS city_slug, avg(us_aqi) AS us_aqi, round(avg(pm2_5) + 1e-9, 6) AS pm2_5 FROM obs GROUP BY 1)"""


@query(
    "w11_ranked_series",
    cte("obs", extra=[USERS_SQL])
    + f"SELECT city_slug, {rounded(('us_aqi', 'pm2_5'))}, row_number() OVER (ORDER BY coalesce(pm2_5, 0) DESC, city_slug) AS rank FROM users",
)
def w11(spark, d):
    users = (
        I.observations(spark, d)
        .groupBy(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("city_slug"))
        .agg(F.avg("us_aqi").alias("us_aqi"), F.round(F.avg("pm2_5") + 1e-9, 6).alias("pm2_5"))
    )
    return rank_by_value(users, "pm2_5", "city_slug")


@query(
    "w11_ranked_cities",
    cte("obs", extra=[LATEST_SQL])
    + f"""SELECT city_slug, observed_at, {r6('us_aqi')}, row_number() OVER (ORDER BY coalesce(us_aqi,0) DESC, city_slug) AS rank,
 CASE WHEN us_aqi >= 300 THEN 'hazardous' WHEN us_aqi >= 200 THEN 'very_unhealthy' WHEN us_aqi >= 150 THEN 'unhealthy'
 WHEN us_aqi >= 100 THEN 'unhealthy_sg' WHEN us_aqi >= 50 THEN 'moderate' ELSE 'good' END AS category FROM latest""",
)
def w11c(spark, d):
    newest = latest(I.observations(spark, d), ["city_slug"], "observed_at", [F.col("event_id").desc()])
    return S.ranked_cities(newest).select("city_slug", "observed_at", "us_aqi", "rank", "category")


POS_SQL = f"""hp AS (SELECT city_slug, ts, {", ".join(WIDE)}, row_number() OVER (PARTITION BY city_slug ORDER BY ts) - 1 AS pos,
 count(*) OVER (PARTITION BY city_slug) AS n FROM hourly)"""
SPLIT_SQL = """sp AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM hp)"""


@query(
    "w12_chronological_split",
    cte("hourly", extra=[POS_SQL, SPLIT_SQL]) + f"SELECT city_slug, ts, {rounded(WIDE)}, split FROM sp",
)
def w12(spark, d):
    return X.chronological_split(I.hourly(spark, d, WIDE), HOURLY)


def windows_summary(w):
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, e: acc + f(e))
    return w.select(
        "city_slug",
        "split",
        "ts",
        "window_index",
        "window_count",
        F.size("x").alias("x_len"),
        F.size("y").alias("y_len"),
        total(F.col("x"), lambda e: e["us_aqi"]).alias("x_sum"),
        F.col("x")[0]["us_aqi"].alias("x_first"),
        F.element_at("x", -1)["us_aqi"].alias("x_last"),
        total(F.col("y"), lambda e: e).alias("y_sum"),
        F.col("y")[0].alias("y_first"),
        F.element_at("y", -1).alias("y_last"),
    )


WINDOWS_SQL = """wi AS (SELECT city_slug, split, ts, row_number() OVER p - 1 AS window_index,
 count(*) OVER (PARTITION BY city_slug, split) - 24 - 6 + 1 AS window_count, 24 AS x_len, 6 AS y_len,
 sum(us_aqi) OVER (p ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS x_sum, us_aqi AS x_first, lead(us_aqi, 23) OVER p AS x_last,
 sum(us_aqi) OVER (p ROWS BETWEEN 24 FOLLOWING AND 29 FOLLOWING) AS y_sum, lead(us_aqi, 24) OVER p AS y_first, lead(us_aqi, 29) OVER p AS y_last
 FROM sp WINDOW p AS (PARTITION BY city_slug, split ORDER BY ts)),
ws AS (SELECT * FROM wi WHERE window_index < window_count)"""
WCOLS = ("x_sum", "x_first", "x_last", "y_sum", "y_first", "y_last")


def _windows(spark, d):
    split = X.chronological_split(I.hourly(spark, d, WIDE), HOURLY, keep_helpers=True)
    return X.supervised_windows(split, HOURLY, WIDE, "us_aqi", 24, 6)


@query(
    "w13_supervised_windows",
    cte("hourly", extra=[POS_SQL, SPLIT_SQL, WINDOWS_SQL])
    + f"SELECT city_slug, split, ts, window_index, window_count, x_len, y_len, {rounded(WCOLS)} FROM ws",
)
def w13(spark, d):
    return windows_summary(_windows(spark, d))


@query(
    "w14_limited_windows",
    cte(
        "hourly",
        extra=[
            POS_SQL,
            SPLIT_SQL,
            WINDOWS_SQL,
            """picks AS (SELECT DISTINCT city_slug, split, CAST(floor(i * (window_count - 1) / 29.0::DOUBLE) AS BIGINT) AS window_index
 FROM (SELECT DISTINCT city_slug, split, window_count FROM ws) g, generate_series(0, 29) t(i) WHERE window_count > 30)""",
        ],
    )
    + f"""SELECT city_slug, split, ts, window_index, window_count, x_len, y_len, {rounded(WCOLS)} FROM ws
 WHERE window_count <= 30 OR EXISTS (SELECT 1 FROM picks p WHERE p.city_slug = ws.city_slug AND p.split = ws.split AND p.window_index = ws.window_index)""",
)
def w14(spark, d):
    return windows_summary(X.limit_windows(_windows(spark, d), 30))


@query(
    "w15_gaps",
    cte(
        "hgrid",
        extra=[
            "lg AS ("
            + " UNION ALL ".join(f"SELECT city_slug, ts, pos, '{c}' AS metric, {c} IS NULL AS miss FROM hgrid" for c in FILLED)
            + ")",
            "isl AS (SELECT *, pos - row_number() OVER (PARTITION BY city_slug, metric ORDER BY pos) AS g FROM lg WHERE miss)",
        ],
    )
    + "SELECT city_slug, metric, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS gap_rows FROM isl GROUP BY city_slug, metric, g",
)
def w15(spark, d):
    return G.gaps(regular_grid(I.hourly(spark, d, FILLED), HOURLY, FILLED), HOURLY, FILLED)


SMALL_FLAGS = """sg AS (SELECT city_slug, {flags} FROM (SELECT hgrid.*, {near} FROM hgrid
 WINDOW wb AS (PARTITION BY city_slug ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 wf AS (PARTITION BY city_slug ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) GROUP BY 1),
hs AS (SELECT * FROM hgrid JOIN sg USING (city_slug))""".format(
    near=", ".join(I.nearest_sql(c) for c in FILLED),
    flags=", ".join(
        f"coalesce(min(CASE WHEN {c} IS NULL THEN coalesce(np_{c}, len) - coalesce(pp_{c}, -1) - 1 END) <= 2, false) AS small_{c}"
        for c in FILLED
    ),
)


@query(
    "w15_small_gap_fill",
    cte("hgrid", extra=[SMALL_FLAGS, fill_sql("hs", "f1", FILLED, "both", 2, when="small_{c}")])
    + f"SELECT city_slug, ts, {rounded(FILLED)} FROM f1",
)
def w15s(spark, d):
    grid = regular_grid(I.hourly(spark, d, FILLED), HOURLY, FILLED)
    return drop_helpers(G.small_gap_fill(grid, HOURLY, FILLED, 2))


@query("w16_regular_grid", cte("hgrid") + f"SELECT city_slug, ts, {rounded(FILLED)} FROM hgrid")
def w16(spark, d):
    return drop_helpers(regular_grid(I.hourly(spark, d, FILLED), HOURLY, FILLED))


@query(
    "w17_quarter_hour_mean",
    cte(
        "sensors",
        extra=[
            """q AS (SELECT sensor, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10 FROM sensors GROUP BY 1, 2),
b AS (SELECT sensor, min(ts) AS a, max(ts) AS z FROM q GROUP BY 1),
s AS (SELECT sensor, unnest(generate_series(a, z, INTERVAL 15 MINUTE)) AS ts FROM b)"""
        ],
    )
    + f"SELECT sensor, ts, {rounded(('pm2_5', 'pm10'))} FROM s LEFT JOIN q USING (sensor, ts)",
)
def w17(spark, d):
    return bucket_mean(I.sensors(spark, d), SENSOR, ["pm2_5", "pm10"], 900)


JS2 = "floor(({e}) * 100.0 + 0.5) / 100.0"
JS1 = "floor(({e}) * 10.0 + 0.5) / 10.0"


@query(
    "w18_trend_over_range",
    cte(
        "hourly", "newest",
        extra=[
            """e AS (SELECT city_slug, count(*) AS n, arg_max(us_aqi, ts) AS l, arg_min(us_aqi, ts) AS f FROM hourly, newest
 WHERE ts >= as_of - INTERVAL 168 HOURS GROUP BY 1)""",
            "c AS (SELECT *, l - f AS ch, CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END AS pct FROM e)",
        ],
    )
    + f"""SELECT city_slug, CASE WHEN n < 2 OR abs(pct) < 2 THEN 'stable' WHEN ch > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
 {r6('CASE WHEN n < 2 THEN 0 ELSE ' + JS2.format(e='ch / n') + ' END', 'slope')},
 {r6('CASE WHEN n < 2 THEN 0 ELSE ' + JS1.format(e='pct') + ' END', 'change_percent')},
 {r6('CASE WHEN n < 2 THEN 0 ELSE ' + JS1.format(e='ch') + ' END', 'change_absolute')} FROM c""",
)
def w18(spark, d):
    as_of, since = I.trailing(spark, d, "168 HOURS")
    h = I.hourly(spark, d, ["us_aqi"], since).select("city_slug", F.col("ts").alias("hour"), F.col("us_aqi").alias("us_aqi_avg"))
    return S.trend_over_range(S.in_range(h, as_of, 168), ["city_slug"])


BASE_SQL = """tl AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY ts DESC) AS rn FROM hourly),
df AS (SELECT *, us_aqi - lag(us_aqi) OVER (PARTITION BY city_slug ORDER BY ts) AS dlt FROM tl WHERE rn <= 24),
bt AS (SELECT city_slug, arg_max(us_aqi, ts) AS cur, coalesce(avg(dlt), 0) AS trend, max(ts) AS last_ts, count(*) AS history FROM df GROUP BY 1),
bf AS (SELECT city_slug, last_ts, h AS horizon_hours, last_ts + h * INTERVAL 1 HOUR AS horizon_timestamp,
 least(greatest(cur + trend * h, 0), 500) AS predicted FROM bt, generate_series(1, 24) g(h) WHERE history >= 24)"""


@query(
    "w19_recent_trend",
    cte("hourly", extra=[BASE_SQL])
    + f"SELECT city_slug, {r6('cur', 'current')}, {r6('trend')}, last_ts, history FROM bt",
)
def w19(spark, d):
    return recent_trend(I.hourly(spark, d, ["us_aqi"]), HOURLY, "us_aqi")


@query(
    "w20_tail_rows",
    cte("hourly", extra=[BASE_SQL]) + f"SELECT city_slug, ts, {rounded(WIDE)} FROM tl WHERE rn <= 48",
)
def w20(spark, d):
    return X.tail(I.hourly(spark, d, WIDE), HOURLY, 48)


def baseline(spark, d):
    return baseline_forecast(I.hourly(spark, d, ["us_aqi"]), HOURLY, "us_aqi")


@query(
    "w21_half_window_trend",
    cte("hourly", extra=[BASE_SQL,
        "hw AS (SELECT city_slug, avg(predicted) FILTER (horizon_hours <= 12) AS a, avg(predicted) FILTER (horizon_hours > 12) AS b FROM bf GROUP BY 1)"])
    + f"SELECT city_slug, {r6('a', 'first_mean')}, {r6('b', 'second_mean')}, CASE WHEN b > a + 2 THEN 'up' WHEN b < a - 2 THEN 'down' ELSE 'stable' END AS trend FROM hw",
)
def w21(spark, d):
    return S.half_window_trend(baseline(spark, d), ["city_slug"], "horizon_hours", "predicted")


@query(
    "w22_least_squares_trend",
    cte("hourly", extra=[POS_SQL,
        "t AS (SELECT city_slug, regr_slope(us_aqi, pos) AS s, avg(us_aqi) AS m, max(us_aqi) AS x FROM hp WHERE pos >= n - 168 GROUP BY 1)"])
    + f"""SELECT city_slug, {r6('s', 'slope_per_hour')}, {r6('m', 'mean_forecast_aqi')}, {r6('x', 'max_forecast_aqi')},
 CASE WHEN s > 0.15 THEN 'rising' WHEN s < -0.15 THEN 'falling' ELSE 'stable' END AS trend_direction,
 CASE WHEN x >= 200 THEN 'very_unhealthy' WHEN x >= 150 THEN 'unhealthy' WHEN x >= 100 THEN 'moderate' ELSE 'good_to_satisfactory' END AS risk_band FROM t""",
)
def w22(spark, d):
    p = with_positions(I.hourly(spark, d, ["us_aqi"]), HOURLY)
    return S.least_squares_trend(p.where(F.col("_pos") >= F.col("_len") - 168), ["city_slug"], "_pos", "us_aqi")


@query(
    "w23_seasonal_naive_scale",
    cte("hourly", extra=["s AS (SELECT city_slug, abs(us_aqi - lag(us_aqi, 24) OVER (PARTITION BY city_slug ORDER BY ts)) AS df FROM hourly)"])
    + f"SELECT city_slug, {r6('avg(df)', 'scale')} FROM s GROUP BY 1",
)
def w23(spark, d):
    return X.seasonal_naive_scale(I.hourly(spark, d, ["us_aqi"]), HOURLY, "us_aqi", 24)


def _clip_sql(lo, hi):
    return ", ".join(
        r6(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo.format(c=c)}), {hi.format(c=c)}) END", c) for c in FILLED
    )


@query(
    "w24_winsorized",
    cte("hourly", extra=["q AS (SELECT city_slug, " + ", ".join(f"quantile_cont({c}, 0.01) AS a_{c}, quantile_cont({c}, 0.99) AS b_{c}" for c in FILLED) + " FROM hourly GROUP BY 1)"])
    + f"SELECT city_slug, ts, {_clip_sql('a_{c}', 'b_{c}')} FROM hourly JOIN q USING (city_slug)",
)
def w24(spark, d):
    return G.winsorize(I.hourly(spark, d, FILLED), HOURLY, FILLED)


@query(
    "w25_iqr_capped",
    cte("hourly", extra=["q AS (SELECT city_slug, " + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in FILLED) + " FROM hourly GROUP BY 1)"])
    + f"SELECT city_slug, ts, {_clip_sql('a_{c} - 1.5 * (b_{c} - a_{c})', 'b_{c} + 1.5 * (b_{c} - a_{c})')} FROM hourly JOIN q USING (city_slug)",
)
def w25(spark, d):
    return G.iqr_cap(I.hourly(spark, d, FILLED), HOURLY, FILLED)


@query(
    "w26_newest_file_rows",
    cte("bench", extra=["nw AS (SELECT phase, max(finished_at) AS f FROM bench GROUP BY 1)"])
    + "SELECT b.phase, b.row_id, b.finished_at::TIMESTAMP AS finished_at FROM bench b JOIN nw ON nw.phase = b.phase AND nw.f = b.finished_at",
)
def w26(spark, d):
    rows = newest_file_rows(I.benchmark_rows(spark, d), "phase", "finished_at")
    return rows.select("phase", "row_id", "finished_at")


@query(
    "w27_calendar_features",
    cte("hourly") + "SELECT city_slug, ts, hour(ts) AS hour, (dayofweek(ts) + 6) % 7 AS day_of_week, month(ts) AS month FROM hourly",
)
def w27(spark, d):
    return I.hourly(spark, d, ["us_aqi"]).select("city_slug", "ts", *X.calendar("ts"))


def median_sql(source, target, cols, by):
    m = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    return f"""{target}_m AS (SELECT {by}, {m} FROM {source} GROUP BY ALL),
{target} AS (SELECT s.* REPLACE ({", ".join(f"coalesce(s.{c}, m.m_{c}) AS {c}" for c in cols)}) FROM {source} s JOIN {target}_m m USING ({by}))"""


@query(
    "w28_impute_for_benchmark",
    cte("hgrid", extra=[
        fill_sql("hgrid", "f1", FILLED, "both", 6),
        fill_sql("(SELECT city_slug, ts, pos, " + ", ".join(FILLED) + " FROM f1)", "f2", FILLED, "ffill", 24),
        fill_sql("(SELECT city_slug, ts, pos, " + ", ".join(FILLED) + " FROM f2)", "f3", FILLED, "bfill", 24),
        median_sql("f3", "f4", FILLED, "city_slug"),
    ])
    + f"SELECT city_slug, ts, {rounded(FILLED)} FROM f4",
)
def w28(spark, d):
    return G.impute_for_benchmark(I.hourly(spark, d, FILLED), HOURLY, FILLED)


@query(
    "w29_impute_for_training",
    cte("hgrid", extra=[
        fill_sql("hgrid", "f1", FILLED, "linear", 6),
        fill_sql("(SELECT city_slug, ts, pos, " + ", ".join(FILLED) + " FROM f1)", "f2", FILLED, "ffill", 24),
        fill_sql("(SELECT city_slug, ts, pos, " + ", ".join(FILLED) + " FROM f2)", "f3", FILLED, "bfill", None),
        "f3m AS (SELECT city_slug, ts, pos, " + ", ".join(FILLED) + ", month(ts) AS mon FROM f3)",
        median_sql("f3m", "f4", FILLED, "city_slug, mon"),
        median_sql("f4", "f5", FILLED, "city_slug"),
    ])
    + f"SELECT city_slug, ts, {rounded(FILLED)} FROM f5",
)
def w29(spark, d):
    return G.impute_for_training(I.hourly(spark, d, FILLED), HOURLY, FILLED)


PM = ("pm2_5", "pm10")


def _cap_cte(source, target, a, b, lo, hi):
    q = ", ".join(f"quantile_cont({c}, {a}) AS a_{c}, quantile_cont({c}, {b}) AS b_{c}" for c in PM)
    out = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {lo.format(c=c)}), {hi.format(c=c)}) END AS {c}" for c in PM
    )
    return f"""{target}_q AS (SELECT sensor, {q} FROM {source} GROUP BY 1),
{target} AS (SELECT sensor, ts, {out} FROM {source} JOIN {target}_q USING (sensor))"""


CLEAN_SQL = [
    _cap_cte("sensors", "k1", 0.01, 0.99, "a_{c}", "b_{c}"),
    _cap_cte("k1", "k2", 0.25, 0.75, "a_{c} - 1.5 * (b_{c} - a_{c})", "b_{c} + 1.5 * (b_{c} - a_{c})"),
    "k3 AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY sensor) AS len FROM k2)",
    """ksg AS (SELECT sensor, {flags} FROM (SELECT k3.*, {near} FROM k3
 WINDOW wb AS (PARTITION BY sensor ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 wf AS (PARTITION BY sensor ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) GROUP BY 1),
k4 AS (SELECT * FROM k3 JOIN ksg USING (sensor))""".format(
        near=", ".join(I.nearest_sql(c) for c in PM),
        flags=", ".join(
            f"coalesce(min(CASE WHEN {c} IS NULL THEN coalesce(np_{c}, len) - coalesce(pp_{c}, -1) - 1 END) <= 3, false) AS small_{c}"
            for c in PM
        ),
    ),
    fill_sql("k4", "k5", PM, "both", 3, key="sensor", when="small_{c}"),
    fill_sql("(SELECT sensor, ts, pos, pm2_5, pm10 FROM k5)", "k6", PM, "ffill", None, key="sensor"),
    fill_sql("(SELECT sensor, ts, pos, pm2_5, pm10 FROM k6)", "k7", PM, "bfill", None, key="sensor"),
    """q AS (SELECT sensor, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10 FROM k7 GROUP BY 1, 2),
b AS (SELECT sensor, min(ts) AS a, max(ts) AS z FROM q GROUP BY 1),
s AS (SELECT sensor, unnest(generate_series(a, z, INTERVAL 15 MINUTE)) AS ts FROM b)""",
]


@query(
    "w30_clean_sensor_feed",
    cte("sensors", extra=CLEAN_SQL) + f"SELECT sensor, ts, {rounded(PM)} FROM s LEFT JOIN q USING (sensor, ts)",
)
def w30(spark, d):
    return G.clean_sensor_feed(I.sensors(spark, d), SENSOR, PM)


@query(
    "w31_last_known",
    cte("obs")
    + "SELECT city_slug, "
    + ", ".join(
        r6(f"arg_max({m}, (observed_at, event_id)) FILTER ({m} IS NOT NULL)", f"last_{m}") for m in I.METRICS
    )
    + " FROM obs GROUP BY 1",
)
def w31(spark, d):
    from breezeline.operators.joins import last_known

    o = I.observations(spark, d).withColumn("_at", F.struct("observed_at", "event_id"))
    return last_known(o, ["city_slug"], "_at", {f"last_{m}": m for m in I.METRICS})
