"""Projection, filter, join, ranking and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeline.functions import bands, numeric, text
from breezeline.functions.catalog import aliases
from breezeline.operators import aggregate as A
from breezeline.operators import evaluate as E
from breezeline.operators import joins as J
from breezeline.operators import serve as S
from breezeline.operators.fill import monthly_median_fill, threshold_mask
from breezeline.operators.rank import latest, sort_option, top
from breezeline.plans import inputs as I
from breezeline.plans.inputs import FILLED, HOURLY, cte, query, r6, rounded
from breezeline.plans.rollups import LATEST_SQL, VERIFIED_SQL, in_order, verified
from breezeline.schema import METRICS
from breezeline.sources import clean as C
from breezeline.sources.tables import new_watermarks

# ---- projections and filters -----------------------------------------------------------


def _as_text(spark, d, bad_time=False, bad_value=False):
    """Observations as they arrive in a text feed, with an extra column."""
    o = I.observations(spark, d)
    stamp = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if bad_time:
        stamp = F.when(F.col("us_aqi") > 100, "not a time").otherwise(stamp)
    values = {m: F.col(m).cast("string") for m in METRICS}
    if bad_value:
        values["us_aqi"] = F.when(F.col("sulphur_dioxide") > 50, "n/a").otherwise(values["us_aqi"])
    return o.select(
        F.col("city_name").alias("city"),
        stamp.alias("timestamp"),
        *[values[m].alias(m) for m in METRICS],
        F.col("event_id").alias("extra"),
    )


NINE = f"city_name AS city, observed_at AS timestamp, {rounded(METRICS)}"


@query("p01_normalised_observations", cte("obs") + f"SELECT {NINE} FROM obs")
def p01(spark, d):
    return C.normalise_observations(_as_text(spark, d))


@query("p02_lenient_times", cte("obs") + f"SELECT {NINE} FROM obs WHERE us_aqi <= 100")
def p02(spark, d):
    return C.normalise_observations(_as_text(spark, d, bad_time=True), strict=False)


@query(
    "p03_numeric_coercion",
    cte("obs") + f"SELECT event_id AS extra, {r6('CASE WHEN sulphur_dioxide <= 50 THEN us_aqi END', 'us_aqi')} FROM obs",
)
def p03(spark, d):
    return C.coerce_numbers(_as_text(spark, d, bad_value=True), ["us_aqi"]).select("extra", "us_aqi")


@query(
    "p04_complete_rows",
    cte("hourly") + f"SELECT city_slug, ts, {rounded(FILLED)} FROM hourly WHERE pm2_5 IS NOT NULL AND pm10 IS NOT NULL",
)
def p04(spark, d):
    return I.hourly(spark, d, FILLED).dropna(subset=["pm2_5", "pm10"])


@query(
    "p05_station_columns",
    cte("stations")
    + f"""SELECT side AS station_target, ts AS timestamp, {r6('pm2_5')}, {r6('pm10')}, {r6('no2')}, {r6('so2')},
 CAST(NULL AS DOUBLE) AS co_mg_m3, CAST(NULL AS DOUBLE) AS ozone, CAST(NULL AS DOUBLE) AS temperature_c,
 CAST(NULL AS DOUBLE) AS humidity_pct, 'file' AS source_url FROM stations""",
)
def p05(spark, d):
    raw = I.stations(spark, d).select(
        "side",
        F.col("ts").cast("string").alias("Timestamp (UTC)"),
        F.col("pm2_5").alias("PM2.5 (µg/m³)"),
        F.col("pm10").alias("PM10 (µg/m³)"),
        F.col("no2").alias("NO2 (µg/m³)"),
        F.col("so2").alias("SO2 (µg/m³)"),
    )
    return C.station_frame(raw, F.col("side"), F.lit("file"))


@query(
    "p06_sensor_fields",
    f"SELECT event_id AS entry_id, ts AS created_at, {r6('value', 'pm2_5')}, {r6('user_id', 'pm10')} FROM events",
)
def p06(spark, d):
    e = I.table(spark, d, "events").select(
        F.col("event_id").alias("entry_id"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("field1"),
        F.col("user_id").cast("double").alias("field2"),
    )
    return C.rename_sensor_fields(e)


@query(
    "p07_without_empty_columns",
    cte("stations") + f"SELECT station, ts, {rounded(('pm2_5', 'no2'))} FROM stations",
)
def p07(spark, d):
    return A.drop_empty_columns(I.stations(spark, d).select("station", "ts", "pm2_5", "no2", "humidity_pct"))


@query(
    "p08_threshold_mask",
    cte("sensors")
    + f"SELECT sensor, ts, {r6('CASE WHEN pm2_5 <= 80 THEN pm2_5 END', 'pm2_5')}, {r6('CASE WHEN pm10 <= 60 THEN pm10 END', 'pm10')} FROM sensors",
)
def p08(spark, d):
    return threshold_mask(I.sensors(spark, d), {"pm2_5": 80.0, "pm10": 60.0})


MARKS_SQL = """marks AS (SELECT city_slug, country, CASE WHEN country = 'AFRICA' THEN NULL WHEN country = 'ASIA' THEN max(observed_at) + INTERVAL 2 DAYS
 ELSE max(observed_at) - INTERVAL 1 DAY END AS last_observed_at FROM obs GROUP BY 1, 2)"""


@query(
    "p09_read_window",
    cte("newest", extra=[MARKS_SQL, """st AS (SELECT city_slug, last_observed_at, as_of AS window_end,
 coalesce(last_observed_at - INTERVAL 6 HOURS, as_of - INTERVAL 24 HOURS) AS s FROM marks, newest)"""])
    + "SELECT city_slug, last_observed_at, CASE WHEN s >= window_end THEN window_end - INTERVAL 1 HOUR ELSE s END AS window_start, window_end FROM st",
)
def p09(spark, d):
    o = I.observations(spark, d)
    top_ts = F.max("observed_at")
    mark = (
        F.when(F.first("country") == "AFRICA", F.lit(None).cast("timestamp"))
        .when(F.first("country") == "ASIA", top_ts + F.expr("INTERVAL 2 DAYS"))
        .otherwise(top_ts - F.expr("INTERVAL 1 DAY"))
    )
    marks = o.groupBy("city_slug").agg(mark.alias("last_observed_at"))
    return C.read_window(marks, I.as_of(o))


@query(
    "p10_week_of_hourly",
    cte("hourly", "newest") + f"SELECT city_slug, ts AS hour, {r6('us_aqi')} FROM hourly, newest WHERE ts >= as_of - INTERVAL 168 HOURS",
)
def p10(spark, d):
    hours = S.range_hours("7d")
    as_of, since = I.trailing(spark, d, f"{hours} HOURS")
    h = I.hourly(spark, d, ["us_aqi"], since).withColumnRenamed("ts", "hour")
    return S.in_range(h, as_of, hours)


@query(
    "p11_trailing_year",
    cte("stations", extra=["m AS (SELECT side, max(ts) AS z FROM stations GROUP BY 1)"])
    + f"SELECT side, ts, l_orderkey, l_linenumber, {r6('pm2_5')} FROM stations JOIN m USING (side) WHERE ts >= z - INTERVAL 365 DAYS",
)
def p11(spark, d):
    st = I.stations(spark, d).select("side", "ts", "l_orderkey", "l_linenumber", "pm2_5")
    return C.trailing_days(st, ["side"], "ts")


@query(
    "p12_metric_columns",
    cte("obs")
    + f"SELECT city_slug, date_trunc('hour', observed_at) AS hour, {r6('avg(pm2_5)', 'pm2_5_avg')}, {r6('max(pm2_5)', 'pm2_5_max')}, {r6('min(pm2_5)', 'pm2_5_min')}, {r6('stddev_samp(pm2_5)', 'pm2_5_stddev')} FROM obs GROUP BY 1, 2",
)
def p12(spark, d):
    return S.metric_columns(I.hourly_aggregates(spark, d), "pm2_5", ["city_slug", "hour"])


@query("p13_model_subset", cte("bench") + f"SELECT row_id, model, {r6('rmse')} FROM bench WHERE model IN ('1-URGENT', '5-LOW')")
def p13(spark, d):
    b = I.benchmark_rows(spark, d)
    return b.where(F.col("model").isin("1-URGENT", "5-LOW")).select("row_id", "model", "rmse")


@query("p14_finished_rows", cte("bench") + f"SELECT row_id, model, {r6('rmse')} FROM bench WHERE status = 'ok' AND rmse IS NOT NULL")
def p14(spark, d):
    return E.usable(I.benchmark_rows(spark, d)).select("row_id", "model", "rmse")


@query(
    "p16_required_metrics",
    cte("stations")
    + " UNION ALL ".join(
        f"SELECT side, '{m}' AS metric, '{level}' AS level FROM stations GROUP BY 1 HAVING count({m}) = 0"
        for m, level in (("pm2_5", "error"), ("humidity_pct", "error"), ("no2", "warning"))
    ),
)
def p16(spark, d):
    return A.required_metric_report(I.stations(spark, d), "side", ["pm2_5", "humidity_pct"], ["no2"])


@query(
    "p17_station_content",
    "SELECT p_type, max(contains(lower(p_name), 'widget') OR contains(lower(p_name), 'no such')) AS content_ok FROM part GROUP BY 1",
)
def p17(spark, d):
    """All rows are looked at, not just the leading ones."""
    return J.station_content_check(I.table(spark, d, "part"), ["p_type"], "p_name", ["Widget", "no such"])


@query(
    "p18_radar_values",
    cte("obs", extra=[LATEST_SQL])
    + f"SELECT city_slug, {r6('least(coalesce(pm2_5,0),100)', 'pm2_5')}, {r6('least(coalesce(us_aqi,0),100)', 'us_aqi')}, {r6('least(coalesce(carbon_monoxide,0)*100,100)', 'co')} FROM latest",
)
def p18(spark, d):
    newest = latest(I.observations(spark, d), ["city_slug"], "observed_at", [F.col("event_id").desc()])
    return newest.select(
        "city_slug",
        bands.radar_value("pm2_5").alias("pm2_5"),
        bands.radar_value("us_aqi").alias("us_aqi"),
        bands.radar_value("carbon_monoxide", 100.0).alias("co"),
    )


# ---- joins -----------------------------------------------------------------------------


def _actuals(spark, d):
    return I.hourly(spark, d, ["us_aqi"]).select(
        "city_slug", F.col("ts").alias("horizon_timestamp"), F.col("us_aqi").alias("actual")
    )


PAIR_SQL = """pair AS (SELECT f.*, h.us_aqi AS actual FROM forecasts f JOIN hourly h ON h.city_slug = f.city_slug AND h.ts = f.horizon_timestamp)"""


def pairs(spark, d):
    return I.forecasts(spark, d).join(_actuals(spark, d), ["city_slug", "horizon_timestamp"]).dropna(
        subset=["actual", "predicted_us_aqi"]
    )


@query(
    "j01_forecasts_with_actuals",
    cte("forecasts", extra=[PAIR_SQL]) + f"SELECT forecast_id, horizon_timestamp, {r6('predicted_us_aqi')}, {r6('actual')} FROM pair",
)
def j01(spark, d):
    return pairs(spark, d).select("forecast_id", "horizon_timestamp", "predicted_us_aqi", "actual")


@query(
    "j02_catalogue_enrichment",
    cte("obs")
    + f"""SELECT event_id, city_slug, CASE WHEN country = 'EUROPE' THEN city_slug ELSE replace(city_slug, '_', '-') END AS display_slug,
 CASE WHEN country = 'EUROPE' THEN 'Unknown' ELSE country END AS country, {r6('us_aqi')} FROM obs""",
)
def j02(spark, d):
    """Cities of one region are missing from the catalogue on purpose."""
    cat = (
        I.cities(spark, d)
        .where("country <> 'EUROPE'")
        .select(
            text.warehouse_slug("city_name").alias("warehouse_slug"),
            text.url_slug("city_name").alias("url_slug"),
            "country",
        )
    )
    o = I.observations(spark, d).select("event_id", "city_slug", "us_aqi")
    return J.enrich_from_catalog(o, cat)


@query(
    "j03_series_with_watermarks",
    cte("obs")
    + "SELECT c.city_slug, w.last_observed_at FROM cities c LEFT JOIN (SELECT city_slug, max(observed_at) AS last_observed_at FROM obs WHERE country <> 'AFRICA' GROUP BY 1) w USING (city_slug)",
)
def j03(spark, d):
    marks = new_watermarks(I.observations(spark, d).where("country <> 'AFRICA'"), "city_slug", "observed_at", "feed")
    return J.with_watermarks(I.cities(spark, d).select("city_slug"), marks)


TOKEN_SQL = """tok AS (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'nation-' || c_nationkey WHEN 'FURNITURE' THEN ' Nation_' || c_nationkey || ' '
 WHEN 'HOUSEHOLD' THEN 'NATION_' || c_nationkey ELSE 'atlantis ' || c_nationkey END AS token, c_nationkey,
 c_mktsegment IN ('MACHINERY','FURNITURE','HOUSEHOLD') AS known FROM customer)"""


def _tokens(spark, d):
    key = F.col("c_nationkey").cast("string")
    seg = F.col("c_mktsegment")
    token = (
        F.when(seg == "MACHINERY", F.concat(F.lit("nation-"), key))
        .when(seg == "FURNITURE", F.concat(F.lit(" Nation_"), key, F.lit(" ")))
        .when(seg == "HOUSEHOLD", F.concat(F.lit("NATION_"), key))
        .otherwise(F.concat(F.lit("atlantis "), key))
    )
    return I.table(spark, d, "customer").select("c_custkey", token.alias("token"))


@query(
    "j04_resolved_tokens",
    cte("cities", extra=[TOKEN_SQL]) + "SELECT c_custkey, token, CASE WHEN known THEN 'nation_' || c_nationkey END AS city_slug FROM tok",
)
def j04(spark, d):
    dim = aliases(I.cities(spark, d).withColumnRenamed("city_name", "name"))
    return J.resolve_tokens(_tokens(spark, d), dim)


@query("j04_unknown_tokens", cte("cities", extra=[TOKEN_SQL]) + "SELECT c_custkey, token FROM tok WHERE NOT known")
def j04u(spark, d):
    dim = aliases(I.cities(spark, d).withColumnRenamed("city_name", "name"))
    return J.unknown_tokens(_tokens(spark, d), dim)


ALIAS_SQL = """res AS (SELECT DISTINCT p_name || ' ' || p_size AS name FROM part),
tg AS (SELECT DISTINCT p_type || '-' || p_size AS target, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' ' || (p_size % 7) AS alias FROM part
 UNION SELECT DISTINCT p_type || '-' || p_size, right(p_name, 4) || ' ' || p_size FROM part WHERE p_type = 'PROMO' UNION SELECT 'nothing', 'zeppelin'),
nr AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS n FROM res),
na AS (SELECT target, trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS a FROM tg),
sc AS (SELECT target, name, max(CASE WHEN n = a THEN 100 WHEN contains(' ' || n || ' ', ' ' || a || ' ') THEN 80 ELSE 50 END) AS score
 FROM nr, na WHERE a <> '' AND contains(n, a) GROUP BY 1, 2)"""


def _match_sides(spark, d):
    p = I.table(spark, d, "part")
    size = F.col("p_size").cast("string")
    target = F.concat_ws("-", "p_type", size)
    names = p.select(F.concat_ws(" ", "p_name", size).alias("name")).distinct()
    words = F.split("p_name", " ")
    one = p.select(
        target.alias("target"), F.concat_ws(" ", words[0], words[1], (F.col("p_size") % 7).cast("string")).alias("alias")
    )
    two = p.where("p_type = 'PROMO'").select(
        target.alias("target"), F.concat_ws(" ", F.expr("right(p_name, 4)"), size).alias("alias")
    )
    none = p.select(F.lit("nothing").alias("target"), F.lit("zeppelin").alias("alias")).distinct()
    return names, one.union(two).union(none).distinct()


@query("j05_alias_scores", "WITH " + ALIAS_SQL + " SELECT target, name, score FROM sc")
def j05s(spark, d):
    names, targets = _match_sides(spark, d)
    return J.alias_scores(names, "name", targets, "target", "alias")


@query(
    "j05_matched_targets",
    "WITH "
    + ALIAS_SQL
    + """, b AS (SELECT target, max(score) AS score FROM sc GROUP BY 1),
k AS (SELECT s.target, s.score, count(*) AS candidates, min(name) AS m FROM sc s JOIN b ON b.target = s.target AND b.score = s.score GROUP BY 1, 2)
SELECT t.target, CASE WHEN k.target IS NULL THEN 'unmatched' WHEN candidates > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
 coalesce(k.score, 0) AS score, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN m END AS matched
 FROM (SELECT DISTINCT target FROM tg) t LEFT JOIN k USING (target)""",
)
def j05(spark, d):
    names, targets = _match_sides(spark, d)
    return J.match_targets(names, "name", targets, "target", "alias")


@query(
    "j06_monthly_median_fill",
    cte("hourly", extra=["m AS (SELECT city_slug, month(ts) AS mo, median(pm2_5) AS a, median(pm10) AS b FROM hourly GROUP BY 1, 2)"])
    + f"SELECT h.city_slug, ts, {r6('coalesce(pm2_5, a)', 'pm2_5')}, {r6('coalesce(pm10, b)', 'pm10')} FROM hourly h JOIN m ON m.city_slug = h.city_slug AND m.mo = month(h.ts)",
)
def j06(spark, d):
    cols = ["pm2_5", "pm10"]
    return monthly_median_fill(I.hourly(spark, d, cols), HOURLY, cols)


@query(
    "j07_orphans",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def j07(spark, d):
    o = I.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    parents = I.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return J.orphans(o, parents, ["key"]).select("o_orderkey", F.col("key").alias("o_custkey"))


@query(
    "j07_cascade",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def j07c(spark, d):
    o = I.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    parents = I.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return J.cascade(o, parents, ["key"]).select("o_orderkey", F.col("key").alias("o_custkey"))


@query(
    "j08_skipped_with_artifacts",
    cte("bench")
    + """SELECT row_id, city || '/' || trim(regexp_replace(lower(model), '[^a-z0-9]+', '_', 'g'), '_') || '.pt' AS artifact_path,
 EXISTS (SELECT 1 FROM bench k WHERE k.status = 'ok' AND k.city = b.city AND k.model = b.model AND k.rmse < 1) AS artifact_found
 FROM bench b WHERE status = 'skipped' AND family = 'deep_learning'""",
)
def j08(spark, d):
    path = F.concat(F.col("city"), F.lit("/"), text.artifact_model_name("model"), F.lit(".pt"))
    b = I.benchmark_rows(spark, d).withColumn("artifact_path", path)
    files = b.where("status = 'ok' AND rmse < 1").select("artifact_path")
    return J.skipped_with_artifacts(b, files).select("row_id", "artifact_path", "artifact_found")


@query(
    "j09_verified_forecasts",
    cte("forecasts", "newest", extra=[VERIFIED_SQL])
    + f"SELECT forecast_id, horizon_timestamp, {rounded(('predicted_us_aqi', 'actual_us_aqi', 'actual_pm2_5', 'prediction_error', 'absolute_error'))}, verified_at FROM verified",
)
def j09(spark, d):
    cols = ["predicted_us_aqi", "actual_us_aqi", "actual_pm2_5", "prediction_error", "absolute_error"]
    return verified(spark, d).select("forecast_id", "horizon_timestamp", *cols, "verified_at")


@query(
    "j10_missing_features",
    cte("obs")
    + "SELECT user_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN count({m}) = 0 THEN '{m}' END" for m in METRICS)
    + "], lambda x: x IS NOT NULL), ',') AS missing FROM obs GROUP BY 1",
)
def j10(spark, d):
    """Expected feature columns without any reading, per user series."""
    have = F.array_compact(F.array(*[F.when(F.count(m) > 0, F.lit(m)) for m in METRICS]))
    expected = F.array(*[F.lit(m) for m in METRICS])
    return (
        I.observations(spark, d)
        .groupBy("user_id")
        .agg(F.array_join(F.array_except(expected, have), ",").alias("missing"))
    )


def _cutoff(spark, d):
    """A moment four days before the end, so that forecasts lie ahead of it."""
    return I.as_of(I.observations(spark, d)) - F.expr("INTERVAL 4 DAYS")


def _hour_avg(spark, d):
    return I.hourly(spark, d, ["us_aqi"]).select(
        "city_slug", F.col("ts").alias("hour"), F.col("us_aqi").alias("us_aqi_avg")
    )


TIMELINE_SQL = """ck AS (SELECT as_of - INTERVAL 4 DAYS AS c FROM newest),
past AS (SELECT city_slug, ts AS timestamp, CASE WHEN us_aqi <> 0 THEN floor(us_aqi + 0.5) END AS actual_aqi, CAST(NULL AS DOUBLE) AS predicted_aqi,
 0.0::DOUBLE AS uncertainty, NULL AS model_type, CAST(NULL AS DOUBLE) AS confidence FROM hourly, ck WHERE ts >= c - INTERVAL 24 HOURS),
nx AS (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY horizon_timestamp, forecast_id) AS rn FROM forecasts, ck WHERE horizon_timestamp >= c),
fut AS (SELECT city_slug, horizon_timestamp AS timestamp, CAST(NULL AS DOUBLE) AS actual_aqi, floor(predicted_us_aqi + 0.5) AS predicted_aqi,
 floor((1 - confidence) * 50 + 0.5) AS uncertainty, model_type, confidence FROM nx WHERE rn <= 168),
line AS (SELECT * FROM past UNION ALL SELECT * FROM fut)"""


def _line(spark, d):
    return S.prediction_timeline(_hour_avg(spark, d), I.forecasts(spark, d), _cutoff(spark, d))


LINE_COLS = ("actual_aqi", "predicted_aqi", "uncertainty", "confidence")


@query(
    "u02_prediction_timeline",
    cte("forecasts", "newest", extra=[TIMELINE_SQL]) + f"SELECT city_slug, timestamp, model_type, {rounded(LINE_COLS)} FROM line",
)
def u02(spark, d):
    return _line(spark, d)


@query(
    "j11_prediction_summary",
    cte("forecasts", "newest", extra=[
        TIMELINE_SQL,
        """hd AS (SELECT city_slug, avg(predicted_aqi) AS nm FROM (SELECT *, row_number() OVER (PARTITION BY city_slug ORDER BY timestamp, model_type, predicted_aqi) AS k FROM line WHERE predicted_aqi IS NOT NULL) WHERE k <= 4 GROUP BY 1),
sm AS (SELECT city_slug, coalesce(arg_max(actual_aqi, timestamp) FILTER (actual_aqi IS NOT NULL), 0) AS cur, count(predicted_aqi) AS forecast_points,
 arg_max(model_type, (timestamp, model_type, predicted_aqi)) FILTER (model_type IS NOT NULL) AS mn, arg_max(confidence, (timestamp, model_type, predicted_aqi)) FILTER (confidence <> 0) AS mc FROM line GROUP BY 1)""",
    ])
    + f"""SELECT city_slug, {r6('cur', 'current_aqi')}, {r6('coalesce(nm, 0)', 'next_mean')}, CASE WHEN forecast_points > 0 THEN coalesce(mn, 'No Model Available') ELSE 'Awaiting Training' END AS model_name, {r6('coalesce(mc, 0)', 'model_confidence')},
 CASE WHEN coalesce(nm,0) > cur + 5 THEN 'up' WHEN coalesce(nm,0) < cur - 5 THEN 'down' ELSE 'stable' END AS trend, forecast_points FROM sm LEFT JOIN hd USING (city_slug)""",
)
def j11(spark, d):
    return S.prediction_summary(_line(spark, d))


# ---- sorts and top-k -------------------------------------------------------------------


@query(
    "l01_ordered_hourly",
    cte("obs") + f"SELECT city_slug, date_trunc('hour', observed_at) AS hour, {r6('avg(us_aqi)', 'us_aqi')}, row_number() OVER (ORDER BY city_slug, date_trunc('hour', observed_at) DESC) AS place FROM obs GROUP BY 1, 2",
)
def l01(spark, d):
    h = I.hourly(spark, d, ["us_aqi"]).withColumnRenamed("ts", "hour")
    return in_order(h.orderBy("city_slug", F.col("hour").desc()))


@query(
    "l02_next_forecasts",
    cte("forecasts", "newest", extra=[TIMELINE_SQL])
    + f"SELECT city_slug, forecast_id, horizon_timestamp, {r6('predicted_us_aqi')} FROM nx WHERE rn <= 168",
)
def l02(spark, d):
    nxt = S.next_forecasts(I.forecasts(spark, d), _cutoff(spark, d))
    return nxt.select("city_slug", "forecast_id", "horizon_timestamp", "predicted_us_aqi")


@query(
    "l03_latest_five",
    cte("obs") + f"SELECT city_slug, observed_at, event_id, {r6('us_aqi')} FROM obs WHERE city_slug = 'nation_3' ORDER BY observed_at DESC, event_id DESC LIMIT 5",
)
def l03(spark, d):
    one = I.observations(spark, d).where("city_slug = 'nation_3'").select("city_slug", "observed_at", "event_id", "us_aqi")
    return top(one, [F.col("observed_at").desc(), F.col("event_id").desc()], 5)


def _newest_runs(spark, d):
    return [F.col("logical_date").desc(), F.col("run_key").desc()]


RUN_ORDER = "ORDER BY logical_date DESC, run_key DESC"


@query("l04_failed_runs", cte("runs") + f"SELECT dag_id, dag_run_id, state, logical_date::TIMESTAMP AS logical_date FROM runs WHERE state = 'failed' {RUN_ORDER} LIMIT 50")
def l04(spark, d):
    r = I.runs(spark, d).where("state = 'failed'")
    return top(r, _newest_runs(spark, d), 50).select("dag_id", "dag_run_id", "state", "logical_date")


@query("l04_recent_runs", cte("runs") + f"SELECT dag_id, dag_run_id, state, logical_date::TIMESTAMP AS logical_date FROM runs {RUN_ORDER} LIMIT 75")
def l04r(spark, d):
    return top(I.runs(spark, d), _newest_runs(spark, d), 75).select("dag_id", "dag_run_id", "state", "logical_date")


MSG_SQL = """CASE WHEN state = 'failed' THEN 'critical' ELSE 'info' END AS severity,
 CASE WHEN state = 'failed' THEN dag_id || ' failed at ' || strftime(logical_date, '%Y-%m-%dT%H:%M:%SZ') ELSE dag_id || ' is currently ' || state END AS text"""


def _messages(r):
    when = F.date_format("logical_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return r.where(F.col("state").isin("failed", "running", "queued")).select(
        "dag_run_id",
        text.run_severity("state").alias("severity"),
        text.run_message(F.col("dag_id"), F.col("state"), when).alias("text"),
    )


@query(
    "l04_newest_messages",
    cte("runs", extra=[f"t AS (SELECT * FROM runs {RUN_ORDER} LIMIT 25)"])
    + f"SELECT dag_run_id, {MSG_SQL} FROM t WHERE state IN ('failed','running','queued')",
)
def l04m(spark, d):
    return _messages(top(I.runs(spark, d), _newest_runs(spark, d), 25))


@query("f24_run_messages", cte("runs") + f"SELECT dag_run_id, {MSG_SQL} FROM runs WHERE state IN ('failed','running','queued')")
def f24(spark, d):
    return _messages(I.runs(spark, d))


BEST_SQL = "row_number() OVER (PARTITION BY {by} ORDER BY rmse, {tie}) AS rn FROM bench WHERE status = 'ok' AND rmse IS NOT NULL"


@query(
    "l05_best_per_city",
    cte("bench", extra=["k AS (SELECT *, " + BEST_SQL.format(by="city", tie="row_id") + ")"])
    + f"SELECT city, row_id, model, {r6('rmse')} FROM k WHERE rn = 1",
)
def l05(spark, d):
    from breezeline.operators.rank import best_by

    ok = I.benchmark_rows(spark, d).where("status = 'ok'")
    return best_by(ok, ["city"], "rmse", [F.col("row_id")]).select("city", "row_id", "model", "rmse")


def _pool(spark, d):
    """One row per (city, phase, model): the mean scores of its finished runs."""
    return (
        E.usable(I.benchmark_rows(spark, d))
        .groupBy("city", "phase", "model")
        .agg(*[F.round(F.avg(c) + 1e-9, 6).alias(c) for c in ("rmse", "mae", "r2", "train_seconds")])
        .withColumn("status", F.lit("ok"))
    )


POOL_SQL = """pool AS (SELECT city, phase, model, round(avg(rmse) + 1e-9, 6) AS rmse, round(avg(mae) + 1e-9, 6) AS mae, round(avg(r2) + 1e-9, 6) AS r2,
 round(avg(train_seconds) + 1e-9, 6) AS train_seconds FROM bench WHERE status = 'ok' GROUP BY 1, 2, 3)"""


@query(
    "l06_best_per_phase",
    cte("bench", extra=[POOL_SQL, "k AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY rmse, city, model) AS rn FROM pool)"])
    + f"SELECT phase, city, model, {r6('rmse')} FROM k WHERE rn = 1",
)
def l06(spark, d):
    return E.best_per_phase(_pool(spark, d)).select("phase", "city", "model", "rmse")


@query("l06_overall_top", cte("bench", extra=[POOL_SQL]) + f"SELECT city, phase, model, {r6('rmse')} FROM pool ORDER BY pool.rmse, city, model LIMIT 5")
def l06t(spark, d):
    return E.overall_top(_pool(spark, d)).select("city", "phase", "model", "rmse")


@query("l06_fastest", cte("bench", extra=[POOL_SQL]) + f"SELECT city, phase, model, {r6('train_seconds')} FROM pool ORDER BY pool.train_seconds, city, model LIMIT 3")
def l06f(spark, d):
    return E.fastest(_pool(spark, d)).select("city", "phase", "model", "train_seconds")


@query(
    "l07_metrics_table",
    cte("bench")
    + f"SELECT row_id, city, status, model, {r6('rmse')}, row_number() OVER (ORDER BY city NULLS LAST, status NULLS LAST, rmse NULLS LAST, model NULLS LAST, row_id) AS place FROM bench",
)
def l07(spark, d):
    b = I.benchmark_rows(spark, d).select("row_id", "city", "status", "model", "rmse")
    return in_order(E.metrics_table(b, ("city", "status", "rmse", "model", "row_id")))


GRID_ORDERS = {"aqi": "coalesce(us_aqi, 0) DESC", "pm2_5": "coalesce(pm2_5, 0) DESC", "name": "city_name"}


def _grid(option):
    def run(spark, d):
        newest = latest(I.observations(spark, d), ["city_slug"], "observed_at", [F.col("event_id").desc()])
        grid = newest.select("city_slug", "city_name", F.col("us_aqi").alias("current_aqi"), "pm2_5")
        return in_order(grid.orderBy(*sort_option(option)))

    return run


for _option, _order in GRID_ORDERS.items():
    query(
        f"l08_city_grid_by_{_option}",
        cte("obs", extra=[LATEST_SQL])
        + f"SELECT city_slug, city_name, {r6('us_aqi', 'current_aqi')}, {r6('pm2_5')}, row_number() OVER (ORDER BY {_order}, city_slug) AS place FROM latest",
    )(_grid(_option))


MODEL_NAMES = {"1-URGENT": "ARIMA", "2-HIGH": "Random_Forest", "3-MEDIUM": "GRU", "4-NOT SPECIFIED": "CNN-LSTM"}
MODEL_CASE = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODEL_NAMES.items()) + " ELSE 'ST-GCN' END"


def _named_models(b):
    out = F.lit("ST-GCN")
    for key, name in MODEL_NAMES.items():
        out = F.when(F.col("model") == key, name).otherwise(out)
    return b.withColumn("model", out)


@query(
    "l09_comparison_table",
    cte("bench", extra=[POOL_SQL, f"nm AS (SELECT *, {MODEL_CASE} AS m FROM pool)"])
    + """SELECT m AS model, CASE m WHEN 'ARIMA' THEN 'Statistical' WHEN 'Random_Forest' THEN 'Classical ML' WHEN 'GRU' THEN 'DL Sequence'
 WHEN 'CNN-LSTM' THEN 'DL Hybrid' ELSE 'Spatio-Temporal' END AS phase_label, round(round(rmse, 2) + 1e-9, 6) AS rmse, round(round(mae, 2) + 1e-9, 6) AS mae, round(round(r2, 3) + 1e-9, 6) AS r2, dense_rank() OVER (ORDER BY round(rmse, 2), m) AS place FROM nm""",
)
def l09(spark, d):
    """Rows that are equal in model and rounded RMSE share a place."""
    table = in_order(E.comparison_table(_named_models(_pool(spark, d))))
    first = table.groupBy("rmse", "model").agg(F.min("place").alias("_first"))
    ranks = in_order(first.orderBy("_first")).select("rmse", "model", "place")
    return table.drop("place").join(ranks, ["rmse", "model"])


# ---- scalar functions ------------------------------------------------------------------


@query(
    "f01_slugs",
    """SELECT DISTINCT p_name || ' (' || p_type || ')' AS name, lower(replace(p_name || ' (' || p_type || ')',' ','_')) AS slug,
 replace(lower(replace(p_name || ' (' || p_type || ')',' ','_')),'_','-') AS alias,
 trim(regexp_replace(lower(p_name || ' (' || p_type || ')'),'[^a-z0-9]+','_','g'),'_') AS warehouse,
 trim(regexp_replace(lower(p_name || ' (' || p_type || ')'),'[^a-z0-9]+','-','g'),'-') AS url,
 trim(regexp_replace(lower(p_name || ' (' || p_type || ')'),'[^a-z0-9]','_','g'),'_') AS station,
 replace(replace(replace(lower(p_name || '+' || p_type),'+','plus'),'-','_'),' ','_') AS safe,
 trim(regexp_replace(lower(p_name || '+' || p_type),'[^a-z0-9]+','_','g'),'_') AS artifact FROM part""",
)
def f01(spark, d):
    """Slug and name variants."""
    p = I.table(spark, d, "part").select(
        F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("name"),
        F.concat("p_name", F.lit("+"), "p_type").alias("model"),
    )
    return p.distinct().select(
        "name",
        text.city_slug("name").alias("slug"),
        text.hyphen_alias(text.city_slug("name")).alias("alias"),
        text.warehouse_slug("name").alias("warehouse"),
        text.url_slug("name").alias("url"),
        text.station_slug("name").alias("station"),
        text.safe_model_name("model").alias("safe"),
        text.artifact_model_name("model").alias("artifact"),
    )


@query(
    "f05_identifiers",
    cte("obs")
    + """SELECT event_id, 'aq_ingest-' || strftime(observed_at, '%Y%m%dT%H%M%S%fZ') AS run_id,
 city_slug || '-xgplus_boost-' || strftime(observed_at, '%Y%m%dT%H%M%SZ') || '-' || lpad(CAST(hour(observed_at) AS VARCHAR), 3, '0') AS fid,
 city_slug || '_' || strftime(observed_at, '%Y%m%d%H%M%S') || '_h' || lpad(CAST(hour(observed_at) AS VARCHAR), 2, '0') AS bid,
 'arc/' || city_slug || '/' || strftime(observed_at, '%Y/%m/%d') || '/r1.csv.gz' AS path FROM obs""",
)
def f05(spark, d):
    """Run ids, forecast ids, archive paths."""
    at, hour = F.col("observed_at"), F.hour("observed_at")
    return I.observations(spark, d).select(
        "event_id",
        text.run_id(F.lit("aq ingest"), at).alias("run_id"),
        text.benchmark_forecast_id(F.col("city_slug"), F.lit("XG+ Boost"), at, hour).alias("fid"),
        text.baseline_forecast_id(F.col("city_slug"), at, hour).alias("bid"),
        text.archive_path("arc", F.col("city_slug"), at, F.lit("r1")).alias("path"),
    )


CAT_GE = "CASE WHEN {x} >= 300 THEN 'hazardous' WHEN {x} >= 200 THEN 'very_unhealthy' WHEN {x} >= 150 THEN 'unhealthy' WHEN {x} >= 100 THEN 'unhealthy_sg' WHEN {x} >= 50 THEN 'moderate' ELSE 'good' END"
CAT_IN = "CASE WHEN {x} IS NULL THEN NULL WHEN {x} BETWEEN 0 AND 50 THEN 'good' WHEN {x} BETWEEN 51 AND 100 THEN 'moderate' WHEN {x} BETWEEN 101 AND 150 THEN 'unhealthy_sg' WHEN {x} BETWEEN 151 AND 200 THEN 'unhealthy' WHEN {x} BETWEEN 201 AND 300 THEN 'very_unhealthy' ELSE 'hazardous' END"


def advice_sql(category: str, audience: int) -> str:
    quoted = {k: v[audience].replace("'", "''") for k, v in bands.HEALTH_ADVISORIES.items()}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items())
    return f"CASE {category} {cases} ELSE '{quoted['moderate']}' END"


@query(
    "f08_bands",
    cte("obs")
    + f"""SELECT event_id, {CAT_IN.format(x='pm2_5')} AS inclusive, {CAT_GE.format(x='pm2_5')} AS threshold,
 CASE WHEN pm2_5 >= 200 THEN 'very_unhealthy' WHEN pm2_5 >= 150 THEN 'unhealthy' WHEN pm2_5 >= 100 THEN 'moderate' ELSE 'good_to_satisfactory' END AS risk,
 CASE {CAT_GE.format(x='pm2_5')} WHEN 'good' THEN '#10b981' WHEN 'moderate' THEN '#f59e0b' WHEN 'unhealthy_sg' THEN '#f97316' WHEN 'unhealthy' THEN '#ef4444' WHEN 'very_unhealthy' THEN '#9333ea' ELSE '#7c2d12' END AS color,
 CASE {CAT_GE.format(x='pm2_5')} WHEN 'good' THEN 'Maintain normal activities.' WHEN 'moderate' THEN 'Consider limiting prolonged outdoor exertion; keep windows closed during peak hours.'
  WHEN 'unhealthy_sg' THEN 'Reduce prolonged outdoor exertion. Consider moving exertion indoors or rescheduling.' WHEN 'unhealthy' THEN 'Avoid outdoor exertion; stay indoors as much as possible.'
  WHEN 'very_unhealthy' THEN 'Health warning of emergency conditions: the entire population is more likely to be affected.'
  ELSE 'Everyone should avoid all outdoor exertion; remain indoors and keep activity levels low.' END AS advice,
 {advice_sql(CAT_GE.format(x='pm2_5'), 0)} AS advice_general, {advice_sql(CAT_GE.format(x='pm2_5'), 2)} AS advice_children FROM obs""",
)
def f08(spark, d):
    """Bands, colours, advice, risk."""
    return I.observations(spark, d).select(
        "event_id",
        bands.category_inclusive("pm2_5").alias("inclusive"),
        bands.category("pm2_5").alias("threshold"),
        bands.risk_band("pm2_5").alias("risk"),
        bands.category_color(bands.category("pm2_5")).alias("color"),
        bands.advisory(bands.category("pm2_5"), "sensitive_groups").alias("advice"),
        bands.advisory(bands.category("pm2_5")).alias("advice_general"),
        bands.advisory(bands.category("pm2_5"), "children").alias("advice_children"),
    )


@query(
    "f12_trend_labels",
    cte("hourly", extra=["l AS (SELECT city_slug, ts, us_aqi AS c, lag(us_aqi) OVER (PARTITION BY city_slug ORDER BY ts) AS p FROM hourly)"])
    + """SELECT city_slug, ts, CASE WHEN c > p + 5 THEN 'up' WHEN c < p - 5 THEN 'down' ELSE 'stable' END AS label,
 CASE WHEN p IS NULL OR p = 0 THEN NULL WHEN c > p + 5 THEN 'Worsening' WHEN c < p - 5 THEN 'Improving' ELSE 'Stable' END AS change FROM l""",
)
def f12(spark, d):
    from breezeline.operators.blocks import framed

    lagged = framed(I.hourly(spark, d, ["us_aqi"]), HOURLY, 1, 0, lambda w: [F.lag("us_aqi").over(w).alias("p")])
    return lagged.select(
        "city_slug",
        "ts",
        bands.against_band("us_aqi", "p", 5.0).alias("label"),
        bands.change_label("us_aqi", "p").alias("change"),
    )


@query(
    "f13_confidence_and_bounds",
    cte("bench", extra=["c AS (SELECT row_id, rmse, CASE WHEN rmse IS NULL THEN 0.0 ELSE greatest(0.05, least(0.99, 1 / (1 + rmse / 100.0))) END AS conf FROM bench)",
                        "u AS (SELECT *, CASE WHEN conf <> 0 THEN (1 - conf) * 50 ELSE 20 END AS unc FROM c)"])
    + f"SELECT row_id, {r6('conf', 'confidence')}, {r6('1 / (1 + rmse / 100.0)', 'raw')}, {r6('unc', 'uncertainty')}, {r6('CASE WHEN rmse <> 0 THEN greatest(0, rmse - unc) END', 'lower')}, {r6('CASE WHEN rmse <> 0 THEN rmse + unc END', 'upper')} FROM u",
)
def f13(spark, d):
    """Confidence, uncertainty, interval."""
    b = I.benchmark_rows(spark, d).withColumn("confidence", bands.confidence_from_rmse("rmse"))
    b = b.withColumn("uncertainty", bands.uncertainty("confidence"))
    low, high = bands.interval_bounds("rmse", "uncertainty")
    return b.select(
        "row_id", "confidence", bands.raw_confidence("rmse").alias("raw"), "uncertainty", low.alias("lower"), high.alias("upper")
    )


@query(
    "f15_number_helpers",
    cte("stations")
    + f"""SELECT l_orderkey, l_linenumber, {r6('pm10 / nullif(coalesce(no2,0),0)', 'ratio')}, {r6('least(greatest(pm10 - 50000, 0), 500)', 'clipped')},
 {r6('coalesce(no2, 0)', 'zeroed')}, {r6('floor(pm2_5 / 4 + 0.5)', 'up')}, {r6('round_even(pm2_5 / 4, 0)', 'even')}, {r6('round(pm2_5 / 4, 0)', 'away')} FROM stations""",
)
def f15(spark, d):
    """Ratios, clips, zero fill, rounding modes."""
    quarter = F.col("pm2_5") / 4
    return I.stations(spark, d).select(
        "l_orderkey",
        "l_linenumber",
        numeric.safe_ratio("pm10", F.coalesce("no2", F.lit(0.0))).alias("ratio"),
        numeric.clip(F.col("pm10") - 50000, 0.0, 500.0).alias("clipped"),
        numeric.zero_if_missing("no2").alias("zeroed"),
        numeric.round_half_up_floor(quarter).alias("up"),
        numeric.round_half_even(quarter).alias("even"),
        numeric.round_half_away(quarter).alias("away"),
    )


@query(
    "f18_sources_and_titles",
    """SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'hosted_latest' WHEN contains(p_name, 'g') THEN 'hosted_misc' ELSE 'local_other' END AS kind,
 CASE WHEN contains(p_name, 'g') THEN 'hosted' ELSE 'local_pc' END AS env,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
 'h=' || p_size || ' layers=' || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '-' END || ' heads=-' AS config FROM part""",
)
def f18(spark, d):
    """Source kind and environment, title case, configuration text."""
    path = F.concat(F.lit("C:\\Runs\\"), F.upper("p_name"))
    kind = text.source_kind(path, {"widget": "hosted_latest", "g": "hosted_misc"}, "local_other")
    return I.table(spark, d, "part").select(
        "p_partkey",
        kind.alias("kind"),
        text.source_env(kind, "hosted", "hosted", "local_pc").alias("env"),
        text.title_case("p_name").alias("title"),
        text.config_fingerprint(
            {
                "h": [F.col("p_size")],
                "layers": [F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(None).cast("int")],
                "heads": [F.lit(None).cast("int")],
            }
        ).alias("config"),
    )


@query(
    "f20_json_round_trip",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events",
)
def f20(spark, d):
    e = I.table(spark, d, "events")
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind")))
    back = F.from_json(doc, "k long, kind string")
    return e.select("event_id", back["k"].alias("k"), back["kind"].alias("kind"))


@query(
    "f21_time_helpers",
    """SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('month', ts)::TIMESTAMP AS month,
 ts + INTERVAL 3 HOURS AS later, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""",
)
def f21(spark, d):
    ts = F.col("ts")
    return I.table(spark, d, "events").select(
        "event_id",
        F.date_trunc("hour", ts).alias("hour"),
        F.date_trunc("day", ts).alias("day"),
        F.date_trunc("month", ts).alias("month"),
        (ts + F.make_dt_interval(F.lit(0), F.lit(3))).alias("later"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
    )


@query(
    "f23_model_labels",
    cte("bench", extra=[f"m AS (SELECT row_id, {MODEL_CASE} AS model FROM bench)"])
    + """SELECT row_id, model, CASE model WHEN 'ARIMA' THEN 'Statistical' WHEN 'Random_Forest' THEN 'Classical ML' WHEN 'GRU' THEN 'DL Sequence'
 WHEN 'CNN-LSTM' THEN 'DL Hybrid' ELSE 'Spatio-Temporal' END AS phase_label,
 CASE model WHEN 'Random_Forest' THEN 1 WHEN 'GRU' THEN 2 WHEN 'CNN-LSTM' THEN 2 END::BIGINT AS tier,
 CASE model WHEN 'Random_Forest' THEN 'Tree Ensemble' WHEN 'GRU' THEN 'DL Sequence' WHEN 'CNN-LSTM' THEN 'DL Hybrid' END AS family,
 CASE model WHEN 'Random_Forest' THEN 'Best' WHEN 'GRU' THEN 'DL Best' WHEN 'CNN-LSTM' THEN 'DL Best' END AS category FROM m""",
)
def f23(spark, d):
    key = text.safe_model_name("model")
    return _named_models(I.benchmark_rows(spark, d)).select(
        "row_id",
        "model",
        text.model_phase("model").alias("phase_label"),
        text.model_attribute(key, "tier").alias("tier"),
        text.model_attribute(key, "family").alias("family"),
        text.model_attribute(key, "category").alias("category"),
    )


@query(
    "serve_city_report",
    cte("hourly", "newest", extra=[
        LATEST_SQL,
        "e AS (SELECT city_slug, count(*) AS n, arg_max(us_aqi, ts) AS l, arg_min(us_aqi, ts) AS f FROM hourly, newest WHERE ts >= as_of - INTERVAL 24 HOURS GROUP BY 1)",
        "c AS (SELECT *, l - f AS ch, CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0 END AS pct FROM e)",
    ])
    + f"""SELECT l.city_slug, l.observed_at, {r6('l.us_aqi', 'us_aqi')}, {CAT_IN.format(x='l.us_aqi')} AS category,
 CASE WHEN n IS NULL OR n < 2 OR abs(pct) < 2 THEN 'stable' WHEN ch > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
 {r6('CASE WHEN n IS NULL OR n < 2 THEN 0 ELSE floor(ch / n * 100.0 + 0.5) / 100.0 END', 'slope')},
 {r6('CASE WHEN n IS NULL OR n < 2 THEN 0 ELSE floor(pct * 10.0 + 0.5) / 10.0 END', 'change_percent')},
 {advice_sql(CAT_IN.format(x='l.us_aqi'), 0)} AS advice, {advice_sql(CAT_IN.format(x='l.us_aqi'), 1)} AS advice_sensitive, {advice_sql(CAT_IN.format(x='l.us_aqi'), 2)} AS advice_children
 FROM latest l LEFT JOIN c USING (city_slug)""",
)
def serve_city_report(spark, d):
    o = I.observations(spark, d)
    newest = latest(o, ["city_slug"], "observed_at", [F.col("event_id").desc()])
    report = S.city_report(newest, _hour_avg(spark, d), I.as_of(o))
    return report.select(
        "city_slug", "observed_at", "us_aqi", "category", "direction", "slope", "change_percent",
        "advice", "advice_sensitive", "advice_children",
    )
