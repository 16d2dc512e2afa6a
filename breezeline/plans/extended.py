"""Distribution scores, ensembles, neighbours, the year before, file order, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeline.operators import compare as C
from breezeline.operators import probabilistic as D
from breezeline.operators.spatial import neighbour_residuals
from breezeline.plans import inputs as I
from breezeline.plans.inputs import HOURLY, cte, query, r6, rounded
from breezeline.plans.shaping import PAIR_SQL, pairs
from breezeline.session import materialise, scratch_path

KEY = ["city_slug"]


@query(
    "m20_crps",
    cte("forecasts", extra=[
        PAIR_SQL,
        "a AS (SELECT city_slug, horizon_timestamp, avg(abs(predicted_us_aqi - actual)) AS away FROM pair GROUP BY 1, 2)",
        "b AS (SELECT x.city_slug, x.horizon_timestamp, avg(abs(x.predicted_us_aqi - y.predicted_us_aqi)) AS apart FROM pair x JOIN pair y USING (city_slug, horizon_timestamp) GROUP BY 1, 2)"])
    + f"SELECT city_slug, {r6('avg(away - apart / 2)', 'crps')}, count(*) AS n FROM a JOIN b USING (city_slug, horizon_timestamp) GROUP BY 1",
)
def m20(spark, d):
    """All forecasts of an hour are its ensemble; the SQL goes over all pairs of members."""
    hours = pairs(spark, d).groupBy("city_slug", "horizon_timestamp").agg(
        F.collect_list("predicted_us_aqi").alias("members"), F.first("actual").alias("actual")
    )
    return D.crps_per_series(hours, KEY, "members", "actual")


LEVELS = {"q10": (0.1, -20), "q50": (0.5, 0), "q90": (0.9, 20)}


@query(
    "m21_quantile_crps",
    cte("forecasts", extra=[PAIR_SQL])
    + "SELECT city_slug, " + r6("avg(" + " + ".join(
        f"2 * {w} * greatest({t} * (actual - predicted_us_aqi - ({o})), ({t} - 1) * (actual - predicted_us_aqi - ({o})))"
        for (t, o), w in zip(LEVELS.values(), (0.3, 0.4, 0.3))) + ")", "crps") + " FROM pair GROUP BY 1",
)
def m21(spark, d):
    wide = pairs(spark, d).withColumns({name: F.col("predicted_us_aqi") + off for name, (_, off) in LEVELS.items()})
    score = D.quantile_crps(list(LEVELS), [level for level, _ in LEVELS.values()], "actual")
    return wide.groupBy(*KEY).agg(F.avg(score).alias("crps"))


MEMBERS = {"persistence": "Persistence", "trend": "Persistence+Trend"}


@query(
    "m22_ensemble",
    cte("forecasts", extra=[
        PAIR_SQL,
        "w AS (SELECT city_slug, horizon_timestamp, horizon_hours, any_value(actual) AS y, max(CASE WHEN model_type = 'Persistence' THEN predicted_us_aqi END) AS p, max(CASE WHEN model_type <> 'Persistence' THEN predicted_us_aqi END) AS t FROM pair GROUP BY 1, 2, 3)",
        "m AS (SELECT city_slug, avg(pow(p - y, 2)) AS a, avg(pow(t - y, 2)) AS b, avg((p - y) * (t - y)) AS c FROM w GROUP BY 1)",
        "k AS (SELECT city_slug, CASE WHEN a + b - 2 * c = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (b - c) / (a + b - 2 * c))) END AS share FROM m)"])
    + f"""SELECT city_slug, {r6('any_value(share)', 'persistence')}, {r6('1 - any_value(share)', 'trend')},
 {r6('sqrt(avg(pow(share * p + (1 - share) * t - y, 2)))', 'rmse')}, count(*) AS n FROM w JOIN k USING (city_slug) GROUP BY 1""",
)
def m22(spark, d):
    """Two members; for two the least-squares weights have a closed form, which the SQL uses."""
    member = {name: F.max(F.when(F.col("model_type") == kind, F.col("predicted_us_aqi"))).alias(name) for name, kind in MEMBERS.items()}
    wide = pairs(spark, d).groupBy("city_slug", "horizon_timestamp", "horizon_hours").agg(*member.values(), F.first("actual").alias("actual"))
    wide = materialise(wide)
    weights = materialise(D.ensemble_weights(wide, KEY, list(MEMBERS), "actual"))
    both = D.combined(wide, weights, KEY, list(MEMBERS))
    scored = both.groupBy(*KEY).agg(
        F.sqrt(F.avg(F.pow(F.col("combined") - F.col("actual"), 2))).alias("rmse"), F.count(F.lit(1)).alias("n")
    )
    return scored.join(weights, "city_slug").select("city_slug", *[F.element_at("weights", F.lit(m)).alias(m) for m in MEMBERS], "rmse", "n")


RADIUS = 4000.0


@query(
    "a31_neighbour_outliers",
    cte("hourly", extra=[
        "st AS (SELECT city_slug, radians((city_key * 37) % 120 - 60.0) AS a, radians((city_key * 53) % 360 - 180.0) AS b FROM cities)",
        "xyz AS (SELECT city_slug, cos(a) * cos(b) AS x, cos(a) * sin(b) AS y, sin(a) AS z FROM st)",
        f"""near AS (SELECT l.city_slug, r.city_slug AS other FROM xyz l JOIN xyz r ON l.city_slug <> r.city_slug
 WHERE 2 * 6371.0 * asin(least(1.0, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2) + pow(l.z - r.z, 2)) / 2)) <= {RADIUS})""",
        "md AS (SELECT n.city_slug, h.ts, median(h.us_aqi) AS neighbour_median FROM near n JOIN hourly h ON h.city_slug = n.other GROUP BY 1, 2)",
        "ab AS (SELECT h.city_slug, h.ts, h.us_aqi, md.neighbour_median, h.us_aqi - md.neighbour_median AS above FROM hourly h LEFT JOIN md USING (city_slug, ts) WHERE h.us_aqi IS NOT NULL)",
        "rs AS (SELECT *, above - avg(above) OVER (PARTITION BY city_slug ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS residual FROM ab)",
        "mi AS (SELECT city_slug, median(residual) AS mid FROM rs GROUP BY 1)",
        "sp AS (SELECT city_slug, any_value(mid) AS mid, 1.4826 * median(abs(residual - mid)) AS scale FROM rs JOIN mi USING (city_slug) GROUP BY 1)",
        "zz AS (SELECT rs.*, scale, abs((residual - mid) / nullif(scale, 0)) / sqrt(2.0) AS x FROM rs JOIN sp USING (city_slug))",
        "tl AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM zz)",
        """pt AS (SELECT *, (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x) AS tail FROM tl)"""])
    + f"SELECT city_slug, ts, {rounded(('us_aqi', 'neighbour_median', 'residual', 'scale', 'tail'))}, tail < 0.05 AS outlier FROM pt",
)
def a31(spark, d):
    """Hourly readings against the cities within 4,000 km; the places follow from the nation keys."""
    places = I.cities(spark, d).select(
        "city_slug", ((F.col("city_key") * 37) % 120 - 60.0).alias("lat"), ((F.col("city_key") * 53) % 360 - 180.0).alias("lon")
    )
    return neighbour_residuals(I.hourly(spark, d, ["us_aqi"]), HOURLY, places, "us_aqi", "lat", "lon", RADIUS)


LIMITS = {"pm2_5": 60.0, "pm10": 100.0, "nitrogen_dioxide": 80.0, "sulphur_dioxide": 80.0, "ozone": 100.0}


@query(
    "a32_dominant_pollutant",
    cte("hourly", extra=[
        "s AS (" + " UNION ALL ".join(f"SELECT city_slug, ts, '{m}' AS metric, {m} / {x} AS exceedance FROM hourly WHERE {m} IS NOT NULL" for m, x in LIMITS.items()) + ")",
        "k AS (SELECT *, row_number() OVER (PARTITION BY city_slug, ts ORDER BY exceedance DESC, metric) AS rn FROM s)"])
    + f"SELECT h.city_slug, h.ts, k.metric, {r6('k.exceedance', 'exceedance')} FROM hourly h LEFT JOIN k ON k.city_slug = h.city_slug AND k.ts = h.ts AND rn = 1",
)
def a32(spark, d):
    hours = I.hourly(spark, d, list(LIMITS)).withColumn("most", C.dominant_metric(LIMITS))
    return hours.select("city_slug", "ts", "most.metric", "most.exceedance")


@query(
    "w32_year_over_year",
    cte("stations", extra=[
        "dy AS (SELECT l_linenumber AS line, ts, avg(pm10) AS v FROM stations GROUP BY 1, 2)",
        """mt AS (SELECT a.line, a.ts, a.v, b.ts AS before_ts, b.v AS before, row_number() OVER (PARTITION BY a.line, a.ts
 ORDER BY abs(date_diff('second', b.ts, a.ts - INTERVAL 1 YEAR)), b.ts) AS rn FROM dy a LEFT JOIN dy b ON a.line = b.line
 AND b.ts BETWEEN a.ts - INTERVAL 1 YEAR - INTERVAL 2 DAY AND a.ts - INTERVAL 1 YEAR + INTERVAL 2 DAY)"""])
    + f"SELECT line, ts, {r6('v')}, before_ts, {r6('before')}, {r6('v - before', 'change')}, {r6('100 * (v - before) / before', 'change_pct')} FROM mt WHERE rn = 1",
)
def w32(spark, d):
    """Daily means per line number; a day without its like a year before meets the nearest within two days."""
    days = I.stations(spark, d).groupBy(F.col("l_linenumber").alias("line"), "ts").agg(F.avg("pm10").alias("v"))
    return C.year_over_year(days, ["line"], "ts", "v", tolerance_seconds=2 * 86_400)


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


@query(
    "s21_file_order",
    """WITH p AS (SELECT event_type, ts, row_number() OVER w AS row, max(event_id) OVER () AS top,
 lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY
  CASE WHEN event_type <> 'view' AND event_id % 997 = 5 THEN event_id + 40 ELSE event_id END, event_id)),
b AS (SELECT event_type, min(row) AS row FROM p WHERE ts < before GROUP BY 1)
SELECT p.event_type, count(*) AS rows, any_value(b.row) IS NULL AS ordered, any_value(b.row) AS row,
 max(p.ts) FILTER (p.row = b.row) AS time, max(p.before) FILTER (p.row = b.row) AS time_before
 FROM p LEFT JOIN b USING (event_type) GROUP BY 1""",
)
def s21(spark, d):
    """A file per event type, some rows moved; read in small splits and checked across their edges."""
    path = scratch_path(spark, "ordered")
    e = I.table(spark, d, "events")
    moved = (F.col("event_type") != "view") & (F.col("event_id") % 997 == 5)
    place = F.when(moved, F.col("event_id") + 40).otherwise(F.col("event_id"))
    rows = e.select("event_type", "event_id", "ts", place.alias("place"))
    rows.repartition("event_type").sortWithinPartitions("event_type", "place", "event_id").write.partitionBy("event_type").option(
        "timestampFormat", STAMP
    ).csv(path)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = spark.read.schema("event_id long, ts timestamp, place long").option("timestampFormat", STAMP).csv(path)
        told = materialise(C.order_check(read, "ts"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    kind = F.regexp_extract("file", "event_type=([^/]+)/", 1)
    return told.select(kind.alias("event_type"), "rows", "ordered", "row", "time", "time_before")
