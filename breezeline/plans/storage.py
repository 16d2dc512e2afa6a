"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeline.operators import aggregate as A
from breezeline.operators import serve as S
from breezeline.operators.fill import impute_for_training
from breezeline.operators.forecast import forecast_rows
from breezeline.operators.rank import latest
from breezeline.plans import inputs as I
from breezeline.plans.inputs import FILLED, HOURLY, cte, query, r6, rounded
from breezeline.plans.ordered import BASE_SQL, baseline
from breezeline.schema import BENCHMARK_SUMMARY, METRICS, SNAPSHOT
from breezeline.session import scratch_path
from breezeline.sources import clean as C
from breezeline.sources import payload as P
from breezeline.sources import tables as T
from breezeline.sources.ingest import Warehouse, bootstrap_csv, incremental_cycle, incremental_rows
from breezeline.streaming import jobs as J
from breezeline.streaming import matching as M




def now(text: str = "2024-02-01 00:00:00"):
    """The fixed processing time of these queries."""
    return F.lit(text).cast("timestamp")


PLAIN = ", ".join(rounded([m]) for m in METRICS)


def payload_docs(spark, d):
    h = I.hourly(spark, d).withColumnRenamed("city_slug", "city")
    return P.encode_day(h, ["city"], "ts")


@query("s01_decoded_payloads", cte("hourly") + f"SELECT city_slug AS city, ts AS timestamp, {PLAIN} FROM hourly")
def s01(spark, d):
    return P.decode_payloads(payload_docs(spark, d))[0]


def broken_docs(spark, d):
    """Every city's documents broken in a way that depends on the city."""
    doc = payload_docs(spark, d)
    n = F.split("city", "_")[1].cast("int")
    empty = F.lit('{"hourly": {"time": []}}')
    cut = F.regexp_replace("body", r'"us_aqi":\[', '"us_aqi":[1.0,')
    bad = F.regexp_replace("body", r'"time":\["[^"]*"', '"time":["never"')
    return doc.withColumn("body", F.when(n < 5, empty).when(n < 10, cut).when(n < 15, bad).otherwise(F.col("body")))


@query(
    "s01_quarantined_payloads",
    cte("hourly", extra=["x AS (SELECT DISTINCT city_slug AS city, CAST(split_part(city_slug,'_',2) AS INT) AS n, CAST(ts AS DATE) AS day FROM hourly)"])
    + "SELECT city, CASE WHEN n < 5 THEN 'no hourly rows' WHEN n < 10 THEN 'length of us_aqi differs from time' ELSE 'unreadable time' END AS problem, count(*) AS documents FROM x WHERE n < 15 GROUP BY 1, 2",
)
def s01q(spark, d):
    bad = P.decode_payloads(broken_docs(spark, d))[1]
    return bad.groupBy("city", "problem").agg(F.count(F.lit(1)).alias("documents"))


@query("s02_csv_round_trip", cte("hourly") + f"SELECT city_slug, ts, {rounded(FILLED)} FROM hourly")
def s02(spark, d):
    path = scratch_path(spark, "csv")
    h = I.hourly(spark, d, FILLED)
    h.write.option("header", True).csv(path)
    return T.read_csv(spark, path, h.schema, ["city_slug", "ts"])


KINDS = {"hosted_latest": "hosted_latest", "hosted_misc": "hosted_misc"}


@query(
    "s04_discovered_summaries",
    cte("bench")
    + f"""SELECT CASE WHEN phase = 'MACHINERY' THEN 'hosted_latest' WHEN phase = 'FURNITURE' THEN 'hosted_misc' ELSE 'local_other' END AS source_kind,
 CASE WHEN phase IN ('MACHINERY','FURNITURE') THEN 'hosted' ELSE 'local' END AS source_env, count(*) AS row_count,
 count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM bench GROUP BY 1, 2""",
)
def s04(spark, d):
    root = scratch_path(spark, "summaries")
    b = I.benchmark_rows(spark, d)
    cols = [F.col(f.name) if f.name in b.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BENCHMARK_SUMMARY]
    place = (
        F.when(F.col("phase") == "MACHINERY", "hosted_latest")
        .when(F.col("phase") == "FURNITURE", "hosted_misc")
        .otherwise("elsewhere")
    )
    rows = b.select(*cols, place.alias("place"))
    rows.write.partitionBy("place").option("header", True).csv(root)
    found = T.discover_summaries(spark, root, KINDS, "local_other", "*.csv")
    return A.status_inventory(found, ["source_kind", "source_env"])


@query(
    "s05_result_documents",
    f"""SELECT p_name AS model, p_type AS city, '2026-01-01 00:00:00' AS timestamp, {r6('p_retailprice', 'rmse')},
 'h=' || p_size || ' layers=- heads=- lr=0.001 drop=- epochs=-' AS config FROM part""",
)
def s05(spark, d):
    path = scratch_path(spark, "results")
    docs = I.table(spark, d, "part").select(
        F.col("p_type").alias("city"),
        F.col("p_name").alias("model"),
        F.lit("2026-01-01T00:00:00.123").alias("timestamp"),
        F.struct(F.col("p_retailprice").cast("string").alias("rmse"), F.lit("n/a").alias("mae")).alias("metrics"),
        F.struct(F.col("p_size").cast("string").alias("model_dim"), F.lit("0.001").alias("lr")).alias("config"),
    )
    docs.write.json(path)
    flat = P.flatten_results(spark.read.schema(P.RESULT_DOCUMENT).json(path))
    return flat.select("model", "city", "timestamp", "rmse", "config")


@query(
    "s06_scan_with_predicates",
    f"SELECT l_suppkey, l_shipdate::TIMESTAMP AS l_shipdate, {r6('l_quantity')} FROM lineitem WHERE l_returnflag IN ('A','R') AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'",
)
def s06(spark, d):
    from datetime import datetime

    return T.scan(
        spark, f"{d}/lineitem.parquet", "l_returnflag", ["A", "R"], "l_shipdate",
        datetime(1998, 1, 1), datetime(1999, 1, 1), ["l_suppkey", "l_shipdate", "l_quantity"],
    )


@query(
    "s07_history_guard",
    cte("obs", extra=["c AS (SELECT user_id, count(*) AS k FROM obs GROUP BY 1)"])
    + "SELECT o.user_id, o.event_id FROM obs o JOIN c USING (user_id) WHERE k >= 67",
)
def s07(spark, d):
    return C.split_by_history(I.observations(spark, d), ["user_id"], 67)[0].select("user_id", "event_id")


def fact_rows(spark, d, run: str):
    """Hourly means in the fact-table layout."""
    return I.hourly(spark, d).select(
        "city_slug",
        F.upper("city_slug").alias("city_name"),
        F.col("ts").alias("observed_at"),
        *METRICS,
        F.lit("feed").alias("source"),
        now().alias("ingested_at"),
        F.lit(run).alias("run_id"),
    )


UPSERTED_SQL = """a AS (SELECT city_slug, ts AS observed_at, us_aqi, 'r1' AS run_id FROM hourly WHERE us_aqi < 80),
b AS (SELECT city_slug, ts AS observed_at, us_aqi + 1 AS us_aqi, 'r2' AS run_id FROM hourly WHERE us_aqi > 40),
m AS (SELECT coalesce(b.city_slug, a.city_slug) AS city_slug, coalesce(b.observed_at, a.observed_at) AS observed_at,
 coalesce(b.us_aqi, a.us_aqi) AS us_aqi, coalesce(b.run_id, a.run_id) AS run_id,
 CASE WHEN a.run_id IS NULL THEN TIMESTAMP '2024-02-02 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS created_at,
 CASE WHEN b.run_id IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-02-02 00:00:00' END AS updated_at
 FROM a FULL JOIN b ON a.city_slug = b.city_slug AND a.observed_at = b.observed_at)"""


@query(
    "s08_upserted_observations",
    cte("hourly", extra=[UPSERTED_SQL]) + f"SELECT city_slug, observed_at, run_id, created_at, updated_at, {r6('us_aqi')} FROM m",
)
def s08(spark, d):
    path = scratch_path(spark, "observations")
    later = now("2024-02-02 00:00:00")
    part = F.to_date("observed_at")
    one = fact_rows(spark, d, "r1").where("us_aqi < 80").withColumn("observed_date", part)
    two = (
        fact_rows(spark, d, "r2")
        .where("us_aqi > 40")
        .withColumn("us_aqi", F.col("us_aqi") + 1)
        .withColumn("ingested_at", later)
        .withColumn("observed_date", part)
    )
    key = ["city_slug", "observed_at", "source"]
    T.upsert_table(spark, path, one, key, ["ingested_at", "run_id"], ["observed_date"], now())
    T.upsert_table(spark, path, two, key, ["ingested_at", "run_id"], ["observed_date"], later)
    return spark.read.parquet(path).select("city_slug", "observed_at", "run_id", "created_at", "updated_at", "us_aqi")


@query("s09_seeded_cities", cte("cities") + "SELECT city_slug, city_name, country, true AS active FROM cities")
def s09(spark, d):
    path = scratch_path(spark, "cities")
    cities = I.cities(spark, d).drop("city_key")
    T.seed_cities(spark, path, cities, now())
    T.seed_cities(spark, path, cities, now())
    return spark.read.parquet(path).select("city_slug", "city_name", "country", "active")


@query(
    "s10_upserted_watermarks",
    cte("obs") + "SELECT city_slug, max(observed_at) AS last_observed_at, 6::BIGINT AS overlap_hours FROM obs GROUP BY 1",
)
def s10(spark, d):
    path = scratch_path(spark, "watermarks")
    o = I.observations(spark, d)
    old = T.new_watermarks(o.where("us_aqi > 60"), "city_slug", "observed_at", "feed")
    new = T.new_watermarks(o, "city_slug", "observed_at", "feed")
    later = now() + F.expr("INTERVAL 1 HOUR")
    T.write_watermarks(spark, path, old, now())
    T.write_watermarks(spark, path, new, later)
    T.write_watermarks(spark, path, old, later)  # a late file does not move them back
    return spark.read.parquet(path).select("city_slug", "last_observed_at", "overlap_hours")


@query(
    "s11_run_ledger",
    cte("runs")
    + """SELECT 'run-' || strftime(logical_date, '%Y%m') AS run_id, count(*) AS cities_total, count(*) FILTER (state = 'failed') AS cities_failed,
 CASE WHEN count(*) FILTER (state = 'failed') > 0 THEN 'partial_failure' ELSE 'success' END AS status,
 count(*) FILTER (state = 'failed') AS errors FROM runs GROUP BY 1""",
)
def s11(spark, d):
    """Roll-up row per run next to one detail row per series, details as JSON."""
    failed = F.col("state") == "failed"
    details = I.runs(spark, d).select(
        F.concat(F.lit("run-"), F.date_format("logical_date", "yyyyMM")).alias("run_id"),
        F.concat_ws("/", "dag_id", "dag_run_id").alias("city_slug"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.floor("rows_fetched").alias("rows_fetched"),
        F.floor("rows_fetched").alias("rows_upserted"),
        F.when(failed, "timeout").alias("error"),
    )
    path = scratch_path(spark, "ledger")
    ledger = A.run_rollup(details)
    T.write_run_rows(spark, f"{path}/runs", ledger, now())
    notes = details.withColumn("details", F.to_json(F.struct("city_slug", "status", "error")))
    T.write_run_rows(spark, f"{path}/details", notes, now())
    errors = (
        spark.read.parquet(f"{path}/details")
        .groupBy("run_id")
        .agg(F.count_if(F.get_json_object("details", "$.error") == "timeout").alias("errors"))
    )
    runs = spark.read.parquet(f"{path}/runs").select("run_id", "cities_total", "cities_failed", "status")
    return runs.join(errors, "run_id")


@query(
    "s12_loaded_forecasts",
    cte("forecasts")
    + f"SELECT forecast_id, city_slug, city_name, forecast_timestamp, horizon_hours, {r6('predicted_us_aqi + 1', 'predicted_us_aqi')} FROM forecasts WHERE predicted_us_aqi <= 100",
)
def s12(spark, d):
    """Loaded twice, the second time with new predictions and another name; rows
    without a prediction are set aside."""
    path = scratch_path(spark, "forecasts")
    f = I.forecasts(spark, d)
    missing = F.when(F.col("predicted_us_aqi") <= 100, F.col("predicted_us_aqi"))
    T.upsert_forecasts(spark, path, f.withColumn("predicted_us_aqi", missing), now())
    # a third of the ids comes back with an issue time on the other side of midnight
    moved = F.when(F.pmod(F.col("horizon_hours"), F.lit(3)) == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    again = f.withColumns({
        "predicted_us_aqi": missing + 1,
        "city_name": F.lit("renamed"),
        "forecast_timestamp": F.col("forecast_timestamp") + moved,
    })
    T.upsert_forecasts(spark, path, again, now())
    return spark.read.parquet(path).select(
        "forecast_id", "city_slug", "city_name", "forecast_timestamp", "horizon_hours", "predicted_us_aqi"
    )


def _bootstrap(spark, d):
    root = scratch_path(spark, "warehouse")
    h = I.hourly(spark, d)
    rows = h.select(
        F.replace("city_slug", F.lit("_"), F.lit(" ")).alias("City"),
        F.when(F.col("us_aqi") > 150, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("Timestamp"),
        *[F.col(m).alias(m.upper()) for m in METRICS],
    )
    rows.write.option("header", True).csv(f"{root}/landing")
    wh = Warehouse(f"{root}/tables")
    cities = I.cities(spark, d).where("country <> 'EUROPE'")
    bootstrap_csv(spark, wh, f"{root}/landing", cities, "boot-1", "feed", now())
    return wh


BOOT_SQL = """bt AS (SELECT h.* FROM hourly h JOIN cities c USING (city_slug) WHERE country <> 'EUROPE' AND us_aqi <= 150)"""


@query(
    "s13_bootstrapped_tables",
    cte("hourly", extra=[BOOT_SQL])
    + """SELECT city_slug, count(*) AS rows_loaded, max(ts) AS last_observed_at, count(*) AS rows_upserted, 'success' AS run_status FROM bt GROUP BY 1""",
)
def s13(spark, d):
    wh = _bootstrap(spark, d)
    facts = wh.read(spark, "observations").groupBy("city_slug").agg(F.count(F.lit(1)).alias("rows_loaded"))
    marks = wh.read(spark, "watermarks").select("city_slug", "last_observed_at")
    detail = wh.read(spark, "run_details").select("city_slug", "rows_upserted", "run_id")
    runs = wh.read(spark, "runs").select("run_id", F.col("status").alias("run_status"))
    return facts.join(marks, "city_slug").join(detail, "city_slug").join(runs, "run_id").drop("run_id")


@query(
    "s14_archived_snapshot",
    cte("hourly") + "SELECT city_slug, '2024' AS yyyy, '02' AS mm, '01' AS dd, 'r1' AS run_id, count(*) AS row_count FROM hourly GROUP BY 1",
)
def s14(spark, d):
    root = scratch_path(spark, "archive")
    T.archive_csv(fact_rows(spark, d, "r1").drop("run_id"), root, "city_slug", "r1", now())
    back = (
        spark.read.option("header", True)
        .schema("observed_at string, city_slug string, yyyy string, mm string, dd string, run_id string")
        .csv(root)
    )
    return back.groupBy("city_slug", "yyyy", "mm", "dd", "run_id").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "s15_combined_and_failures",
    cte("hourly")
    + f"""SELECT 'combined' AS part, city_slug, count(*) AS row_count, {r6('max(us_aqi)', 'top')}, CAST(NULL AS VARCHAR) AS error FROM hourly WHERE us_aqi <= 150 GROUP BY 2
 UNION ALL SELECT 'failure', city_slug, count(*), NULL, 'reading above 150' FROM hourly WHERE us_aqi > 150 GROUP BY 2""",
)
def s15c(spark, d):
    """All cities in one compressed file set next to the table of what failed."""
    root = scratch_path(spark, "combined")
    h = I.hourly(spark, d, FILLED)
    T.write_combined_csv(h.where("us_aqi <= 150"), f"{root}/all", gzip=True)
    failed = h.where("us_aqi > 150").groupBy("city_slug").agg(F.count(F.lit(1)).alias("row_count"))
    T.write_failures(failed.withColumn("error", F.lit("reading above 150")), f"{root}/failures")
    good = T.read_csv(spark, f"{root}/all", h.schema, ["city_slug", "ts"]).groupBy("city_slug").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("us_aqi").alias("top")
    )
    bad = spark.read.option("header", True).schema("city_slug string, row_count long, error string").csv(f"{root}/failures")
    return good.select(F.lit("combined").alias("part"), "city_slug", "row_count", "top", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select(F.lit("failure").alias("part"), "city_slug", "row_count", F.lit(None).cast("double").alias("top"), "error")
    )


@query("s15_city_csv_files", cte("hourly") + f"SELECT city_slug, count(*) AS row_count, {r6('max(us_aqi)', 'top')} FROM hourly GROUP BY 1")
def s15(spark, d):
    root = scratch_path(spark, "cities")
    T.write_city_csv(I.hourly(spark, d, FILLED), root, "city_slug", "ts")
    back = spark.read.option("header", True).csv(root)
    return back.groupBy("city_slug").agg(
        F.count(F.lit(1)).alias("row_count"), F.max(F.col("us_aqi").cast("double")).alias("top")
    )


SNAP_SQL = f"""SELECT 'xgboost' AS model, city_slug AS city, strftime(horizon_timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, horizon_hours AS hour,
 {r6('round(predicted + 1e-9, 2)', 'predicted_pm2_5')}, CAST(NULL AS DOUBLE) AS actual_aqi FROM bf
 UNION ALL SELECT 'xgboost', city_slug, '2024-02-01T00:00:00Z', 0, CAST(NULL AS DOUBLE), {r6('round(predicted + 1e-9, 2)', 'x')} FROM bf WHERE horizon_hours = 1"""


def _snapshot_rows(spark, d):
    path = scratch_path(spark, "snapshot")
    nudged = baseline(spark, d).withColumn("predicted", F.col("predicted") + 1e-9)
    T.write_json(S.snapshot_documents(nudged, "xgboost", now()), path)
    return S.snapshot_timeline(spark.read.schema(SNAPSHOT).json(path))


@query("s16_snapshot_round_trip", cte("hourly", extra=[BASE_SQL]) + SNAP_SQL)
def s16(spark, d):
    return _snapshot_rows(spark, d)


@query("s17_snapshot_for_city", cte("hourly", extra=[BASE_SQL]) + f"SELECT * FROM ({SNAP_SQL}) WHERE city = 'nation_4'")
def s17(spark, d):
    return S.snapshot_for_city(_snapshot_rows(spark, d), "nation-4")


@query(
    "s18_field_payload",
    cte("obs")
    + f"""SELECT event_id, city_slug, {r6('us_aqi', 'field1')}, {r6('pm2_5', 'field2')}, CASE WHEN pm2_5 IS NULL THEN 'missing value for pm2_5' END AS problem,
 'city=' || city_slug || ';timestamp=' || strftime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS status FROM obs""",
)
def s18(spark, d):
    o = I.observations(spark, d)
    keyed = o.withColumn("city_slug", F.concat_ws("|", "city_slug", F.col("event_id").cast("string")))
    p = S.field_payload(keyed, ["us_aqi", "pm2_5"], ["field1", "field2"], "city_slug", "observed_at")
    city, event = F.split("city_slug", r"\|")[0], F.split("city_slug", r"\|")[1]
    return p.select(
        event.cast("long").alias("event_id"),
        city.alias("city_slug"),
        "field1",
        "field2",
        "problem",
        F.regexp_replace("status", r"\|\d+;", ";").alias("status"),
    )


@query(
    "s19_csv_resources",
    "SELECT p_name || ' 15 minute' AS name, CASE WHEN p_size % 2 = 0 THEN 'csv' ELSE 'CSV' END AS format, 'u' || p_partkey AS url FROM part WHERE p_brand <> 'Brand#1' AND p_type <> 'PROMO' AND p_size <= 40",
)
def s19(spark, d):
    p = I.table(spark, d, "part")
    entry = F.struct(
        F.concat("p_name", F.when(F.col("p_size") <= 40, " 15 minute").otherwise(" daily")).alias("name"),
        F.when(F.col("p_brand") == "Brand#1", "PDF").when(F.col("p_size") % 2 == 0, "csv").otherwise("CSV").alias("format"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).alias("url"),
    )
    result = F.struct(F.array(entry).alias("resources"))
    docs = p.select(F.to_json(F.struct(F.lit(True).alias("success"), result.alias("result"))).alias("body"))
    return P.csv_resources(docs, "body", "15 minute")


@query(
    "s20_audit_manifest",
    cte("hgrid", extra=["c AS (SELECT city_slug, count(*) AS source_rows FROM hourly GROUP BY 1)"])
    + """SELECT city_slug, c.source_rows, count(*) AS output_rows, count(*) - c.source_rows AS missing_steps, count(*) FILTER (pm2_5 IS NULL) AS pm2_5_before, 0 AS pm2_5_after
 FROM hgrid JOIN c USING (city_slug) GROUP BY 1, 2""",
)
def s20(spark, d):
    path = scratch_path(spark, "manifest")
    h = I.hourly(spark, d, FILLED)
    from breezeline.operators.grid import regular_grid

    audit = A.series_audit(h, HOURLY).select("city_slug", "source_rows", "missing_steps")
    before = A.null_counts(regular_grid(h, HOURLY, FILLED), ["city_slug"], ["pm2_5"], "before")
    filled = impute_for_training(h, HOURLY, FILLED)
    after = filled.groupBy("city_slug").agg(
        F.count(F.lit(1)).alias("output_rows"), F.count_if(F.col("pm2_5").isNull()).alias("pm2_5_after")
    )
    T.write_json(audit.join(before, "city_slug").join(after, "city_slug"), path)
    return spark.read.schema(
        "city_slug string, source_rows long, missing_steps long, pm2_5_before long, output_rows long, pm2_5_after long"
    ).json(path)


# ---- streaming -------------------------------------------------------------------------


def _event_stream(spark, d):
    raw = J.file_stream(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, "parquet", glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


STREAM_HOURS = f"""SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS observation_count, {r6('avg(value)', 'value_avg')},
 {r6('max(value)', 'value_max')}, {r6('min(value)', 'value_min')} FROM events GROUP BY 1, 2"""


@query("t03_streamed_upsert_and_refresh", STREAM_HOURS)
def t03(spark, d):
    """Keyed upsert per micro-batch, then only the touched hours are recomputed."""
    root = scratch_path(spark, "stream")
    handle = J.touched_bucket_batches(
        spark, f"{root}/facts", f"{root}/hours", ["event_id"], "ts", ["ts"], ["event_type"], ["value"]
    )
    J.run_available(_event_stream(spark, d), f"{root}/state", handle)
    cols = ["event_type", "hour", "observation_count", "value_avg", "value_max", "value_min"]
    return spark.read.parquet(f"{root}/hours").select(*cols)


@query(
    "t02_per_city_read_windows",
    cte("newest", extra=["w AS (SELECT city_slug, max(observed_at) AS m FROM obs WHERE us_aqi > 60 GROUP BY 1)"])
    + "SELECT o.city_slug, o.event_id FROM obs o JOIN w USING (city_slug), newest WHERE o.observed_at >= CASE WHEN m - INTERVAL 6 HOURS >= as_of THEN as_of - INTERVAL 1 HOUR ELSE m - INTERVAL 6 HOURS END AND o.observed_at <= as_of",
)
def t02(spark, d):
    o = I.observations(spark, d)
    marks = T.new_watermarks(o.where("us_aqi > 60"), "city_slug", "observed_at", "feed")
    series = I.cities(spark, d).select("city_slug")
    rows = incremental_rows(o, series, marks, I.as_of(o), "city_slug", "observed_at")
    return rows.select("city_slug", "event_id")


ENDS = ("2024-01-15 00:00:00", "2024-01-15 12:00:00")
CYCLE_SQL = f"""c1 AS (SELECT city_slug, ts AS observed_at, us_aqi, 'run-1' AS run_id FROM hourly
 WHERE ts >= TIMESTAMP '{ENDS[0]}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{ENDS[0]}'),
m1 AS (SELECT city_slug, max(observed_at) AS mark FROM c1 GROUP BY 1),
w2 AS (SELECT city_slug, coalesce(mark - INTERVAL 6 HOURS, TIMESTAMP '{ENDS[1]}' - INTERVAL 24 HOURS) AS start FROM cities LEFT JOIN m1 USING (city_slug)),
c2 AS (SELECT h.city_slug, ts AS observed_at, us_aqi + 1 AS us_aqi, 'run-2' AS run_id FROM hourly h JOIN w2 USING (city_slug)
 WHERE ts >= start AND ts <= TIMESTAMP '{ENDS[1]}'),
cycled AS (SELECT * FROM c2 UNION ALL SELECT * FROM c1 ANTI JOIN c2 USING (city_slug, observed_at))"""


def _two_cycles(spark, d):
    """Two incremental runs half a day apart; the second offers corrected values."""
    wh = Warehouse(scratch_path(spark, "cycles"))
    cities = I.cities(spark, d)
    offered = I.hourly(spark, d).withColumnsRenamed({"city_slug": "city", "ts": "timestamp"})
    corrected = offered.withColumn("us_aqi", F.col("us_aqi") + 1)
    for run, rows, end in (("run-1", offered, ENDS[0]), ("run-2", corrected, ENDS[1]), ("run-2", corrected, ENDS[1])):
        incremental_cycle(spark, wh, rows, cities, run, "feed", now(end), now(end))
    return wh


@query(
    "t01_incremental_cycles",
    cte("hourly", extra=[CYCLE_SQL]) + f"SELECT city_slug, observed_at, run_id, {r6('us_aqi')} FROM cycled",
)
def t01(spark, d):
    """The second run starts from the first one's watermarks; its replay changes nothing."""
    return _two_cycles(spark, d).read(spark, "observations").select("city_slug", "observed_at", "run_id", "us_aqi")


@query(
    "t09_refreshed_tables",
    cte("hourly", extra=[CYCLE_SQL])
    + " UNION ALL ".join(
        f"SELECT '{unit}' AS part, city_slug, date_trunc('{unit}', observed_at)::TIMESTAMP AS bucket, count(*) AS n, {r6('avg(us_aqi)', 'us_aqi')} FROM cycled GROUP BY 2, 3"
        for unit in ("hour", "day", "month")
    )
    + f" UNION ALL SELECT 'latest', city_slug, max(observed_at), 1, {r6('max_by(us_aqi, observed_at)', 'us_aqi')} FROM cycled GROUP BY 2",
)
def t09(spark, d):
    """Hour, day, month and latest tables after two runs, each refreshed where it was touched."""
    wh = _two_cycles(spark, d)
    parts = [
        wh.read(spark, name).select(
            F.lit(unit).alias("part"), "city_slug", F.col(unit).cast("timestamp").alias("bucket"),
            F.col("observation_count").alias("n"), F.col("us_aqi_avg").alias("us_aqi"),
        )
        for name, unit in J.ROLLUPS
    ]
    last = wh.read(spark, "latest").select(
        F.lit("latest").alias("part"), "city_slug", F.col("observed_at").alias("bucket"), F.lit(1).cast("long").alias("n"), "us_aqi"
    )
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(last)


@query(
    "t04_tumbling_windows",
    f"SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS observation_count, {r6('avg(value)', 'value_avg')} FROM events GROUP BY 1, 2",
)
def t04(spark, d):
    root = scratch_path(spark, "tumbling")
    windows = J.tumbling(_event_stream(spark, d), ["event_type"], "ts", "1 hour", ["value"], delay="2 days")
    J.run_windows(windows, f"{root}/state", f"{root}/out", ["event_type"])
    return spark.read.parquet(f"{root}/out").select("event_type", "window_start", "observation_count", "value_avg")


@query(
    "t05_sliding_windows",
    f"""SELECT event_type, date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS window_start, count(*) AS observation_count, {r6('avg(value)', 'value_avg')}
 FROM events, generate_series(0, 5) g(k) GROUP BY 1, 2""",
)
def t05(spark, d):
    root = scratch_path(spark, "sliding")
    windows = J.sliding(_event_stream(spark, d), ["event_type"], "ts", "6 hours", "1 hour", ["value"], delay="2 days")
    J.run_windows(windows, f"{root}/state", f"{root}/out", ["event_type"])
    return spark.read.parquet(f"{root}/out").select("event_type", "window_start", "observation_count", "value_avg")


@query(
    "t06_latest_per_user",
    f"""SELECT user_id, ts, event_id, {r6('value')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def t06(spark, d):
    root = scratch_path(spark, "latest")
    handle = J.latest_per_key_batches(spark, f"{root}/latest", ["user_id"], "ts", ["event_id"])
    J.run_available(_event_stream(spark, d).select("user_id", "ts", "event_id", "value"), f"{root}/state", handle)
    return spark.read.parquet(f"{root}/latest").select("user_id", "ts", "event_id", "value")


@query(
    "t07_stream_with_city_dimension",
    cte("cities") + "SELECT event_id, city_slug, country FROM events JOIN cities ON user_id % 25 = city_key",
)
def t07(spark, d):
    root = scratch_path(spark, "enriched")
    stream = _event_stream(spark, d).select("event_id", (F.col("user_id") % 25).cast("int").alias("city_key"))
    query_ = (
        J.enriched(stream, I.cities(spark, d), "city_key")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "city_slug", "country")


@query(
    "t08_ingest_with_failures",
    cte("hourly", extra=["x AS (SELECT city_slug, CAST(split_part(city_slug,'_',2) AS INT) AS n, count(*) AS k FROM hourly GROUP BY 1, 2)"])
    + "SELECT city_slug, CASE WHEN n < 15 THEN 'failed' ELSE 'success' END AS status, CASE WHEN n < 15 THEN 0 ELSE k END AS rows_upserted, 'partial_failure' AS run_status FROM x",
)
def t08(spark, d):
    """Landed documents stream in; broken ones are set aside without stopping others."""
    root = scratch_path(spark, "ingest")
    broken_docs(spark, d).select("city", "body").write.json(f"{root}/landing")
    wh = Warehouse(f"{root}/tables")
    stream = J.file_stream(spark, f"{root}/landing", P_SCHEMA)
    J.run_available(stream, f"{root}/state", J.ingest_batches(spark, wh, I.cities(spark, d), "feed", now()))
    runs = wh.read(spark, "runs").select("run_id", F.col("status").alias("run_status"))
    detail = wh.read(spark, "run_details").select("run_id", "city_slug", "status", "rows_upserted")
    return detail.join(runs, "run_id").drop("run_id")


@query(
    "t10_forecast_then_load",
    cte("hourly", extra=[BASE_SQL])
    + f"SELECT city_slug, horizon_hours, horizon_timestamp, {r6('predicted', 'predicted_us_aqi')} FROM bf",
)
def t10(spark, d):
    path = scratch_path(spark, "forecasts")
    rows = forecast_rows(
        baseline(spark, d), F.col("last_ts"), "Persistence+Trend", "1.0", confidence=F.lit(0.7), baseline_ids=True
    )
    T.upsert_forecasts(spark, path, rows, now())
    return spark.read.parquet(path).select("city_slug", "horizon_hours", "horizon_timestamp", "predicted_us_aqi")


DRIFT_SQL = cte("forecasts", extra=[
    "a AS (SELECT city_slug, date_trunc('hour', observed_at) AS h, us_aqi AS actual FROM obs)",
    "p AS (SELECT f.city_slug, f.predicted_us_aqi AS p, a.actual FROM forecasts f JOIN a ON a.city_slug = f.city_slug AND a.h = f.horizon_timestamp)",
    "s AS (SELECT city_slug, coalesce(100 * avg(abs(p - actual) / actual) FILTER (actual <> 0), 0) AS mape, count(*) AS n FROM p GROUP BY 1)",
]) + f"SELECT city_slug, {r6('mape')}, n, CASE WHEN mape > 15 THEN 'retrain' ELSE 'keep' END AS decision FROM s"


@query("t11_streamed_drift", DRIFT_SQL)
def t11(spark, d):
    root = scratch_path(spark, "drift")
    cities = I.cities(spark, d).select("city_key", "city_slug")
    stream = _event_stream(spark, d).withColumn("city_key", (F.col("user_id") % 25).cast("int"))
    actuals = stream.join(cities, "city_key").select(
        "city_slug", F.date_trunc("hour", "ts").alias("horizon_timestamp"), F.col("value").alias("actual")
    )
    f = I.forecasts(spark, d).select("city_slug", "horizon_timestamp", "predicted_us_aqi")
    handle = J.drift_batches(spark, f"{root}/out", f, ["city_slug"], "horizon_timestamp", "actual", "predicted_us_aqi")
    J.run_available(actuals, f"{root}/state", handle)
    return spark.read.parquet(f"{root}/out").select("city_slug", "mape", "n", "decision")


def _pieces(df, ts, parts=3):
    """The rows in ``parts`` pieces of rising time."""
    low, high = df.agg(F.unix_timestamp(F.min(ts)), F.unix_timestamp(F.max(ts))).first()
    width = (high - low) // parts + 1
    return [df.where(F.floor((F.unix_timestamp(ts) - low) / width) == i) for i in range(parts)]


@query("t11_matched_streams", DRIFT_SQL)
def t11m(spark, d):
    """Forecasts and readings as two streams, each piece by piece, matched in state."""
    root = scratch_path(spark, "matched")
    f = I.forecasts(spark, d).select("city_slug", "horizon_timestamp", "forecast_timestamp", "predicted_us_aqi")
    a = I.observations(spark, d).select(
        "city_slug", F.date_trunc("hour", "observed_at").alias("horizon_timestamp"), F.col("us_aqi").alias("actual")
    )
    for some_f, some_a in zip(_pieces(f, "forecast_timestamp"), _pieces(a, "horizon_timestamp")):
        some_f.write.mode("append").parquet(f"{root}/forecasts")
        some_a.write.mode("append").parquet(f"{root}/actuals")
        issued = J.file_stream(spark, f"{root}/forecasts", f.schema, "parquet")
        read = J.file_stream(spark, f"{root}/actuals", a.schema, "parquet")
        pairs = M.matched_forecasts(
            issued, read, ["city_slug"], "horizon_timestamp", "forecast_timestamp", "actual", "predicted_us_aqi", 24
        )
        M.run_matched_drift(pairs, f"{root}/state", f"{root}/out", ["city_slug"], "actual", "predicted_us_aqi")
    return M.drift_so_far(spark, f"{root}/out", ["city_slug"])


@query(
    "t12_outage_sessions",
    cte("hourly", extra=["g AS (SELECT city_slug, ts, lead(ts) OVER (PARTITION BY city_slug ORDER BY ts) AS n FROM hourly)"])
    + """SELECT city_slug, ts + INTERVAL 1 HOUR AS gap_start, n - INTERVAL 1 HOUR AS gap_end, date_diff('hour', ts, n) - 1 AS gap_rows
 FROM g WHERE n > ts + INTERVAL 1 HOUR""",
)
def t12(spark, d):
    """Silences between unbroken runs of hourly readings, from session state; a later reading of a clock closes all."""
    root = scratch_path(spark, "outages")
    hours = I.observations(spark, d).select("city_slug", F.date_trunc("hour", "observed_at").alias("hour"))
    clock = hours.agg((F.max("hour") + F.expr("INTERVAL 9 DAYS")).alias("hour")).select(F.lit("clock").alias("city_slug"), "hour")
    for some in [*_pieces(hours, "hour"), clock]:
        some.write.mode("append").parquet(f"{root}/in")
        stream = J.file_stream(spark, f"{root}/in", hours.schema, "parquet")
        M.run_sessions(M.reading_sessions(stream, ["city_slug"], "hour", 3600, "6 hours"), f"{root}/state", f"{root}/runs", ["city_slug"])
    closed = spark.read.parquet(f"{root}/runs").where("city_slug <> 'clock'")
    return M.outages(closed, ["city_slug"], 3600)


P_SCHEMA = "city string, body string"
