import json
import uuid
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from breezeline.functions.text import archive_path, run_id
from breezeline.operators import serve as S
from breezeline.operators.aggregate import required_metric_report, series_audit
from breezeline.schema import METRICS, RAW_OBSERVATIONS
from breezeline.sources import clean as C
from breezeline.sources import payload as P
from breezeline.sources import tables as T
from breezeline.sources.ingest import Warehouse, bootstrap_csv
from tests.helpers import TINY, poisoned


def at(text):
    return datetime.fromisoformat(text)


def stamp(text):
    return F.lit(text).cast("timestamp")


def test_read_windows(spark):
    marks = spark.createDataFrame(
        [("none", None), ("overlap", at("2026-04-24 18:00")), ("ahead", at("2026-04-25 23:00"))],
        "city_slug string, last_observed_at timestamp",
    )
    got = {r["city_slug"]: r["window_start"] for r in C.read_window(marks, stamp("2026-04-25 12:00:00")).collect()}
    assert got == {
        "none": at("2026-04-24 12:00"),
        "overlap": at("2026-04-24 12:00"),
        "ahead": at("2026-04-25 11:00"),
    }


def test_archive_path_and_run_id(spark):
    row = spark.range(1).select(
        archive_path("/tmp/archive", F.lit("hyderabad"), stamp("2026-04-25 12:00:00"), F.lit("aq-20260425T120000Z")).alias("p"),
        run_id(F.lit("aq job/1"), stamp("2026-04-25 12:00:00.000123")).alias("r"),
    ).first()
    assert row["p"] == "/tmp/archive/hyderabad/2026/04/25/aq-20260425T120000Z.csv.gz"
    assert row["r"] == "aq_job_1-20260425T120000000123Z"


def raw(spark, times):
    cols = ["city", "timestamp", *METRICS, "extra"]
    rows = [("Delhi", t, "10.0", "20", "0.1", "0.2", "0.3", "0.4", "42", "zzz") for t in times]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_normalised_frame_has_the_fixed_columns(spark):
    d = C.normalise_observations(raw(spark, ["2026-04-25T00:00:00Z", "2026-04-25T05:30:00+05:30"]))
    assert d.columns == RAW_OBSERVATIONS.fieldNames()
    rows = d.collect()
    assert {r["timestamp"] for r in rows} == {at("2026-04-25 00:00")} and rows[0]["us_aqi"] == 42.0


def test_bad_times_fail_or_go(spark):
    bad = raw(spark, ["never", "2026-04-25T00:00:00Z"])
    assert C.normalise_observations(bad, strict=False).count() == 1
    with pytest.raises(Exception):
        C.normalise_observations(bad).collect()
    with pytest.raises(ValueError):
        C.normalise_observations(bad.drop("ozone"))


def document(times, **metrics):
    return json.dumps({"hourly": {"time": times, **metrics}})


def test_payload_cases(spark):
    t = ["2026-04-25T00:00", "2026-04-25T01:00"]
    docs = {
        "ok": document(t, pm2_5=[1.0, None], us_aqi=[5, 6]),
        "empty": document([]),
        "length": document(t, pm10=[1.0]),
        "time": document(["2026-04-25T00:00", "x"]),
        "junk": "{not json",
    }
    rows, bad = P.decode_payloads(spark.createDataFrame(list(docs.items()), "city string, body string"))
    got = rows.orderBy("timestamp").collect()
    assert [(r["city"], r["pm2_5"], r["pm10"], r["us_aqi"]) for r in got] == [("ok", 1.0, None, 5.0), ("ok", None, None, 6.0)]
    assert {r["city"]: r["problem"] for r in bad.collect()} == {
        "empty": "no hourly rows",
        "length": "length of pm10 differs from time",
        "time": "unreadable time",
        "junk": "no hourly rows",
    }


def facts(spark, rows):
    return spark.createDataFrame(
        [(s, at(t), v, at(i), r) for s, t, v, i, r in rows],
        "city_slug string, observed_at timestamp, pm2_5 double, ingested_at timestamp, run_id string",
    ).withColumn("source", F.lit("feed")).withColumn("observed_date", F.to_date("observed_at"))


KEY = ["city_slug", "observed_at", "source"]
ORDER = ["ingested_at", "run_id"]


def test_upsert_keeps_created_at_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "obs")
    one = facts(spark, [("a", "2026-01-01 00:00", 1.0, "2026-01-02", "r1"), ("a", "2026-01-02 00:00", 2.0, "2026-01-02", "r1")])
    two = facts(
        spark,
        [
            ("a", "2026-01-01 00:00", 9.0, "2026-01-03 00:00", "r2"),
            ("a", "2026-01-01 00:00", 5.0, "2026-01-02 12:00", "r2"),  # same key twice in a batch
            ("b", "2026-01-01 00:00", 7.0, "2026-01-03", "r2"),
        ],
    )
    T.upsert_table(spark, path, one, KEY, ORDER, ["observed_date"], stamp("2026-01-02 00:00:00"))
    for _ in range(2):
        T.upsert_table(spark, path, two, KEY, ORDER, ["observed_date"], stamp("2026-01-03 00:00:00"))
    got = {(r["city_slug"], r["observed_at"].day): r for r in spark.read.parquet(path).collect()}
    assert len(got) == 3 and spark.read.parquet(path).count() == 3
    assert got["a", 1]["pm2_5"] == 9.0 and got["a", 1]["created_at"] == at("2026-01-02")
    assert got["a", 1]["updated_at"] == at("2026-01-03")
    assert got["a", 2]["pm2_5"] == 2.0 and got["a", 2]["updated_at"] == at("2026-01-02")
    assert got["b", 1]["created_at"] == at("2026-01-03")


def test_older_late_row_does_not_win(spark):
    old = facts(spark, [("a", "2026-01-01 00:00", 9.0, "2026-01-05", "r2")]).withColumn("created_at", stamp("2026-01-05 00:00:00")).withColumn("updated_at", stamp("2026-01-05 00:00:00"))
    late = facts(spark, [("a", "2026-01-01 00:00", 1.0, "2026-01-03", "r1")])
    merged = T.merge_keyed(old, late, [*KEY, "observed_date"], ORDER, stamp("2026-01-06 00:00:00")).collect()
    assert [r["pm2_5"] for r in merged] == [9.0]


def test_bootstrap_repairs_names_and_skips_unknown_cities(spark, tmp_path):
    csv = tmp_path / "in.csv"
    head = "City, Timestamp ,PM2_5,pm10,Carbon Monoxide,nitrogen_dioxide,sulphur_dioxide,ozone,US AQI\n"
    body = "Delhi,2026-01-01T00:00:00Z,1,2,3,4,5,6,7\nDelhi,oops,1,2,3,4,5,6,7\nAtlantis,2026-01-01T00:00:00Z,1,2,3,4,5,6,7\n"
    csv.write_text(head + body)
    wh = Warehouse(str(tmp_path / "wh"))
    cities = spark.createDataFrame([("delhi", "Delhi")], "city_slug string, city_name string")
    now = stamp("2026-01-02 00:00:00")
    for _ in range(2):
        bootstrap_csv(spark, wh, str(csv), cities, "run-1", "feed", now)
    rows = wh.read(spark, "observations").collect()
    assert [(r["city_slug"], r["us_aqi"], r["carbon_monoxide"]) for r in rows] == [("delhi", 7.0, 3.0)]
    assert wh.read(spark, "runs").collect()[0]["status"] == "success"
    assert wh.read(spark, "watermarks").collect()[0]["last_observed_at"] == at("2026-01-01")


def test_station_columns_are_found_by_words(spark):
    df = spark.createDataFrame(
        [("2026-01-01 00:15:00", "S", "12.5", "bad")],
        "`Timestamp` string, `Station Name` string, `PM2.5 (µg/m³)` string, `CO (mg/m³)` string",
    )
    row = C.station_frame(df, F.lit("t"), F.lit("u")).first()
    assert row["pm2_5"] == 12.5 and row["co_mg_m3"] is None and row["ozone"] is None
    assert C.pick_column(["A", "Station Name"], ("station", "name")) == "Station Name"


def test_audit_and_required_metrics(spark):
    df = spark.createDataFrame(
        [("a", at("2026-01-01 00:00"), 1.0), ("a", at("2026-01-01 00:00"), 2.0), ("a", at("2026-01-01 05:00"), None)],
        "k string, ts timestamp, pm2_5 double",
    )
    r = series_audit(df, TINY).first()
    assert (r["source_rows"], r["duplicate_rows"], r["expected_steps"], r["missing_steps"]) == (3, 1, 6, 4)
    report = required_metric_report(df.withColumn("pm10", F.lit(None).cast("double")), "k", ["pm2_5", "pm10"], [])
    assert [(x["metric"], x["level"]) for x in report.collect()] == [("pm10", "error")]


def test_rejected_forecasts_say_why(spark):
    cols = "forecast_id string, city_slug string, city_name string, forecast_timestamp timestamp, horizon_timestamp timestamp, horizon_hours int, predicted_us_aqi double, model_type string, confidence double"
    t = at("2026-01-01")
    df = spark.createDataFrame([("f1", "a", "A", t, t, 1, 5.0, "m", 0.5), ("f2", "a", "A", t, t, 1, None, "m", None)], cols)
    good, bad = T.check_forecasts(df)
    assert good.count() == 1 and bad.first()["problem"] == "missing predicted_us_aqi, confidence"


def test_second_load_replaces_predictions_and_keeps_identity(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    cols = "forecast_id string, city_slug string, city_name string, forecast_timestamp timestamp, horizon_timestamp timestamp, horizon_hours int, predicted_us_aqi double, model_type string, confidence double"
    t, later = at("2026-01-01"), at("2026-01-01 05:00")
    one = spark.createDataFrame([("f1", "a", "A", later, later, 1, 5.0, "m1", 0.5)], cols)
    two = spark.createDataFrame([("f1", "b", "B", t, t, 2, 6.0, "m2", 0.6)], cols)
    T.upsert_forecasts(spark, path, one, stamp("2026-01-02 00:00:00"))
    T.upsert_forecasts(spark, path, two, stamp("2026-01-02 01:00:00"))
    (r,) = spark.read.parquet(path).collect()
    assert (r["city_slug"], r["city_name"], r["horizon_hours"], r["forecast_timestamp"]) == ("a", "A", 1, later)
    assert (r["predicted_us_aqi"], r["model_type"], r["confidence"]) == (6.0, "m2", 0.6)
    assert r["created_at"] == at("2026-01-02") and r["updated_at"] == at("2026-01-02 01:00")


def test_files_are_listed_and_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "city string, v double")
    T.write_combined_csv(df, str(tmp_path / "all"), gzip=True)
    files = T.list_files(spark, str(tmp_path), "*.gz").collect()
    assert files and all(f["path"].endswith(".csv.gz") and f["length"] > 0 for f in files)


def test_a_key_keeps_its_partition_over_a_date_edge(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    cols = "forecast_id string, city_slug string, city_name string, forecast_timestamp timestamp, horizon_timestamp timestamp, horizon_hours int, predicted_us_aqi double, model_type string, model_version string, confidence double"

    def load(issued, value):
        row = ("f1", "delhi", "Delhi", at(issued), at("2026-01-02 05:00"), 6, value, "m", "1", 0.5)
        T.upsert_forecasts(spark, path, spark.createDataFrame([row], cols), stamp("2026-01-03 00:00:00"))

    load("2026-01-01 23:30", 1.0)
    load("2026-01-02 00:30", 2.0)
    got = spark.read.parquet(path).collect()
    assert [(r["forecast_timestamp"], r["predicted_us_aqi"]) for r in got] == [(at("2026-01-01 23:30"), 2.0)]


def test_rows_without_a_partition_value_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in (1, 2):
        rows = spark.createDataFrame([(i, None)], "id int, day date")
        T.upsert_table(spark, path, rows, ["id"], ["updated_at"], ["day"], stamp("2026-01-01 00:00:00"))
    assert {r["id"] for r in spark.read.parquet(path).collect()} == {1, 2}


def test_a_late_file_lowers_no_watermark(spark, tmp_path):
    path = str(tmp_path / "marks")
    for day, run in ((20, 1), (3, 2), (None, 3)):
        mark = at(f"2026-01-{day:02d} 00:00") if day else None
        rows = spark.createDataFrame([("delhi", mark)], "city_slug string, last_observed_at timestamp")
        T.write_watermarks(spark, path, rows, stamp(f"2026-02-0{run} 00:00:00"))
    assert [r["last_observed_at"] for r in spark.read.parquet(path).collect()] == [at("2026-01-20 00:00")]


def test_unreadable_values_fail_or_are_listed(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("1", "2026-01-01 00:00:00"), ("x", "never"), (None, None)], "a string, t string").coalesce(1).write.option("header", True).csv(path)
    schema = spark.createDataFrame([], "a int, t timestamp").schema
    with pytest.raises(Exception, match="unreadable"):
        T.read_csv(spark, path, schema, ["a"]).collect()
    assert {r["a"] for r in T.read_csv(spark, path, schema, ["a"], strict=False).collect()} == {1, None}
    bad = T.unreadable_rows(spark, path, schema).collect()
    assert [(r["a"], r["unreadable"]) for r in bad] == [("x", "a, t")]


def test_days_outside_of_the_bounds_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(240).selectExpr("id AS k", "timestamp_seconds(id * 3600) AS ts", "to_date(timestamp_seconds(id * 3600)) AS d").write.partitionBy("d").parquet(path)
    cut = T.scan(spark, path, "k", None, "ts", at("1970-01-03 05:00"), at("1970-01-04 02:00"), date_col="d")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "d#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan
    assert cut.count() == 21 and len(cut.inputFiles()) <= len(spark.read.parquet(path).inputFiles())


def test_a_load_opens_the_index_parts_and_days_of_its_keys(spark, tmp_path):
    path = tmp_path / "forecasts"
    cols = "forecast_id string, city_slug string, city_name string, forecast_timestamp timestamp, horizon_timestamp timestamp, horizon_hours int, predicted_us_aqi double, model_type string, model_version string, confidence double"
    rows = [(f"f{d}-{i}", "delhi", "Delhi", at(f"2026-01-{d:02d} 23:30"), at("2026-02-02 05:00"), i, 1.0, "m", "1", 0.5) for d in range(1, 11) for i in range(40)]
    T.upsert_forecasts(spark, str(path), spark.createDataFrame(rows, cols), stamp("2026-01-03 00:00:00"))
    assert {p.parent.name for p in (path / "_keys").rglob("*.parquet")} > {"part=0"}
    # f3-7 comes back with an issue time a day later, and f4-900 is new
    again = [("f3-7", "delhi", "Delhi", at("2026-01-04 00:30"), at("2026-02-02 05:00"), 7, 2.0, "m", "1", 0.5)]
    again += [("f4-900", "delhi", "Delhi", at("2026-01-04 00:30"), at("2026-02-02 05:00"), 9, 3.0, "m", "1", 0.5)]
    load = spark.createDataFrame(again, cols)
    parts = {f"part={r[0]}" for r in load.select(F.pmod(F.xxhash64("forecast_id"), F.lit(64))).collect()}
    mine = parts | {"issue_date=2026-01-03", "issue_date=2026-01-04"}
    others = [p for p in path.rglob("*.parquet") if p.parent.name not in mine]
    index = [p for p in others if p.parent.parent.name == "_keys"]
    key = load.where("forecast_id = 'f3-7'").select(F.xxhash64("forecast_id"), F.xxhash64(F.lit(1), "forecast_id")).first()
    assert len(others) > 50 and len(index) > 40
    with poisoned(index, h1=key[0], h2=key[1]), poisoned([p for p in others if p not in index], forecast_id="f3-7"):
        T.upsert_forecasts(spark, str(path), load, stamp("2026-01-05 00:00:00"))
    got = {r["forecast_id"]: r for r in spark.read.parquet(str(path)).collect()}
    assert len(got) == 401 and got["f3-7"]["predicted_us_aqi"] == 2.0 and got["f3-7"]["forecast_timestamp"] == at("2026-01-03 23:30")
    assert str(got["f3-7"]["issue_date"]) == "2026-01-03" and str(got["f4-900"]["issue_date"]) == "2026-01-04"
    # a table that came without an index gets one from its keys
    bare = str(tmp_path / "bare")
    spark.read.parquet(str(path)).write.partitionBy("issue_date").parquet(bare)
    T.upsert_forecasts(spark, bare, load.withColumn("forecast_timestamp", F.lit("2026-01-09 00:00:00").cast("timestamp")), stamp("2026-01-06 00:00:00"))
    assert spark.read.parquet(bare).count() == 401
    assert spark.read.parquet(bare + "/_keys").count() == 401


def test_row_groups_outside_of_a_city_are_skipped(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.range(60_000).selectExpr(
        "concat('city_', lpad(cast(xxhash64(id) % 50 + 50 AS string), 3, '0')) AS city_slug",
        "timestamp_seconds(86400 * (id % 3) + id % 86400) AS observed_at", "date_add(DATE'1970-01-01', cast(id % 3 AS int)) AS observed_date", "rand(1) AS v",
    )
    T.overwrite_partitions(rows, path, ["observed_date"], ["city_slug", "observed_at"], row_group=16 << 10)
    wanted = "city_042"
    groups = met = 0
    for p in (tmp_path / "facts" / "observed_date=1970-01-02").glob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        at_city = [meta.schema.column(i).name for i in range(meta.num_columns)].index("city_slug")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at_city).statistics
            groups += 1
            met += stats.min <= wanted <= stats.max
        own = pq.read_table(p).to_pandas()
        assert own.sort_values(["city_slug", "observed_at"], kind="stable").index.equals(own.index)
    assert groups >= 10 and met <= 3
    cut = spark.read.parquet(path).where((F.col("city_slug") == wanted) & (F.col("observed_date") == F.lit("1970-01-02").cast("date")))
    assert "EqualTo(city_slug,city_042)" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == rows.where((F.col("city_slug") == wanted) & (F.col("observed_date") == F.lit("1970-01-02").cast("date"))).count()


def test_publishing_makes_a_sender_per_partition_and_sends_batches(spark, tmp_path):
    payload = spark.range(25).selectExpr("id", "CASE WHEN id = 3 THEN 'missing' END AS problem").repartition(2)
    folder = str(tmp_path)

    def make_sender():
        name = f"{folder}/{uuid.uuid4().hex}"
        failures = [1]

        def send(batch):
            if failures.pop() if failures else 0:
                raise OSError("try again")
            with open(name, "a") as f:
                f.write(" ".join(str(row["id"]) for row in batch) + "\n")

        return send

    S.publish(payload, make_sender, batch_rows=5)
    files = [p.read_text().splitlines() for p in tmp_path.iterdir() if p.suffix != ".crc"]
    sent = sorted(int(x) for lines in files for line in lines for x in line.split())
    assert sent == [i for i in range(25) if i != 3] and len(files) == 2
    assert max(len(line.split()) for lines in files for line in lines) == 5

    def broken():
        def send(batch):
            raise OSError("the receiver is gone")

        return send

    with pytest.raises(Exception, match="the receiver is gone"):
        S.publish(payload, broken)
    S.publish(payload.limit(0), broken)  # no rows, no sender


@pytest.mark.parametrize("threshold", ["12000", "-1"])
def test_trailing_days_never_puts_a_series_into_one_task(spark, tmp_path, threshold):
    start, n = at("2020-01-01"), 20_000
    hot = F.timestamp_add("HOUR", F.col("id"), F.lit(start))
    few = [("cold", at("2010-01-01"), -1), ("cold", at("2011-01-01"), -2), ("cold", at("2011-01-01"), -3), (None, start, -4), ("hot", None, -5), ("unknown", None, -6)]
    rows = spark.range(n).repartition(8).select(F.lit("hot").alias("k"), hot.alias("ts"), "id")
    rows.unionByName(spark.createDataFrame(few, "k string, ts timestamp, id long")).write.parquet(f"{tmp_path}/rows")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": threshold,
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        whole = C.trailing_days(spark.read.parquet(f"{tmp_path}/rows"), ["k"], "ts", days=800)
        got = whole.select("k", "ts", "id", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert whole.columns == ["k", "ts", "id"]
    kept = {r["id"]: r["k"] for r in got}
    assert len(kept) == len(got) == 800 * 24 + 1 + 3
    assert kept == {**{i: "hot" for i in range(n - 1 - 800 * 24, n)}, **{i: "cold" for i in (-1, -2, -3)}}
    tasks = [r["task"] for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(got) / 2
