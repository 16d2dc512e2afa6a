import json
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from breezeline.operators.aggregate import bucket_aggregate
from breezeline.schema import METRICS
from breezeline.sources.ingest import Warehouse, write_observations
from breezeline.sources.tables import hash_part
from breezeline.streaming import jobs as J
from tests.helpers import poisoned

NOW = "2026-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def land(folder, name, city, day, values):
    hours = [f"2026-01-{day:02d}T{h:02d}:00" for h in range(len(values))]
    body = json.dumps({"hourly": {"time": hours, "us_aqi": values, "pm2_5": values}})
    (folder / f"{name}.json").write_text(json.dumps({"city": city, "body": body}) + "\n")


def cities(spark):
    return spark.createDataFrame([("delhi", "Delhi"), ("pune", "Pune")], "city_slug string, city_name string")


def test_out_of_order_and_corrected_files_end_as_the_batch_result(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    wh = Warehouse(str(tmp_path / "wh"))

    def drain():
        stream = J.file_stream(spark, str(landing), "city string, body string", per_batch=1)
        J.run_available(stream, str(tmp_path / "state"), J.ingest_batches(spark, wh, cities(spark), "feed", now()))

    land(landing, "1", "Delhi", 20, [1.0, 2.0, 3.0])
    land(landing, "2", "Pune", 5, [10.0])
    drain()
    land(landing, "3", "Delhi", 3, [7.0])  # days late
    land(landing, "4", "Delhi", 20, [100.0])  # corrects the first hour
    (landing / "5.json").write_text(json.dumps({"city": "Pune", "body": '{"hourly": {"time": []}}'}) + "\n")
    drain()

    rows = {(r["city_slug"], r["observed_at"]): r["us_aqi"] for r in wh.read(spark, "observations").collect()}
    assert rows == {
        ("delhi", datetime(2026, 1, 20, 0)): 100.0,
        ("delhi", datetime(2026, 1, 20, 1)): 2.0,
        ("delhi", datetime(2026, 1, 20, 2)): 3.0,
        ("pune", datetime(2026, 1, 5, 0)): 10.0,
        ("delhi", datetime(2026, 1, 3, 0)): 7.0,
    }
    batch = bucket_aggregate(wh.read(spark, "observations"), "hour", ["city_slug"], "observed_at", METRICS)
    pick = ["city_slug", "hour", "observation_count", "us_aqi_avg", "pm2_5_max"]
    got = {tuple(r) for r in wh.read(spark, "hourly").select(*pick).collect()}
    assert got == {tuple(r) for r in batch.select(*pick).collect()}
    assert wh.read(spark, "quarantine").count() == 1
    status = {r["run_id"]: r["status"] for r in wh.read(spark, "runs").collect()}
    assert sorted(status.values()) == ["partial_failure"] + ["success"] * 4
    marks = {r["city_slug"]: r["last_observed_at"] for r in wh.read(spark, "watermarks").collect()}
    assert marks["pune"] == datetime(2026, 1, 5)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame(
        [("Delhi", json.dumps({"hourly": {"time": ["2026-01-01T00:00"], "us_aqi": [4.0]}}))], "city string, body string"
    )
    wh = Warehouse(str(tmp_path / "wh"))
    handle = J.ingest_batches(spark, wh, cities(spark), "feed", now())
    handle(docs, 0)
    first = {t: sorted(map(str, wh.read(spark, t).collect())) for t in ("observations", "watermarks", "runs", "run_details")}
    handle(docs, 0)
    for t, rows in first.items():
        assert sorted(map(str, wh.read(spark, t).collect())) == rows


def events(spark, tmp_path, n=300):
    df = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919 % 40) * 1800).alias("ts"),
        F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("u"),
        (F.col("id") % 17).cast("double").alias("v"),
    )
    path = str(tmp_path / "events")
    df.repartition(6).write.parquet(path)
    return J.file_stream(spark, path, df.schema, "parquet", per_batch=2), df


def test_tumbling_and_latest_match_batch(spark, tmp_path):
    stream, df = events(spark, tmp_path)
    windows = J.tumbling(stream, ["u"], "ts", "1 hour", ["v"], delay="100 hours")
    J.run_windows(windows, str(tmp_path / "s1"), str(tmp_path / "o1"), ["u"])
    got = {(r["u"], r["window_start"], r["observation_count"]) for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    want = df.groupBy("u", F.date_trunc("hour", "ts").alias("w")).count()
    # half past the hour never starts a window here, so truncation equals the window
    assert got == {(r["u"], r["w"], r["count"]) for r in want.collect()}

    handle = J.latest_per_key_batches(spark, str(tmp_path / "o2"), ["u"], "ts", ["event_id"])
    J.run_available(stream, str(tmp_path / "s2"), handle)
    got = {r["u"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    want = df.groupBy("u").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert got == {r["u"]: r["e"] for r in want.collect()}


def test_append_mode_emits_closed_windows_only(spark, tmp_path):
    stream, df = events(spark, tmp_path)
    out = J.tumbling(stream, ["u"], "ts", "1 hour", ["v"], delay="100 hours")
    q = (
        out.writeStream.format("parquet")
        .option("path", str(tmp_path / "o3"))
        .option("checkpointLocation", str(tmp_path / "s3"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert spark.read.schema(out.schema).parquet(str(tmp_path / "o3")).count() == 0


def test_state_of_closed_windows_is_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    for i, start in enumerate((0, 100, 200)):
        hours = spark.range(start, start + 4).selectExpr("timestamp_seconds(id * 3600) AS ts", "1.0D AS v", "'a' AS u")
        hours.coalesce(1).write.mode("append").parquet(str(folder / f"f{i}"))
    schema = spark.read.parquet(str(folder / "f0")).schema
    kept = []
    for i in range(3):
        stream = spark.readStream.schema(schema).parquet(str(folder / f"f[0-{i}]"))
        windows = J.tumbling(stream, ["u"], "ts", "1 hour", ["v"], delay="2 hours")
        query = J.run_windows(windows, str(tmp_path / f"s{i}"), str(tmp_path / f"o{i}"), ["u"])
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert spark.read.parquet(str(tmp_path / f"o{i}")).count() == 4 * (i + 1)
    # one batch each, then a batch without data that drops what the watermark has passed
    assert max(kept) <= 4


def written(folder):
    return {p.parent.name for p in folder.rglob("*.parquet")}


def stamps(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_only_partitions_with_news_are_rewritten(spark, tmp_path):
    path = tmp_path / "latest"
    handle = J.latest_per_key_batches(spark, str(path), ["u"], "ts", ["e"], parts=32)
    rows = spark.range(200).selectExpr("id AS u", "timestamp_seconds(1000) AS ts", "1 AS e")
    handle(rows, 0)
    before = stamps(path)
    one = spark.createDataFrame([(7, 2000, 1), (8, 500, 1), (9, 1000, 1)], "u long, s long, e int")
    handle(one.selectExpr("u", "timestamp_seconds(s) AS ts", "e"), 1)
    after = stamps(path)
    assert len({p.parent for p in set(before) ^ set(after)}) == 1
    assert spark.read.parquet(str(path)).where("ts = timestamp_seconds(2000)").count() == 1


def test_ledger_directories_follow_days_and_a_run_replaces_its_own_rows(spark, tmp_path):
    docs = spark.createDataFrame(
        [("Delhi", json.dumps({"hourly": {"time": ["2026-01-01T00:00"], "us_aqi": [4.0]}})), ("Pune", "{")],
        "city string, body string",
    )
    wh = Warehouse(str(tmp_path / "wh"))
    tables = ("runs", "run_details", "quarantine")
    for batch in range(4):
        J.ingest_batches(spark, wh, cities(spark), "feed", now())(docs, batch)
    for t in tables:
        assert written(tmp_path / "wh" / t) == {"run_date=2026-02-01"}
        assert {r["run_id"] for r in wh.read(spark, t).collect()} == {f"stream-{i:08d}" for i in range(4)}
    rows = {t: wh.read(spark, t).count() for t in tables}
    # a day later one run comes again, and a new one: the old run stays in its day
    later = F.lit("2026-02-02 00:00:00").cast("timestamp")
    for batch in (2, 4):
        J.ingest_batches(spark, wh, cities(spark), "feed", later)(docs, batch)
    for t in tables:
        assert written(tmp_path / "wh" / t) == {"run_date=2026-02-01", "run_date=2026-02-02"}
        per_run = {r["run_id"]: (str(r["run_date"]), r["count"]) for r in wh.read(spark, t).groupBy("run_id", "run_date").count().collect()}
        each = rows[t] // 4
        assert per_run == {f"stream-{i:08d}": ("2026-02-02" if i == 4 else "2026-02-01", each) for i in range(5)}


def readings(spark, seed, n, first_day=1, days=60):
    """Rows of the fact table at minutes of January and February, near a high level."""
    dice = F.abs(F.xxhash64(F.lit(seed), "id"))
    ts = F.timestamp_seconds(1_767_225_600 + (first_day - 1) * 86400 + dice % (days * 86400))
    metrics = {m: F.when(dice % (7 + i) != 0, 1e6 + (dice % (997 + i)).cast("double") / 8) for i, m in enumerate(METRICS)}
    return spark.range(n).select(
        F.when(dice % 3 == 0, "delhi").otherwise("pune").alias("city_slug"), F.lit("x").alias("city_name"),
        F.date_trunc("minute", ts).alias("observed_at"), *[v.alias(m) for m, v in metrics.items()],
        F.lit("feed").alias("source"), now().alias("ingested_at"), F.lit(f"r{seed}").alias("run_id"),
    ).dropDuplicates(["city_slug", "observed_at"])


def same_rollups(spark, wh):
    facts = wh.read(spark, "observations")
    for name, unit in J.ROLLUPS:
        want = bucket_aggregate(facts, unit, ["city_slug"], "observed_at", METRICS)
        got = wh.read(spark, name).select(*want.columns)
        key = ["city_slug", unit]
        a, b = (d.toPandas().sort_values(key).reset_index(drop=True) for d in (got, want))
        assert a[key].astype(str).equals(b[key].astype(str))
        for c in want.columns[2:]:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=f"{name} {c}")


def test_rollups_are_combined_from_moments_of_touched_hours(spark, tmp_path):
    wh = Warehouse(str(tmp_path / "wh"))
    rows = readings(spark, 1, 4000)
    write_observations(spark, wh, rows, now())
    J.refresh_touched(spark, wh, rows)
    same_rollups(spark, wh)
    # late and corrected rows of two days; every other day of the facts holds nonsense meanwhile
    late = readings(spark, 2, 40, first_day=9, days=2)
    write_observations(spark, wh, late, now())
    touched = {f"observed_date={r[0]}" for r in late.select(F.to_date("observed_at")).distinct().collect()}
    others = [p for p in (tmp_path / "wh" / "observations").rglob("*.parquet") if p.parent.name not in touched]
    assert len(touched) <= 3 and len(others) > 50
    with poisoned(others, **dict.fromkeys(METRICS, 9e99)):
        J.refresh_touched(spark, wh, late)
    same_rollups(spark, wh)


def test_facts_without_moments_are_rolled_up_once(spark, tmp_path):
    wh = Warehouse(str(tmp_path / "wh"))
    write_observations(spark, wh, readings(spark, 3, 300), now())
    some = readings(spark, 4, 20)
    write_observations(spark, wh, some, now())
    J.refresh_touched(spark, wh, some)
    same_rollups(spark, wh)


def test_the_latest_table_is_opened_where_keys_fall(spark, tmp_path):
    path = tmp_path / "latest"
    handle = J.latest_per_key_batches(spark, str(path), ["u"], "ts", ["e"], parts=32)
    handle(spark.range(500).selectExpr("id AS u", "timestamp_seconds(1000) AS ts", "1 AS e"), 0)
    news = spark.range(7, 9).selectExpr("id AS u", "timestamp_seconds(2000) AS ts", "1 AS e")
    mine = {f"part={r[0]}" for r in news.select(hash_part(["u"], 32)).collect()}
    others = [p for p in path.rglob("*.parquet") if p.parent.name not in mine]
    assert len(others) >= 30
    with poisoned(others, u=7, ts=datetime(2099, 1, 1)):
        handle(news, 1)
    got = spark.read.parquet(str(path))
    assert got.count() == 500 and got.where("ts = timestamp_seconds(2000)").count() == 2
