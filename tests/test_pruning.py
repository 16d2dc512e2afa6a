"""Bounds that must reach the scan, and cells that must stay small."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from breezeline.operators import aggregate as A
from breezeline.operators import quantiles as Q
from breezeline.operators.rank import latest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a01_hourly_aggregates", "a02_daily_aggregates", "a03_monthly_aggregates", "w10_latest_observations", "p10_week_of_hourly", "w18_trend_over_range"])
def test_time_bounds_reach_the_scan_and_facts_are_read_once(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    scans = [line for line in text.splitlines() if "FileScan" in line and "events.parquet" in line]
    assert len(scans) == 1
    assert "GreaterThanOrEqual(ts," in text.split("PushedFilters: ")[1] or "GreaterThanOrEqual(ts," in text


def test_old_days_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "facts")
    hours = spark.range(240).selectExpr("'a' AS k", "timestamp_seconds(id * 3600) AS ts", "to_date(timestamp_seconds(id * 3600)) AS d", "1.0D AS pm2_5", "2.0D AS pm10")
    hours.write.partitionBy("d").parquet(path)
    as_of = F.lit("1970-01-10 23:00:00").cast("timestamp")
    facts = spark.read.parquet(path)
    for cut in (
        A.bucket_aggregate(facts, "hour", ["k"], "ts", ["pm2_5", "pm10"], as_of, "24 HOURS", date_col="d"),
        latest(facts, ["k"], "ts", within="24 HOURS", as_of=as_of, date_col="d"),
    ):
        text = plan(cut)
        assert "PartitionFilters: []" not in text and "GreaterThanOrEqual(ts," in text


@pytest.mark.parametrize("value", ["101315 + id / 5000.0", "id * 4e-9", "CASE WHEN id = 0 THEN 1e12 ELSE 5 + id * 1e-9 END"])
def test_close_values_spread_over_cells(spark, value):
    df = spark.range(100_000).selectExpr("'g' AS g", f"CAST({value} AS DOUBLE) AS x")
    probs = {"a": 0.01, "b": 0.5, "c": 0.99}
    kept = Q.wanted_readings(df, ["g"], ["x"], probs)
    assert kept.groupBy("_cell", "_fine").count().agg(F.max("count")).first()[0] <= 500
    got = Q.exact_quantiles(df, ["g"], ["x"], probs).first()
    want = df.selectExpr(*[f"percentile(x, {p}) AS {n}" for n, p in probs.items()]).first()
    assert all(got[n] == pytest.approx(want[n], rel=1e-12) for n in probs)


def test_quantiles_of_infinite_and_equal_values(spark):
    df = spark.sql("SELECT * FROM VALUES (double('-inf')), (1.0D), (1.0D), (1.0D), (double('inf')), (null), (double('nan')) AS t(x)")
    got = Q.exact_quantiles(df, [], ["x"], {"low": 0.0, "mid": 0.5, "top": 1.0}).first()
    assert (got["mid"],) == (1.0,)
