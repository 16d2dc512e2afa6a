"""Streams matched with streams, against the batch join, and sessions against the batch gaps."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from breezeline.operators import evaluate as E
from breezeline.operators.fill import gaps
from breezeline.operators.grid import regular_grid
from breezeline.streaming import jobs as J
from breezeline.streaming import matching as M
from tests.helpers import TINY

START = datetime(2026, 1, 1)
FORECASTS = "k string, due timestamp, issued timestamp, p double"
ACTUALS = "k string, due timestamp, actual double"


def drain(spark, root, forecasts, actuals):
    """Append what arrived, drain it, give the pairs' query."""
    spark.createDataFrame(forecasts, FORECASTS).write.mode("append").parquet(f"{root}/f")
    spark.createDataFrame(actuals, ACTUALS).write.mode("append").parquet(f"{root}/a")
    f = J.file_stream(spark, f"{root}/f", spark.createDataFrame([], FORECASTS).schema, "parquet")
    a = J.file_stream(spark, f"{root}/a", spark.createDataFrame([], ACTUALS).schema, "parquet")
    pairs = M.matched_forecasts(f, a, ["k"], "due", "issued", "actual", "p", longest_hours=12, delay="2 hours")
    return M.run_matched_drift(pairs, f"{root}/state", f"{root}/out", ["k"], "actual", "p")


def test_matched_pairs_equal_the_batch_and_state_stays_flat(spark, tmp_path):
    dice, root = random.Random(4), str(tmp_path)
    forecasts, actuals, kept = [], [], []
    for day in range(6):
        fs, xs = [], []
        for hour in range(24):
            t = START + timedelta(days=day, hours=hour)
            for k in "ab":
                fs += [(k, t + timedelta(hours=h), t, 10.0 + dice.random()) for h in (1, 6, 12)]
                xs.append((k, t, dice.choice([0.0, 10.0, 12.0, None])))
        if day:  # readings up to two hours late, inside of the delay
            xs += [(k, START + timedelta(days=day, hours=-2), 11.0) for k in "ab"]
        query = drain(spark, root, fs, xs)
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        forecasts, actuals = forecasts + fs, actuals + xs
    assert max(kept[1:]) <= 1.1 * kept[1] and kept[1] < len(forecasts) / 2
    f, a = spark.createDataFrame(forecasts, FORECASTS), spark.createDataFrame(actuals, ACTUALS)
    want = {r["k"]: (r["n"], r["mape"]) for r in E.mape(f.join(a, ["k", "due"]).dropna(), ["k"], "actual", "p").collect()}
    got = {r["k"]: (r["n"], r["mape"]) for r in M.drift_so_far(spark, f"{root}/out", ["k"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    assert {r["decision"] for r in M.drift_so_far(spark, f"{root}/out", ["k"], limit=0.001).collect()} == {"retrain"}


def test_a_reading_beyond_the_bound_or_too_late_matches_nothing(spark, tmp_path):
    root = str(tmp_path)
    t = START
    drain(spark, root, [("a", t + timedelta(hours=13), t, 1.0), ("a", t - timedelta(hours=1), t, 1.0), ("a", t + timedelta(hours=2), t, None)],
          [("a", t + timedelta(hours=13), 1.0), ("a", t - timedelta(hours=1), 1.0), ("a", t + timedelta(hours=2), 1.0)])
    assert spark.read.schema("n long").parquet(f"{root}/out").count() == 0 if list(tmp_path.glob("out/*/*.parquet")) else True


def test_sessions_give_the_gaps_of_the_batch(spark, tmp_path):
    dice = random.Random(5)
    hours = [(k, START + timedelta(hours=h), 1.0) for k in "abc" for h in range(200) if dice.random() < 0.7]
    hours += [(k, START + timedelta(hours=h), 1.0) for k in "abc" for h in (0, 199)]
    schema = "k string, ts timestamp, x double"
    last = datetime(2026, 3, 1)
    for part in ([r for r in hours if r[1] < START + timedelta(hours=90)], [r for r in hours if r[1] >= START + timedelta(hours=90)], [("clock", last, 1.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = J.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "parquet")
        M.run_sessions(M.reading_sessions(stream, ["k"], "ts", 3600, "1 hour"), str(tmp_path / "s"), str(tmp_path / "o"), ["k"])
    got = M.outages(spark.read.parquet(str(tmp_path / "o")), ["k"], 3600).where("k <> 'clock'")
    readings = spark.createDataFrame(hours, schema).dropDuplicates(["k", "ts"])
    want = gaps(regular_grid(readings, TINY, ["x"]), TINY, ["x"]).select("k", "gap_start", "gap_end", F.col("gap_rows").cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30
