"""Distribution scores, ensembles, as-of matches, file order, neighbours: against brute force."""

import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breezeline.operators import compare as C
from breezeline.operators import probabilistic as D
from breezeline.operators import spatial as S
from tests.helpers import START, TINY, to_spark

T0 = datetime(2024, 2, 1)


def test_crps_equals_the_score_over_all_member_pairs(spark):
    dice = random.Random(1)
    rows = [(i, [dice.choice([None, float("nan"), dice.gauss(0, 5)]) for _ in range(dice.randrange(0, 12))], dice.gauss(0, 5)) for i in range(60)]
    rows += [(100, [3.0], 1.0), (101, [2.0, 2.0], 2.0), (102, None, 1.0), (103, [1.0], None), (104, [None], 1.0)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, m array<double>, y double").select("i", D.crps("m", "y").alias("c")).collect()}
    for i, members, y in rows:
        known = [m for m in members or [] if m is not None and not math.isnan(m)]
        if not known or y is None:
            assert got[i] is None
            continue
        pairs = [abs(a - b) for a, b in itertools.product(known, known)]
        assert got[i] == pytest.approx(np.mean([abs(m - y) for m in known]) - np.mean(pairs) / 2, abs=1e-9)


def test_quantile_crps(spark):
    # many quantiles of a uniform distribution come near its exact score
    levels = [(i + 0.5) / 200 for i in range(200)]
    names = [f"q{i}" for i in range(200)]
    df = spark.createDataFrame([(0.3,), (0.9,)], "y double").select("y", *[F.lit(t).alias(n) for n, t in zip(names, levels)])
    for r in df.select("y", D.quantile_crps(names, levels, "y").alias("c")).collect():
        exact = (r["y"] ** 3 + (1 - r["y"]) ** 3) / 3
        assert r["c"] == pytest.approx(exact, abs=1e-4)
    with pytest.raises(ValueError):
        D.quantile_crps(["a", "b"], [0.9, 0.1], "y")


def test_weights_equal_a_grid_search(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(6):
        y = rng.normal(0, 10, 80)
        noise = rng.normal(0, 1, (80, 3)) @ rng.normal(0, 1, (3, 3)) * rng.uniform(0.3, 4, 3) + rng.normal(0, 2, 3)
        rows += [(f"k{k}", *map(float, y[i] + noise[i]), float(y[i])) for i in range(80)]
        grid = [(a / 200, b / 200, 1 - (a + b) / 200) for a in range(201) for b in range(201 - a)]
        m = noise.T @ noise / 80
        want[f"k{k}"] = (min(grid, key=lambda w: np.array(w) @ m @ np.array(w)), m)
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double")
    weights = D.ensemble_weights(df.union(spark.createDataFrame([("k0", None, 1.0, 1.0, 1.0)], df.schema)), ["k"], ["a", "b", "c"], "y")
    for r in weights.collect():
        w = np.array([r["weights"][m] for m in "abc"])
        near, m = want[r["k"]]
        assert w.sum() == pytest.approx(1) and (w >= 0).all() and np.abs(w - near).max() < 0.02
        assert w @ m @ w <= np.array(near) @ m @ np.array(near) + 1e-9
    # a member without data, members that all agree, one member
    assert D.simplex_weights(np.ones((3, 3))).sum() == pytest.approx(1) and D.simplex_weights(np.eye(1)).tolist() == [1.0]
    assert D.simplex_weights(np.diag([1.0, 3.0])).tolist() == pytest.approx([0.75, 0.25])


def test_weights_of_missing_members_go_to_the_others(spark):
    df = spark.createDataFrame([("k", 1.0, 3.0, 9.0), ("k", None, 3.0, 9.0), ("k", None, None, 9.0), ("k", None, None, None), ("z", 1.0, 3.0, None)], "k string, a double, b double, c double")
    weights = spark.createDataFrame([("k", {"a": 0.25, "b": 0.75, "c": 0.0})], "k string, weights map<string,double>")
    got = [r["combined"] for r in D.combined(df, weights, ["k"], ["a", "b", "c"]).orderBy("k", F.col("a").desc_nulls_last(), F.col("b").desc_nulls_last(), F.col("c").desc_nulls_last()).collect()]
    assert got == [2.5, 3.0, 9.0, None, 2.0]


def test_asof_nearest_equals_brute_force(spark):
    dice = random.Random(3)
    times = [T0 + timedelta(minutes=dice.randrange(0, 60 * 48)) for _ in range(300)]
    right = [(dice.choice("ab"), t, float(dice.randrange(9))) for t in times]
    left = [(dice.choice("abc"), T0 + timedelta(minutes=dice.randrange(-200, 60 * 48 + 200)), i) for i in range(300)] + [("a", None, 999), ("a", right[0][1], 998)]
    r = spark.createDataFrame(right, "k string, ts timestamp, v double")
    df = spark.createDataFrame(left, "k string, ts timestamp, i int")
    for tolerance in (0, 600, 7200):
        got = {x["i"]: (x["match_ts"], x["match_v"]) for x in C.asof_nearest(df, r, ["k"], "ts", ["v"], tolerance, block_seconds=3600).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            near = [(abs((u - t).total_seconds()), u, v) for kk, u, v in right if t is not None and kk == k and abs((u - t).total_seconds()) <= tolerance]
            assert got[i] == ((min(near)[1], min(near)[2]) if near else (None, None))


def test_year_over_year_over_leap_days_and_gaps(spark):
    days = [datetime(2023, 2, 27), datetime(2023, 2, 28), datetime(2023, 3, 1), datetime(2024, 2, 28), datetime(2024, 2, 29), datetime(2024, 3, 1), datetime(2024, 3, 9), datetime(2025, 2, 28)]
    df = spark.createDataFrame([("a", t, float(i)) for i, t in enumerate(days)] + [("a", datetime(2024, 3, 2), None)], "k string, ts timestamp, v double")
    got = {r["ts"]: r for r in C.year_over_year(df, ["k"], "ts", "v", tolerance_seconds=3600).collect()}
    assert {t: r["before_ts"] for t, r in got.items()} == {
        days[0]: None, days[1]: None, days[2]: None, days[3]: days[1], days[4]: days[1], days[5]: days[2], days[6]: None, days[7]: days[3]
    }
    assert got[days[3]]["change"] == 2.0 and got[days[3]]["change_pct"] == 200.0


def test_a_swapped_pair_across_a_split_edge_is_found(spark, tmp_path):
    lines = [f"{(datetime(2026, 1, 1) + timedelta(minutes=i)).isoformat()}" for i in range(2000)]
    size = len(lines[0]) + 1
    cut = 50 * size  # bytes of a split; the edge falls between two lines
    swapped = list(lines)
    swapped[499], swapped[500] = swapped[500], swapped[499]
    (tmp_path / "good.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "bad.csv").write_text("\n".join(swapped) + "\n")
    (tmp_path / "gaps.csv").write_text("\n".join([lines[5], "", lines[7], "x", lines[6], lines[1]]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = spark.read.schema("t timestamp").csv(str(tmp_path))
        assert read.rdd.getNumPartitions() >= 40
        got = {r["file"].rsplit("/", 1)[1]: r for r in C.order_check(read, "t").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert set(got) == {"good.csv", "bad.csv", "gaps.csv"}
    assert got["good.csv"]["ordered"] and got["good.csv"]["rows"] == 2000 and got["good.csv"]["row"] is None
    bad = got["bad.csv"]
    assert not bad["ordered"] and bad["row"] == 501 and bad["time"].isoformat() == lines[499] and bad["time_before"].isoformat() == lines[500]
    assert (got["gaps.csv"]["row"], got["gaps.csv"]["time"].isoformat()) == (4, lines[6])


def test_neighbours_equal_brute_force_over_poles_and_date_line(spark):
    dice = random.Random(6)
    places = [(i, dice.uniform(-90, 90), dice.uniform(-180, 180)) for i in range(150)]
    places += [(200, 89.5, 10.0), (201, 89.5, -170.0), (202, 0.0, 179.9), (203, 0.0, -179.9), (204, 0.0, 179.9), (205, None, 1.0)]
    df = spark.createDataFrame(places, "k int, lat double, lon double")

    def km(a, b):
        p, q, r, s = map(math.radians, (*a, *b))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    for radius in (150.0, 2000.0, 12000.0):
        got = {(r["k"], r["neighbour"]): r["km"] for r in S.neighbour_pairs(df, "k", "lat", "lon", radius).collect()}
        want = {(a, b): km(p, q) for a, *p in places for b, *q in places if a != b and None not in (*p, *q) and km(p, q) <= radius}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-3 for x in want)


def test_a_planted_outlier_is_flagged_and_a_rise_of_the_area_is_not(spark):
    rng = np.random.default_rng(7)
    hours, stations = 200, ["a", "b", "c", "d", "e"]
    level = 50 + 10 * np.sin(np.arange(hours) / 4)
    level[120:130] += 300  # the whole area
    rows = []
    for i, k in enumerate(stations):
        x = level + 5 * i + rng.normal(0, 1, hours)
        if k == "c":
            x[80] += 25
        rows.append(pd.DataFrame({"k": k, "ts": START + pd.to_timedelta(np.arange(hours), unit="h"), "x": x}))
    rows.append(pd.DataFrame({"k": "alone", "ts": [START], "x": [1.0]}))
    places = spark.createDataFrame([(k, 10.0 + i / 100, 20.0) for i, k in enumerate(stations)] + [("alone", -60.0, 0.0)], "k string, lat double, lon double")
    got = S.neighbour_residuals(to_spark(spark, pd.concat(rows)), TINY, places, "x", "lat", "lon", 50.0).toPandas()
    assert len(got) == hours * 5 + 1 and got[got["k"] == "alone"]["outlier"].isna().all()
    at = lambda k, h: got[(got["k"] == k) & (got["ts"] == START + pd.Timedelta(hours=h))].iloc[0]
    assert at("c", 80)["outlier"] and at("c", 80)["tail"] < 1e-6
    rise = got[got["ts"].between(START + pd.Timedelta(hours=120), START + pd.Timedelta(hours=129))]
    assert rise["outlier"].astype(float).mean() < 0.2 and (rise["tail"].dropna() > 1e-6).all()
    assert at("a", 0)["residual"] != at("a", 0)["residual"]  # no rows before


def test_tails_and_dominant_metrics(spark):
    z = [0.0, 0.5, 1.0, 1.959964, 3.0, -2.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(S.normal_tail(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], abs=3e-7)
    df = spark.createDataFrame([(1, 10.0, 30.0), (2, 20.0, 30.0), (3, None, 1.0), (4, None, None), (5, float("nan"), None), (6, 1.0, 2.0)], "i int, b double, a double")
    most = {r["i"]: (r["m"] or (None, None)) for r in df.select("i", C.dominant_metric({"b": 10.0, "a": 20.0}).alias("m")).collect()}
    assert {i: tuple(m) for i, m in most.items()} == {1: ("a", 1.5), 2: ("b", 2.0), 3: ("a", 0.05), 4: (None, None), 5: (None, None), 6: ("a", 0.1)}
