import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeline.operators import blocks as B
from breezeline.operators import features as X
from breezeline.operators.rank import first_per_key, rank_by_value
from tests.helpers import TINY, collected, random_series, same, to_spark


def test_positions_count_rows_across_blocks(spark):
    pdf = random_series(1, gappy=True)
    got = collected(B.with_positions(to_spark(spark, pdf), TINY))
    want = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    assert (got["_pos"] == want.groupby("k").cumcount()).all()
    assert (got["_len"] == want.groupby("k")["ts"].transform("size")).all()


@pytest.mark.parametrize("gappy", [False, True])
def test_frames_longer_than_a_block(spark, gappy):
    pdf = random_series(2, gappy=gappy)
    d = X.feature_frame(
        to_spark(spark, pdf), TINY, ["x"], (1, 3, 12), (3, 12), (3,), 12, "x", (1, 7), with_calendar=False
    )
    got = collected(d)
    want = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    g = want.groupby("k")["x"]
    for lag in (1, 3, 12):
        want[f"x_lag_{lag}h"] = g.shift(lag)
    for w in (3, 12):
        want[f"x_roll_{w}h"] = g.transform(lambda v, w=w: v.rolling(w, min_periods=1).mean())
    want["x_std_3h"] = g.transform(lambda v: v.rolling(3, min_periods=1).std())
    want["x_delta_12h"] = want["x"] - g.shift(12)
    for h in (1, 7):
        want[f"x_h{h}"] = g.shift(-h)
    same(got, want, [c for c in got.columns if c.startswith("x")])


def test_no_window_group_is_larger_than_block_and_halo(spark):
    """One series holds nearly all rows; it must not end in one window group."""
    pdf = random_series(3, n=400, series=("hot",))
    d = B.with_positions(to_spark(spark, pdf), TINY)
    spread = d.select(
        F.explode(
            F.sequence(
                F.floor(F.greatest(F.col("_pos"), F.lit(0)) / TINY.block_rows),
                F.floor(F.least(F.col("_pos") + 3, F.col("_len") - 1) / TINY.block_rows),
            )
        ).alias("host")
    )
    assert spread.groupBy("host").count().agg(F.max("count")).first()[0] <= TINY.block_rows + 3


def test_nearest_readings(spark):
    pdf = random_series(4)
    got = collected(B.neighbours(to_spark(spark, pdf), TINY, ["x", "y"]))
    want = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    for c in ("x", "y"):
        want[f"_pv_{c}"] = want.groupby("k")[c].ffill()
        want[f"_nv_{c}"] = want.groupby("k")[c].bfill()
    same(got, want, ["_pv_x", "_nv_x", "_pv_y", "_nv_y"])


def test_global_rank_without_one_big_window(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i:04d}", None if v < 0.3 else float(int(v * 5))) for i, v in enumerate(rng.random(500))]
    df = spark.createDataFrame(rows, "city_slug string, v double").repartition(7)
    got = {r["city_slug"]: r["rank"] for r in rank_by_value(df, "v", "city_slug").collect()}
    want = sorted(rows, key=lambda r: (-(r[1] or 0.0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}


def test_first_per_key_prunes_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 9 == 0, "cold").otherwise("hot").alias("k"), "id")
    d = first_per_key(df, ["k"], [F.col("id").desc()])
    assert sorted(r["id"] for r in d.collect()) == [9998, 9999]
    assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()


def test_split_and_windows_stay_inside_their_part(spark):
    pdf = random_series(6, nulls=0.0)
    split = X.chronological_split(to_spark(spark, pdf), TINY, keep_helpers=True)
    w = X.supervised_windows(split, TINY, ["x"], "x", 6, 2).collect()
    want = pdf.sort_values(["k", "ts"])
    n = 0
    for k, g in want.groupby("k"):
        x = g["x"].to_numpy()
        a, b = int(len(x) * 0.7), int(len(x) * (0.7 + 0.15))
        for name, part in (("train", x[:a]), ("val", x[a:b]), ("test", x[b:])):
            mine = {r["window_index"]: r for r in w if r["k"] == k and r["split"] == name}
            count = max(len(part) - 8 + 1, 0)
            assert sorted(mine) == list(range(count))
            for i, r in mine.items():
                assert [e["x"] for e in r["x"]] == list(part[i : i + 6])
                assert r["y"] == list(part[i + 6 : i + 8])
            n += count
    assert n == len(w)


@pytest.mark.parametrize("n,k", [(50, 7), (50, 49), (10, 30), (997, 100), (5, 1)])
def test_limited_windows_are_linspace_indices(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("window_index"), F.lit(n).cast("long").alias("window_count"))
    got = sorted(r[0] for r in X.limit_windows(df, k).select("window_index").collect())
    want = list(range(n)) if n <= k else sorted(set(np.linspace(0, n - 1, k, dtype=int).tolist()))
    assert got == want
