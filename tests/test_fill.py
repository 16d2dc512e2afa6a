import numpy as np
import pandas as pd
import pytest

from breezeline.operators import fill as G
from breezeline.operators.grid import bucket_mean, regular_grid
from breezeline.operators.quantiles import exact_quantiles
from tests.helpers import TINY, START, collected, random_series, same, to_spark

COLS = ["x", "y"]


def per_series(pdf, fn):
    want = pdf.sort_values(["k", "ts"]).reset_index(drop=True)
    for c in COLS:
        want[c] = want.groupby("k")[c].transform(fn)
    return want


CASES = {
    "ffill": (lambda d, s: G.forward_fill(d, s, COLS), lambda v: v.ffill()),
    "ffill2": (lambda d, s: G.forward_fill(d, s, COLS, 2), lambda v: v.ffill(limit=2)),
    "bfill": (lambda d, s: G.backward_fill(d, s, COLS), lambda v: v.bfill()),
    "bfill3": (lambda d, s: G.backward_fill(d, s, COLS, 3), lambda v: v.bfill(limit=3)),
    "linear": (lambda d, s: G.interpolate(d, s, COLS), lambda v: v.interpolate()),
    "linear4": (lambda d, s: G.interpolate(d, s, COLS, 4), lambda v: v.interpolate(limit=4)),
    "both": (lambda d, s: G.interpolate(d, s, COLS, None, True), lambda v: v.interpolate(limit_direction="both")),
    "both3": (
        lambda d, s: G.interpolate(d, s, COLS, 3, True),
        lambda v: v.interpolate(limit=3, limit_direction="both"),
    ),
    "center": (
        lambda d, s: G.centered_mean_fill(d, s, COLS),
        lambda v: v.fillna(v.rolling(10, center=True, min_periods=1).mean()),
    ),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("seed", [11, 12])
def test_fills_agree_with_pandas(spark, name, seed):
    ours, theirs = CASES[name]
    pdf = random_series(seed)
    same(collected(ours(to_spark(spark, pdf), TINY)), per_series(pdf, theirs), COLS)


def test_long_gap_examples(spark):
    n = np.nan
    x = [n, n, 1.0] + [n] * 8 + [10.0, n, n]
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(range(14), unit="h"), "x": x})
    one = collected(G.interpolate(to_spark(spark, pdf), TINY, ["x"], 6))["x"].tolist()
    assert np.isnan(one[:2]).all() and one[2:9] == [1, 2, 3, 4, 5, 6, 7] and np.isnan(one[9:11]).all()
    assert one[11:] == [10, 10, 10]
    both = collected(G.interpolate(to_spark(spark, pdf), TINY, ["x"], 6, True))["x"]
    assert both.notna().all()


def test_gaps_are_runs_of_missing_rows(spark):
    n = np.nan
    x = [n, n, 1.0, n, n, n, n, n, n, 4.0, n]
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(range(11), unit="h"), "x": x})
    got = G.gaps(to_spark(spark, pdf), TINY, ["x"]).orderBy("gap_start").collect()
    assert [r["gap_rows"] for r in got] == [2, 6, 1]


def strict_grid(pdf):
    out = []
    for k, g in pdf.groupby("k"):
        r = g.set_index("ts")[COLS].resample("1h").asfreq().reset_index()
        r.insert(0, "k", k)
        out.append(r)
    return pd.concat(out, ignore_index=True)


def test_grid_takes_only_readings_on_the_step(spark):
    pdf = random_series(21, gappy=True)
    off = pdf.iloc[::9].assign(ts=lambda d: d["ts"] + pd.Timedelta(minutes=20))
    got = collected(regular_grid(to_spark(spark, pd.concat([pdf, off])), TINY, COLS))
    want = strict_grid(pdf)
    last = pdf.groupby("k")["ts"].max()
    assert (got.groupby("k")["ts"].max() == last).all()
    same(got, want, COLS)
    assert (got["_pos"] == got.groupby("k").cumcount()).all()


def test_impute_for_benchmark(spark):
    pdf = random_series(31, n=160, gappy=True)

    def fill(v):
        v = v.interpolate(limit=6, limit_direction="both").ffill(limit=24).bfill(limit=24)
        return v.fillna(v.median())

    want = per_series(strict_grid(pdf), fill)
    same(collected(G.impute_for_benchmark(to_spark(spark, pdf), TINY, COLS)), want, COLS)


def test_impute_for_training(spark):
    pdf = random_series(32, n=160, gappy=True)
    pdf.loc[pdf["ts"] > pdf["ts"].max() - pd.Timedelta(hours=70), "y"] = np.nan
    want = strict_grid(pdf)
    for c in COLS:
        g = want.groupby("k")[c]
        want[c] = g.transform(lambda v: v.interpolate(limit=6).ffill(limit=24).bfill())
        by_month = want.groupby(["k", want["ts"].dt.month])[c].transform("median")
        want[c] = want[c].fillna(by_month)
        want[c] = want[c].fillna(want.groupby("k")[c].transform("median"))
    same(collected(G.impute_for_training(to_spark(spark, pdf), TINY, COLS)), want, COLS)


@pytest.mark.parametrize("n", [3, 4, 9, 120])
def test_clean_sensor_feed(spark, n):
    """Also on very short series, where both caps touch the same readings."""
    pdf = random_series(33, n=n, nulls=0.3)

    def clean(v):
        if v.isna().all():
            return v
        v = v.clip(v.quantile(0.01), v.quantile(0.99))
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        v = v.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        miss = v.isna()
        run = (miss != miss.shift()).cumsum()
        lengths = miss.groupby(run).sum()
        if ((lengths > 0) & (lengths <= 3)).any():
            v = v.interpolate(limit=3, limit_direction="both")
        return v.ffill().bfill()

    cleaned = per_series(pdf, clean)
    want = []
    for k, g in cleaned.groupby("k"):
        r = g.set_index("ts")[COLS].resample("2h").mean().reset_index()
        r.insert(0, "k", k)
        want.append(r)
    want = pd.concat(want, ignore_index=True)
    got = collected(G.clean_sensor_feed(to_spark(spark, pdf), TINY, COLS, bucket_seconds=7200))
    same(got, want, COLS)


def test_bucket_mean_keeps_empty_bins(spark):
    pdf = random_series(34, gappy=True)
    got = collected(bucket_mean(to_spark(spark, pdf), TINY, COLS, 7200))
    want = []
    for k, g in pdf.groupby("k"):
        r = g.set_index("ts")[COLS].resample("2h").mean().reset_index()
        r.insert(0, "k", k)
        want.append(r)
    same(got, pd.concat(want, ignore_index=True), COLS)


def test_exact_quantiles_on_ties_outliers_and_signs(spark):
    rng = np.random.default_rng(41)
    groups = {
        "ties": np.repeat([1.0, 2.0, 2.0, 3.0], 50),
        "outlier": np.append(rng.normal(0, 1e-3, 200), [1e12, -1e12]),
        "narrow": 1e6 + rng.random(300) * 1e-3,
        "one": np.array([4.2]),
        "signs": rng.normal(0, 100, 501),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": START, "x": v}) for k, v in groups.items()])
    probs = {"a": 0.01, "q": 0.25, "m": 0.5, "z": 0.99}
    got = {r["k"]: r for r in exact_quantiles(to_spark(spark, pdf), ["k"], ["x"], probs).collect()}
    for k, v in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


def test_whole_column_missing_stays_missing(spark):
    pdf = random_series(35).assign(y=np.nan)
    got = collected(G.winsorize(to_spark(spark, pdf), TINY, COLS))
    assert got["y"].isna().all() and got["x"].notna().any()
