import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breezeline.operators import evaluate as E
from breezeline.operators import forecast as P
from breezeline.operators import scaling as Z
from breezeline.operators import serve as S
from breezeline.operators.features import chronological_split
from tests.helpers import START, TINY, collected, random_series, to_spark


def numpy_var(pdf, lags, most):
    """Coefficients (metric by metric, newest first) and AIC on the rows with ``most`` past ones."""
    rows, targets = [], []
    for _, g in pdf.groupby("k"):
        v = g[["x", "y"]].to_numpy()
        for i in range(most, len(v)):
            rows.append([1.0, *(v[i - j, c] for c in range(2) for j in range(1, lags + 1))])
            targets.append(v[i])
    rows, targets = np.array(rows), np.array(targets)
    beta, *_ = np.linalg.lstsq(rows, targets, rcond=None)
    rest = targets - rows @ beta
    return beta, np.linalg.slogdet(rest.T @ rest / len(rows))[1] + 2 * 2 * (2 * lags + 1) / len(rows)


def test_var_order_and_recursion_match_numpy(spark):
    pdf = random_series(51, n=120, nulls=0.0)
    rng = np.random.default_rng(1)
    pdf["x"] = rng.normal(0, 1, len(pdf))
    pdf["y"] = pdf["x"].shift(3).fillna(0) * 0.9 + rng.normal(0, 0.1, len(pdf))
    df = to_spark(spark, pdf)
    b, a, lags = P.fit_var(df, TINY, ["x", "y"], 6)
    want = min(range(1, 7), key=lambda p: numpy_var(pdf, p, 6)[1])
    assert lags == want >= 3
    beta, _ = numpy_var(pdf, lags, 6)
    np.testing.assert_allclose(a, beta[0], atol=1e-6)
    np.testing.assert_allclose(b, beta[1:].T, atol=1e-6)
    got = P.forecast_var(df, TINY, ["x", "y"], b, a, lags, 5).toPandas()
    for k, g in pdf.groupby("k"):
        h = [row for row in g[["x", "y"]].to_numpy()]
        for step in range(1, 6):
            z = np.array([1.0, *(h[-j][c] for c in range(2) for j in range(1, lags + 1))])
            h.append(z @ beta)
            mine = got[(got["k"] == k) & (got["horizon_hours"] == step)].iloc[0]
            np.testing.assert_allclose([mine["x"], mine["y"]], h[-1], atol=1e-5)
    with pytest.raises(P.TooFewRows):
        P.fit_var(df.where("x > 1e9"), TINY, ["x", "y"], 2)


def test_a_known_function_is_learned(spark):
    hours = np.arange(400)
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(hours, unit="h"), "x": 50 + 20 * np.sin(hours * np.pi / 12)})
    frame, names = P.supervised_frame(to_spark(spark, pdf), TINY, ["x"], "x", (1, 6))
    for spec, params, most in (("linear", {}, 0.01), ("random_forest", {"numTrees": 20}, 3.0), ("xgboost", {"maxIter": 20, "stepSize": 0.3}, 3.0)):
        models = P.fit_direct(frame, TINY, names, "x", (1, 6), spec, **params)
        scored = P.predict_direct(models, frame.where("split = 'test'"), TINY, "x").where("actual IS NOT NULL")
        assert E.regression_metrics(scored, [], "actual", "predicted").first()["rmse"] < most


def test_specs_have_their_own_settings_and_errors_are_not_swallowed(spark):
    assert P.estimator("xgboost").getMaxIter() == 220 and P.estimator("lightgbm").getMaxIter() == 260
    assert P.estimator("random_forest").getNumTrees() == 180 and P.estimator("linear", regParam=0.5).getRegParam() == 0.5
    pdf = random_series(57, n=60, nulls=0.0)
    with pytest.raises(Exception):
        P.benchmark_matrix(to_spark(spark, pdf), TINY, ["x"], "x", (1,), ["linear"], city="k", params={"linear": {"nope": 1}})
    frame, names = P.supervised_frame(to_spark(spark, pdf), TINY, ["x"], "x", (1,))
    with pytest.raises(P.TooFewRows):
        P.fit_direct(frame.where("1 = 0"), TINY, names, "x", (1,), "linear")


def test_training_rows_stop_at_the_split_that_was_made(spark):
    pdf = random_series(58, n=100, series=("a",), nulls=0.0)
    split = chronological_split(to_spark(spark, pdf), TINY, train=0.8, val=0.1, keep_helpers=True)
    frame = split.withColumn("x_h5", F.col("x"))
    rows = frame.where("split = 'train'").where(F.col("_pos") + 5 < F.col("_to"))
    assert rows.agg(F.max("_pos")).first()[0] == 74


def test_baseline_is_last_value_plus_mean_step(spark):
    pdf = random_series(52, n=40, nulls=0.0)
    got = P.baseline_forecast(to_spark(spark, pdf), TINY, "x", 3, rows=24).toPandas()
    for k, g in pdf.groupby("k"):
        t = g["x"].tail(24)
        want = [min(500, max(0, t.iloc[-1] + t.diff().mean() * h)) for h in (1, 2, 3)]
        np.testing.assert_allclose(got[got["k"] == k].sort_values("horizon_hours")["predicted"], want)


def test_short_series_are_reported_not_forecast(spark):
    pdf = random_series(53, n=10, series=("a",), nulls=0.0)
    df = to_spark(spark, pdf)
    assert P.baseline_forecast(df, TINY, "x").count() == 0
    assert Z.too_short(df, TINY, 24).first()["status"] == "insufficient_history"


def test_training_rows_do_not_see_past_the_split(spark):
    """A target that only changes after the split edge must not be learnt."""
    n = 100
    x = np.where(np.arange(n) < 70, 1.0, 1000.0)
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(range(n), unit="h"), "x": x})
    frame, names = P.supervised_frame(to_spark(spark, pdf), TINY, ["x"], "x", (5,), (1, 2), (3,))
    models = P.fit_direct(frame, TINY, names, "x", (5,), "random_forest", numTrees=3)
    scored = P.predict_direct(models, frame.where("split = 'train'"), TINY, "x")
    assert scored.agg(F.max("predicted")).first()[0] == pytest.approx(1.0)


def test_unknown_spec_becomes_a_skipped_row(spark):
    pdf = random_series(54, n=60, nulls=0.0)
    got = P.benchmark_matrix(to_spark(spark, pdf).drop("y"), TINY, ["x"], "x", (1,), ["nope", "linear"], city="k").collect()
    assert {r["status"] for r in got if r["model"] == "nope"} == {"skipped"}
    assert all(r["reason"] for r in got if r["model"] == "nope")
    assert {r["status"] for r in got if r["model"] == "linear"} == {"ok"}


def test_scalers(spark):
    pdf = random_series(55, nulls=0.2)
    pdf["y"] = 3.0
    df = to_spark(spark, pdf)
    fits = {kind: Z.fit_scaler(df, ["k"], ["x", "y"], kind) for kind in Z.KINDS}
    for k, g in pdf.groupby("k"):
        x = g["x"].dropna()
        want = {
            "standard": (x.mean(), x.std(ddof=0)),
            "minmax": (x.min(), x.max() - x.min()),
            "robust": (x.median(), x.quantile(0.75) - x.quantile(0.25)),
            "none": (0.0, 1.0),
        }
        for kind, (c, w) in want.items():
            r = fits[kind].where((F.col("k") == k) & (F.col("metric") == "x")).first()
            np.testing.assert_allclose([r["center"], r["width"]], [c, w])
            assert fits[kind].where((F.col("k") == k) & (F.col("metric") == "y")).first()["width"] == 1.0
    back = Z.invert_scaler(Z.apply_scaler(df, fits["robust"], ["k"], ["x"]), fits["robust"], ["k"], ["x"])
    np.testing.assert_allclose(collected(back)["x"], pdf.sort_values(["k", "ts"])["x"])


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([("z", 0.0, 1.0), ("a", 2.0, 1.0), ("a", 0.0, 5.0), ("a", 4.0, 4.0)], "k string, a double, p double")
    m = {r["k"]: r["mape"] for r in E.mape(df, ["k"], "a", "p").collect()}
    assert m == {"z": 0.0, "a": 25.0}
    scale = spark.createDataFrame([("a", 0.0)], "k string, scale double")
    assert E.mase(df, scale, ["k"], "a", "p").first()["mase"] == float("inf")
    r = {x["k"]: x for x in E.regression_metrics(df, ["k"], "a", "p").collect()}
    assert r["z"]["r2"] is None and r["a"]["rmse"] == pytest.approx(np.sqrt((1 + 25) / 3))
    with pytest.raises(ValueError):
        E.pinball(df, ["k"], "a", "p", 1.0)


def test_snapshot_slug_fallback(spark):
    pdf = random_series(56, n=30, series=("new_york_city", "b"), nulls=0.0).rename(columns={"k": "city_slug"})
    base = P.baseline_forecast(to_spark(spark, pdf.rename(columns={"city_slug": "k"})), TINY, "x", 2)
    docs = S.snapshot_documents(base.withColumnRenamed("k", "city_slug"), "gru", F.current_timestamp())
    rows = S.snapshot_timeline(docs)
    assert rows.count() == 2 * 3
    assert S.snapshot_for_city(rows, "b").count() == 3
    assert S.snapshot_for_city(rows, "new-york_city").count() == 3
    assert docs.first()["model_family"] == "DL Sequence"


def test_each_city_is_forecast_by_its_own_best_model(spark):
    """A rising line is best continued by the linear model, a chaotic map is learned by trees alone."""
    n, x, chaos = 600, 0.3, []
    rng = np.random.default_rng(5)
    for _ in range(n):
        chaos.append(2000 * x)
        x = 3.99 * x * (1 - x)
    line = 5000 + 40.0 * np.arange(n) + rng.normal(0, 0.5, n)
    ts = START + pd.to_timedelta(np.arange(n), unit="h")
    pdf = pd.concat([pd.DataFrame({"k": k, "ts": ts, "x": v}) for k, v in (("line", line), ("chaos", chaos))])
    specs, params = ["nope", "linear", "xgboost"], {"xgboost": {"maxIter": 30, "maxDepth": 7, "stepSize": 0.3}}
    df = to_spark(spark, pdf)
    matrix, rows = P.best_model_forecasts(df, TINY, ["x"], "x", (1, 2), specs, "v1", city="k", params=params)
    best = {r["city"]: r for r in E.best_per_city(matrix).collect()}
    assert {c: r["model"] for c, r in best.items()} == {"line": "linear", "chaos": "xgboost"}
    got = {(r["city_slug"], r["horizon_hours"]): r for r in rows.collect()}
    assert set(got) == {(k, h) for k in ("line", "chaos") for h in (1, 2)}
    # the same models scored on the newest row by the plain path
    frame, names = P.supervised_frame(df, TINY, ["x"], "x", (1, 2))
    last = pdf["ts"].max()
    for spec, city in (("linear", "line"), ("xgboost", "chaos")):
        models = P.fit_direct(frame, TINY, names, "x", (1, 2), spec, **params.get(spec, {}))
        want = P.predict_direct(models, frame.where(F.col("ts") == F.lit(last)), TINY, "x").where(F.col("k") == city)
        for w in want.collect():
            r = got[city, w["horizon_hours"]]
            assert r["predicted_us_aqi"] == pytest.approx(w["predicted"], rel=1e-6)
            assert r["model_type"] == spec and r["confidence"] == pytest.approx(max(0.05, min(0.99, 1 / (1 + best[city]["rmse"] / 100))))
            assert r["horizon_timestamp"].timestamp() == (last + pd.Timedelta(hours=r["horizon_hours"])).timestamp()
    none = P.best_model_forecasts(df, TINY, ["x"], "x", (1,), ["nope"], "v1", city="k")
    assert none[1].count() == 0 and {r["status"] for r in none[0].collect()} == {"skipped"}


def test_draws_are_seeded_and_within_their_ranges():
    ranges = {**P.FOREST_RANGES, "stepSize": ("log", 1e-3, 1.0), "maxBins": ("log_int", 2, 512)}
    many = P.draw_trials(ranges, 400, 7)
    assert P.draw_trials(ranges, 20, 7) == many[:20] != P.draw_trials(ranges, 20, 8)
    for name, (_, low, high) in ranges.items():
        values = [t[name] for t in many]
        assert min(values) >= low and max(values) <= high and len(set(values)) > 5
    assert 0.3 < np.mean([t["stepSize"] < 10**-1.5 for t in many]) < 0.7
    with pytest.raises(ValueError):
        P.draw_trials({"x": ("even", 1, 2)}, 1, 1)


def test_halving_keeps_the_setting_that_the_full_search_finds(spark):
    hours = np.arange(500)
    x = 50 + 20 * np.sin(hours * np.pi / 12) + np.random.default_rng(1).normal(0, 1, 500)
    pdf = pd.DataFrame({"k": "a", "ts": START + pd.to_timedelta(hours, unit="h"), "x": x})
    frame, names = P.supervised_frame(to_spark(spark, pdf), TINY, ["x"], "x", (1,))
    ranges = {"numTrees": ("int", 1, 12), "maxDepth": ("int", 1, 6)}
    full = P.search_halving(frame, TINY, names, "x", (1,), "random_forest", ranges, trials=6, shares=(1.0,), seed=3)
    halved = P.search_halving(frame, TINY, names, "x", (1,), "random_forest", ranges, trials=6, shares=(0.5, 1.0), keep=2, seed=3)
    assert [t["round"] for t in halved] == [0] * 6 + [1] * 3
    last = [t for t in halved if t["round"] == 1]
    assert last[0]["trial"] == full[0]["trial"] and last[0]["val_mse"] == pytest.approx(full[0]["val_mse"])
    assert [t["val_mse"] for t in last] == sorted(t["val_mse"] for t in last)
    assert {t["trial"] for t in last} == {t["trial"] for t in halved[:3]}
    few = P.search_halving(frame, TINY, names, "x", (1,), "random_forest", ranges, trials=2, shares=(0.001, 1.0), seed=3)
    assert [t["val_mse"] for t in few[:2]] == [None, None] and few[2]["val_mse"] is not None
