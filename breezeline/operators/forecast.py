"""Baselines, direct multi-horizon regression, vector autoregression, forecast rows."""

from __future__ import annotations

import itertools
import json
import math
import random
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from breezeline.functions.bands import confidence_from_rmse
from breezeline.functions.numeric import clip
from breezeline.functions.text import baseline_forecast_id, benchmark_forecast_id, title_case
from breezeline.operators.blocks import Series
from breezeline.operators.evaluate import best_per_city, regression_metrics
from breezeline.operators.features import RATIOS, chronological_split, feature_frame, tail
from breezeline.schema import BENCHMARK_SUMMARY
from breezeline.session import materialise


def recent_trend(df: DataFrame, s: Series, target: str, rows: int = 24) -> DataFrame:
    """Last value and mean step over the newest ``rows`` rows of each series."""
    w = Window.partitionBy(*s.keys).orderBy(s.ts)  # at most `rows` rows per series here
    return (
        tail(df, s, rows)
        .withColumn("_d", F.col(target) - F.lag(target).over(w))
        .groupBy(*s.keys)
        .agg(
            F.max_by(target, s.ts).alias("current"),
            F.coalesce(F.avg("_d"), F.lit(0.0)).alias("trend"),
            F.max(s.ts).alias("last_ts"),
            F.count(F.lit(1)).alias("history"),
        )
    )


def hours_after(ts: str | Column, hour: Column) -> Column:
    base = F.col(ts) if isinstance(ts, str) else ts
    return base + F.make_dt_interval(F.lit(0), hour)


def baseline_forecast(
    df: DataFrame, s: Series, target: str, horizon: int = 24, with_trend: bool = True, rows: int = 24,
    need: int = 24,
) -> DataFrame:
    """Persistence (plus mean step per hour), clipped to 0..500, one row per hour ahead.
    Series with less history than ``need`` are left to ``too_short``."""
    base = recent_trend(df, s, target, rows).where(F.col("history") >= need)
    drift = F.col("trend") if with_trend else F.lit(0.0)
    return base.withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        *s.keys,
        "last_ts",
        "horizon_hours",
        hours_after("last_ts", F.col("horizon_hours")).alias("horizon_timestamp"),
        clip(F.col("current") + drift * F.col("horizon_hours"), 0.0, 500.0).alias("predicted"),
    )


def forecast_rows(
    predictions: DataFrame,
    issued: Column,
    model: str | Column,
    version: str,
    rmse: Column | None = None,
    confidence: Column | None = None,
    baseline_ids: bool = False,
    slug: str = "city_slug",
) -> DataFrame:
    """Predictions to rows of the forecast table."""
    conf = confidence if confidence is not None else confidence_from_rmse(rmse)
    hour = F.col("horizon_hours")
    model = F.lit(model) if isinstance(model, str) else model
    if baseline_ids:
        key = baseline_forecast_id(F.col(slug), issued, hour)
    else:
        key = benchmark_forecast_id(F.col(slug), model, issued, hour)
    return predictions.select(
        key.alias("forecast_id"),
        F.col(slug).alias("city_slug"),
        title_case(F.replace(F.col(slug), F.lit("_"), F.lit(" "))).alias("city_name"),
        issued.alias("forecast_timestamp"),
        "horizon_timestamp",
        hour.cast("int").alias("horizon_hours"),
        F.col("predicted").alias("predicted_us_aqi"),
        model.alias("model_type"),
        F.lit(version).alias("model_version"),
        conf.alias("confidence"),
    )


# Settings of the tree-ensemble specs; each boosted name has its own.  Spark
# bounds trees by depth: 31 leaves stand as depth 5, unbounded trees as depth 12.
SPECS: dict[str, tuple[type, dict]] = {
    "random_forest": (RandomForestRegressor, {"numTrees": 180, "minInstancesPerNode": 2, "maxDepth": 12, "seed": 42}),
    "xgboost": (
        GBTRegressor,
        {"maxIter": 220, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42},
    ),
    "lightgbm": (
        GBTRegressor,
        {"maxIter": 260, "maxDepth": 5, "stepSize": 0.04, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42},
    ),
    "catboost": (GBTRegressor, {"maxIter": 220, "maxDepth": 5, "stepSize": 0.05, "seed": 42}),
    "linear": (LinearRegression, {}),
}
# Phase and family of the summary rows.
FAMILIES = {"linear": ("classical", "linear")} | {
    name: ("classical", "tree_ensemble") for name in ("random_forest", "xgboost", "lightgbm", "catboost")
}


class TooFewRows(ValueError):
    """No complete training row is left for a horizon."""


class NoEstimator(ValueError):
    """A spec that names no estimator."""


def estimator(name: str, **params):
    """The spec's estimator; ``params`` go over its settings."""
    if name not in SPECS:
        raise NoEstimator(f"no estimator for {name}")
    kind, settings = SPECS[name]
    return kind(**{**settings, **params})


def supervised_frame(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    target: str,
    horizons: Sequence[int],
    lags: Sequence[int] = (1, 2, 3, 6, 12, 24),
    rolling: Sequence[int] = (3, 6, 12, 24),
) -> tuple[DataFrame, list[str]]:
    """Lag features, targets and the chronological split, written once and reused by
    every fit (fits are iterative and must not redo the feature windows)."""
    split = chronological_split(df, s, keep_helpers=True)
    # The series enters as the mean of its own training target: works for any number of
    # series, where an index of their names would have to pass through the driver.
    level = split.where("split = 'train'").groupBy(*s.keys).agg(F.avg(target).alias("series_mean"))
    d = feature_frame(split.join(level, list(s.keys)), s, cols, lags, rolling, (), 24, target, horizons)
    names = [f"{c}_lag_{k}h" for c in cols for k in lags]
    names += [f"{c}_roll_{k}h" for c in cols for k in rolling]
    names += [f"{c}_delta_24h" for c in cols]
    names += ["hour", "day_of_week", "month", "series_mean", *cols]
    ratios = [name for name, pair in RATIOS.items() if set(pair) <= set(cols)]
    # a ratio over zero has no value; it enters as zero and drops no row
    d = d.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in ratios})
    names += ratios
    return materialise(d.dropna(subset=names)), names


def fit_direct(
    frame: DataFrame,
    s: Series,
    features: Sequence[str],
    target: str,
    horizons: Sequence[int],
    spec: str,
    train: Column | None = None,
    parallelism: int = 8,
    **params,
) -> dict[int, PipelineModel]:
    """One model per horizon over all series together; ``parallelism`` horizons are fitted side by side, so that the
    short jobs of one fit fill the gaps of another.

    Forecasting h hours ahead needs the target h rows later; training rows whose target
    lies past the split edge (``_to``, which the split has set) are dropped by requiring it
    inside the training part."""
    rows = frame.where("split = 'train'") if train is None else frame.where(train)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")

    def fit(h: int) -> PipelineModel:
        label = f"{target}_h{h}"
        safe = rows.where(F.col(label).isNotNull() & (F.col("_pos") + h < F.col("_to")))
        if safe.isEmpty():
            raise TooFewRows(f"no training row {h} rows ahead")
        model = estimator(spec, featuresCol="features", labelCol=label, predictionCol=f"pred_h{h}", **params)
        return Pipeline(stages=[assembler, model]).fit(safe)

    with ThreadPoolExecutor(max(1, min(parallelism, len(horizons)))) as pool:
        return dict(zip(horizons, pool.map(fit, horizons)))


def predict_direct(models: dict[int, PipelineModel], frame: DataFrame, s: Series, target: str) -> DataFrame:
    """Long rows: series, ts, horizon, actual, predicted."""
    base = [c for c in frame.columns]
    scored = frame
    for h, model in sorted(models.items()):
        scored = model.transform(scored).select(*base, *[f"pred_h{k}" for k in sorted(models) if k <= h])
    pairs = [
        F.struct(
            F.lit(h).alias("horizon_hours"),
            F.col(f"{target}_h{h}").alias("actual"),
            F.col(f"pred_h{h}").alias("predicted"),
        )
        for h in sorted(models)
    ]
    return scored.select(*s.keys, s.ts, "split", F.explode(F.array(*pairs)).alias("_p")).select(
        *s.keys, s.ts, "split", "_p.*"
    )


def search(
    frame: DataFrame,
    s: Series,
    features: Sequence[str],
    target: str,
    horizons: Sequence[int],
    spec: str,
    grid: dict[str, Sequence],
) -> list[dict]:
    """Try every point of the grid, best validation MSE first (chronological slice)."""
    trials = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        models = fit_direct(frame, s, features, target, horizons, spec, **params)
        scored = predict_direct(models, frame.where("split = 'val'"), s, target)
        rmse = regression_metrics(scored, [], "actual", "predicted").first()["rmse"]
        trials.append({**params, "val_mse": None if rmse is None else rmse**2})
    return sorted(trials, key=lambda t: (t["val_mse"] is None, t["val_mse"]))


# What the forest search draws from.
FOREST_RANGES = {"numTrees": ("int", 50, 300), "maxDepth": ("int", 5, 30), "minInstancesPerNode": ("int", 1, 10)}


def draw_trials(ranges: dict[str, tuple[str, float, float]], trials: int, seed: int) -> list[dict]:
    """``trials`` settings drawn from the ranges: ``int`` evenly from whole numbers, ``log_int`` and ``log`` evenly
    from orders of size. The same seed gives the same settings, and fewer trials are the first of more."""
    dice = random.Random(seed)
    out = []
    for _ in range(trials):
        drawn = {}
        for name, (kind, low, high) in ranges.items():
            if kind == "int":
                drawn[name] = dice.randint(int(low), int(high))
            elif kind in ("log", "log_int"):
                x = math.exp(dice.uniform(math.log(low), math.log(high)))
                drawn[name] = min(int(high), max(int(low), round(x))) if kind == "log_int" else x
            else:
                raise ValueError(f"no such range: {kind}")
        out.append(drawn)
    return out


def search_halving(
    frame: DataFrame,
    s: Series,
    features: Sequence[str],
    target: str,
    horizons: Sequence[int],
    spec: str,
    ranges: dict[str, tuple[str, float, float]] = FOREST_RANGES,
    trials: int = 20,
    shares: Sequence[float] = (1 / 9, 1 / 3, 1.0),
    keep: int = 3,
    seed: int = 42,
    parallelism: int = 4,
) -> list[dict]:
    """Random search with successive halving: every setting learns from the leading ``shares[0]`` of the training part,
    one in ``keep`` of them, the best on the validation part, from the next share, and so on; the last share is 1.

    Gives a row per setting and round in the order of rounds, best first: ``trial`` (its number), its parameters,
    ``round``, ``share``, ``val_mse`` (null where too few rows were left; such a setting comes last)."""
    if list(shares) != sorted(shares) or shares[-1] != 1.0:
        raise ValueError("shares must rise to 1")
    drawn = dict(enumerate(draw_trials(ranges, trials, seed)))
    val, alive, out = frame.where("split = 'val'"), list(drawn), []
    for turn, share in enumerate(shares):
        part = (F.col("split") == "train") & (F.col("_pos") < F.floor(F.col("_to") * F.lit(float(share))))

        def score(trial: int, part: Column = part) -> float | None:
            try:
                models = fit_direct(frame, s, features, target, horizons, spec, train=part, parallelism=1, **drawn[trial])
            except TooFewRows:
                return None
            scored = predict_direct(models, val, s, target)
            rmse = regression_metrics(scored, [], "actual", "predicted").first()["rmse"]
            return None if rmse is None else rmse**2

        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            errors = dict(zip(alive, pool.map(score, alive)))
        alive = sorted(alive, key=lambda t: (errors[t] is None, errors[t], t))
        out += [{"trial": t, **drawn[t], "round": turn, "share": share, "val_mse": errors[t]} for t in alive]
        if share < 1.0:
            alive = alive[: max(1, -(-len(alive) // keep))]
    return out


def fit_specs(
    frame: DataFrame,
    s: Series,
    features: Sequence[str],
    target: str,
    horizons: Sequence[int],
    specs: Sequence[str],
    city: str = "city_slug",
    params: dict[str, dict] | None = None,
) -> tuple[DataFrame, dict[str, dict[int, PipelineModel]]]:
    """Summary rows of every spec over every series of a supervised frame, and the models that were fitted.

    The loop is over specs: all series train and score together, and share the seconds it took. A spec without an
    estimator, or with too few rows, becomes skipped rows with the whole reason; any other failure (lost executors,
    memory, wrong columns) is one."""
    test = frame.where("split = 'test'")
    out, fitted = None, {}
    for spec in specs:
        phase, family = FAMILIES.get(spec, (None, None))
        try:
            start = time.perf_counter()
            models = fit_direct(frame, s, features, target, horizons, spec, **(params or {}).get(spec, {}))
            trained = time.perf_counter() - start
            scored = predict_direct(models, test, s, target)
            start = time.perf_counter()
            rows = materialise(regression_metrics(scored, list(s.keys), "actual", "predicted"))
            inferred = time.perf_counter() - start
            fitted[spec] = models
            rows = rows.withColumnRenamed(city, "city").withColumns({
                "status": F.lit("ok"),
                "train_seconds": F.lit(trained),
                "inference_seconds": F.lit(inferred),
                "reason": F.lit(None).cast("string"),
            })
        except (NoEstimator, TooFewRows) as problem:
            none = F.lit(None).cast("double")
            rows = frame.select(F.col(city).alias("city")).distinct().withColumns({
                "status": F.lit("skipped"),
                **dict.fromkeys(("rmse", "mae", "r2", "train_seconds", "inference_seconds"), none),
                "reason": F.lit(str(problem)),
            })
        rows = rows.withColumns({
            "model": F.lit(spec),
            "phase": F.lit(phase).cast("string"),
            "family": F.lit(family).cast("string"),
        })
        rows = rows.select(*[f.name for f in BENCHMARK_SUMMARY])
        out = rows if out is None else out.unionByName(rows)
    return out, fitted


def benchmark_matrix(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    target: str,
    horizons: Sequence[int],
    specs: Sequence[str],
    city: str = "city_slug",
    params: dict[str, dict] | None = None,
) -> DataFrame:
    """Every spec over every series, in the columns of a benchmark summary; see ``fit_specs``."""
    frame, features = supervised_frame(df, s, cols, target, horizons)
    return fit_specs(frame, s, features, target, horizons, specs, city, params)[0]


def predict_ahead(
    frame: DataFrame, s: Series, features: Sequence[str], fitted: dict[str, dict[int, PipelineModel]]
) -> DataFrame:
    """Series, last_ts, and ``_paths``: for each spec the predictions of its models from the newest row of the series.

    One row per series is left before any model runs; then all models of all specs score it in the same pass."""
    newest = frame.groupBy(*s.keys).agg(
        F.max(s.ts).alias("last_ts"), F.max_by(F.struct(*features), s.ts).alias("_f")
    ).select(*s.keys, "last_ts", "_f.*")
    scored = VectorAssembler(inputCols=list(features), outputCol="features").transform(newest).drop(*features)
    paths = []
    for i, (spec, models) in enumerate(fitted.items()):
        names = {h: f"_p{i}_h{h}" for h in sorted(models)}
        for h, name in names.items():
            model = models[h].stages[-1]
            scored = model.copy({model.predictionCol: name}).transform(scored)
        paths += [F.lit(spec), F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.col(n).alias("predicted")) for h, n in names.items()])]
    return scored.select(*s.keys, "last_ts", F.create_map(*paths).alias("_paths"))


def best_model_forecasts(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    target: str,
    horizons: Sequence[int],
    specs: Sequence[str],
    version: str,
    city: str = "city_slug",
    params: dict[str, dict] | None = None,
    issued: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The benchmark matrix and the forecast rows of each series by the model of least RMSE in it.

    A series in whose rows no spec has a finite RMSE gets no forecast; ``issued`` is the time in the rows (the newest
    row's where none is given)."""
    frame, features = supervised_frame(df, s, cols, target, horizons)
    matrix, fitted = fit_specs(frame, s, features, target, horizons, specs, city, params)
    matrix = materialise(matrix)
    if not fitted:
        none = frame.limit(0).select(*s.keys, F.col(s.ts).alias("last_ts"), F.lit(None).cast("double").alias("rmse"))
        empty = {"model": "string", "horizon_hours": "int", "predicted": "double"}
        picked = none.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()])
    else:
        best = best_per_city(matrix).select(F.col("city").alias(city), "model", "rmse")
        ahead = predict_ahead(frame, s, features, fitted).join(best, city)
        picked = ahead.select(*s.keys, "last_ts", "model", "rmse", F.inline(F.element_at("_paths", F.col("model"))))
    timed = picked.withColumn("horizon_timestamp", hours_after("last_ts", F.col("horizon_hours")))
    when = F.col("last_ts") if issued is None else issued
    return matrix, forecast_rows(timed, when, F.col("model"), version, rmse=F.col("rmse"), slug=city)


def learning_curve(
    frame: DataFrame,
    s: Series,
    features: Sequence[str],
    target: str,
    horizon: int,
    spec: str,
    fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0),
) -> DataFrame:
    """Validation score after training on growing leading shares of the training part."""
    out = None
    for share in fractions:
        part = (F.col("split") == "train") & (
            F.col("_pos") < F.floor(F.col("_to") * F.lit(float(share)))
        )
        score = ["n", "rmse", "mae", "r2"]
        try:
            models = fit_direct(frame, s, features, target, [horizon], spec, train=part)
            scored = predict_direct(models, frame.where("split = 'val'"), s, target)
            row = regression_metrics(scored, [], "actual", "predicted").select(*score)
        except TooFewRows:  # the smallest shares of short series
            row = frame.sparkSession.range(1).select(
                F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("double").alias(m) for m in score[1:]]
            )
        row = row.select(F.lit(float(share)).alias("fraction"), *score)
        out = row if out is None else out.unionByName(row)
    return out


def var_moments(df: DataFrame, s: Series, cols: Sequence[str], lags: int) -> tuple[np.ndarray, int]:
    """Cross products of (1, ``lags`` past values of every metric, the present values) over
    all complete rows, and their number.  Tasks hand on one small matrix each, whose size
    is set by metrics and lags alone."""
    past = [f"{c}_lag_{k}h" for k in range(1, lags + 1) for c in cols]
    d = feature_frame(df, s, cols, range(1, lags + 1), (), (), None, with_calendar=False)
    rows = d.select(*[F.col(c).cast("double").alias(c) for c in (*past, *cols)]).dropna()

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for frame in frames:
            x = np.column_stack([np.ones(len(frame)), frame.to_numpy(np.float64)])
            total = x.T @ x if total is None else total + x.T @ x
            n += len(frame)
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size + 1), "v": np.append(total.ravel(), n)})

    summed = rows.mapInPandas(products, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    values = [r["v"] for r in summed.orderBy("at").collect()]
    if not values:
        raise TooFewRows("no row has all its past values")
    side = 1 + len(past) + len(cols)
    return np.array(values[:-1]).reshape(side, side), int(values[-1])


def fit_var(
    df: DataFrame, s: Series, cols: Sequence[str], most_lags: int = 24
) -> tuple[list[list[float]], list[float], int]:
    """Least squares of every metric on past values of all metrics: a coefficient row
    (metric by metric, newest first) and an intercept per metric, and the number of lags,
    which is the one of least AIC up to ``most_lags``.

    All orders are compared on the same rows, those with ``most_lags`` past values, and
    read off one matrix of cross products."""
    k = len(cols)
    moments, n = var_moments(df, s, cols, most_lags)
    now = slice(1 + k * most_lags, None)
    best = None
    for lags in range(1, most_lags + 1):
        width = 1 + k * lags
        if n <= width:
            break
        past, cross = moments[:width, :width], moments[:width, now]
        fit = np.linalg.lstsq(past, cross, rcond=None)[0]
        rest = (moments[now, now] - cross.T @ fit - fit.T @ cross + fit.T @ past @ fit) / n
        aic = np.linalg.slogdet(rest + 1e-12 * np.eye(k))[1] + 2 * k * (k * lags + 1) / n
        if best is None or aic < best[0]:
            best = (aic, lags, fit)
    if best is None:
        raise TooFewRows(f"{n} complete rows are too few for {k} metrics")
    _, lags, fit = best
    rows = [[float(fit[1 + j * k + c, m]) for c in range(k) for j in range(lags)] for m in range(k)]
    return rows, [float(x) for x in fit[0]], lags


def forecast_var(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    coefficients: Sequence[Sequence[float]],
    intercepts: Sequence[float],
    lags: int,
    horizon: int,
) -> DataFrame:
    """Recursive forecast from the newest ``lags`` rows of each series.

    The state is the lag vector of one series; a fold over the hours steps it, so the
    recursion runs inside one row and no frame is chained ``horizon`` times."""
    state = tail(df.dropna(subset=list(cols)), s, lags)
    newest = state.groupBy(*s.keys).agg(
        F.max(s.ts).alias("last_ts"),
        F.reverse(F.sort_array(F.collect_list(F.struct(s.ts, *cols)))).alias("_h"),  # `lags` entries
    ).where(F.size("_h") == lags)
    flat = F.concat(*[F.col(f"_h.{c}") for c in cols])

    def predict(v: Column) -> Column:
        return F.array(
            *[
                sum(
                    (F.element_at(v, i + 1) * F.lit(b) for i, b in enumerate(row) if b != 0.0),
                    F.lit(a),
                )
                for row, a in zip(coefficients, intercepts)
            ]
        )

    def shift(v: Column, new: Column) -> Column:
        return F.concat(
            *[
                F.concat(F.array(F.element_at(new, j + 1)), F.slice(v, j * lags + 1, lags - 1))
                for j in range(len(cols))
            ]
        )

    start = F.struct(flat.alias("v"), F.array().cast("array<array<double>>").alias("out"))

    def advance(acc: Column, _hour: Column) -> Column:
        new = predict(acc["v"])
        return F.struct(shift(acc["v"], new).alias("v"), F.concat(acc["out"], F.array(new)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda acc: acc["out"])
    return newest.select(*s.keys, "last_ts", F.posexplode(path).alias("_i", "_v")).select(
        *s.keys,
        (F.col("_i") + 1).alias("horizon_hours"),
        hours_after("last_ts", F.col("_i") + 1).alias("horizon_timestamp"),
        *[F.element_at("_v", j + 1).alias(c) for j, c in enumerate(cols)],
    )


def save_model(model: PipelineModel, path: str, features: Sequence[str], metrics: dict) -> None:
    """Model plus a one-line metadata file next to it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    meta = json.dumps({"features": list(features), "metrics": metrics})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.getActiveSession()
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/meta").first()[0])
