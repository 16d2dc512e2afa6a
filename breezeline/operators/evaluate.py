"""Forecast metrics, verification summaries, drift and model comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.functions.numeric import round_half_away
from breezeline.functions.text import model_phase
from breezeline.operators.rank import best_by

DRIFT_LIMIT_PCT = 15.0


def regression_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """rmse, mae and flat r2 per group over rows with both values.

    The total sum of squares comes from the population variance, which Spark merges
    across partial aggregates without cancellation."""
    d = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(predicted) - F.col(actual)
    return (
        d.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            F.sum(e * e).alias("_sse"),
            F.var_pop(actual).alias("_var"),
        )
        .withColumn("r2", 1.0 - F.col("_sse") / F.nullif(F.col("_var") * F.col("n"), F.lit(0.0)))
        .drop("_sse", "_var")
    )


def horizon_r2(df: DataFrame, keys: Sequence[str], horizon: str, actual: str, predicted: str) -> DataFrame:
    """R2 per horizon step, averaged with equal weight."""
    per = regression_metrics(df, [*keys, horizon], actual, predicted)
    return per.groupBy(*keys).agg(F.avg("r2").alias("r2_uniform"), F.count(F.lit(1)).alias("horizons"))


def mase(errors: DataFrame, scale: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Mean absolute error over the seasonal naive scale; zero scale gives infinity."""
    err = errors.groupBy(*keys).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"))
    ratio = F.when(F.col("scale") == 0, F.lit(float("inf"))).otherwise(F.col("mae") / F.col("scale"))
    return err.join(scale, list(keys)).withColumn("mase", ratio)


def pinball(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, q: float) -> DataFrame:
    if not 0 < q < 1:
        raise ValueError("quantile must lie between 0 and 1")
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.avg(F.greatest(q * e, (q - 1) * e)).alias("pinball"))


def coverage(df: DataFrame, keys: Sequence[str], actual: str, lower: str, upper: str) -> DataFrame:
    inside = F.col(actual).between(F.col(lower), F.col(upper))
    return df.groupBy(*keys).agg(F.avg(inside.cast("int")).alias("coverage"))


def mape(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Zero actuals are left out; a group with none left scores 0."""
    a, p = F.col(actual), F.col(predicted)
    share = F.when(a != 0, F.abs(p - F.abs(a)) / F.abs(a))
    return df.groupBy(*keys).agg(
        F.coalesce(100.0 * F.avg(share), F.lit(0.0)).alias("mape"), F.count(F.lit(1)).alias("n")
    )


def drift_decision(
    forecasts: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str],
    ts: str,
    actual: str,
    predicted: str,
    limit: float = DRIFT_LIMIT_PCT,
) -> DataFrame:
    """Per series: retrain above the limit, keep below, skip without overlap."""
    joined = forecasts.join(actuals, [*keys, ts]).dropna(subset=[actual, predicted])
    scored = mape(joined, keys, actual, predicted)
    decision = (
        F.when(F.col("mape").isNull(), "skip").when(F.col("mape") > limit, "retrain").otherwise("keep")
    )
    return (
        forecasts.select(*keys)
        .distinct()
        .join(scored, list(keys), "left")
        .withColumn("decision", decision)
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def forecast_accuracy(verified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, verified, mean and spread of the absolute error, variation in percent."""
    e = F.col("absolute_error")
    return verified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_forecasts"),
        F.count("verified_at").alias("verified_forecasts"),
        round_half_away(F.avg(e), 2).alias("mae_aqi"),
        round_half_away(F.stddev_samp(e), 2).alias("stddev_error"),
        round_half_away(F.stddev_samp(e) / F.nullif(F.avg(e), F.lit(0.0)) * 100.0, 2).alias("cv_pct"),
        F.max("verified_at").alias("last_verified_at"),
    )


def usable(rows: DataFrame) -> DataFrame:
    """Finished rows with a number to compare."""
    return rows.where((F.col("status") == "ok") & F.col("rmse").isNotNull() & ~F.isnan("rmse"))


def best_per_city(rows: DataFrame) -> DataFrame:
    return best_by(rows.where("status = 'ok'"), ["city"], "rmse", [F.col("model")])


def best_per_phase(rows: DataFrame) -> DataFrame:
    return best_by(usable(rows), ["phase"], "rmse", [F.col("city"), F.col("model")])


def overall_top(rows: DataFrame, k: int = 5) -> DataFrame:
    return usable(rows).orderBy(F.col("rmse"), F.col("city"), F.col("model")).limit(k)


def fastest(rows: DataFrame, k: int = 3) -> DataFrame:
    return (
        rows.where("train_seconds is not null")
        .orderBy(F.col("train_seconds"), F.col("city"), F.col("model"))
        .limit(k)
    )


def mean_rmse(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return usable(rows).groupBy(*by).agg(F.avg("rmse").alias("mean_rmse"))


def rmse_matrix(rows: DataFrame, cities: Sequence[str]) -> DataFrame:
    """Mean RMSE per model with one column per named city."""
    return usable(rows).groupBy("model").agg(
        *[F.avg(F.when(F.col("city") == c, F.col("rmse"))).alias(c) for c in cities]
    )


def comparison_table(rows: DataFrame) -> DataFrame:
    """Phase label and rounded cells, sorted by RMSE."""
    return (
        usable(rows)
        .select(
            "model",
            model_phase("model").alias("phase_label"),
            *[F.round(c, 2).alias(c) for c in ("rmse", "mae")],
            F.round("r2", 3).alias("r2"),
        )
        .orderBy(F.col("rmse"), F.col("model"))
    )


def comparison_report(rows: DataFrame, k: int = 5) -> DataFrame:
    """Best row of each phase and the overall leaders as one tagged table."""
    cols = ["city", "phase", "model", "rmse"]
    phase = best_per_phase(rows).select(F.lit("best_of_phase").alias("section"), *cols)
    lead = overall_top(rows, k).select(F.lit("overall_top").alias("section"), *cols)
    return phase.unionByName(lead)


def metrics_table(rows: DataFrame, order: Sequence[str] = ("city", "status", "rmse", "model")) -> DataFrame:
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order])
