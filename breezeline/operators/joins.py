"""Catalogue look-ups, integrity checks, fuzzy matching, forecast verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich_from_catalog(facts: DataFrame, catalog: DataFrame, slug: str = "city_slug") -> DataFrame:
    """Left join on the normalised slug; unknown series keep their own slug and get
    country ``Unknown``.  ``catalog`` carries warehouse_slug, url_slug, country."""
    cat = catalog.select(
        F.col("warehouse_slug").alias("_ws"), F.col("url_slug").alias("_us"), F.col("country").alias("_country")
    )
    return (
        facts.join(cat, F.col(slug) == F.col("_ws"), "left")
        .withColumn("display_slug", F.coalesce("_us", F.col(slug)))
        .withColumn("country", F.coalesce("_country", F.lit("Unknown")))
        .drop("_ws", "_us", "_country")
    )


def with_watermarks(series: DataFrame, watermarks: DataFrame, key: str = "city_slug") -> DataFrame:
    return series.join(watermarks.select(key, "last_observed_at"), key, "left")


def resolve_tokens(tokens: DataFrame, alias_dim: DataFrame, token: str = "token") -> DataFrame:
    """Requested names to city slugs; the smallest slug wins where an alias is shared.
    Tokens no city answers to come back with a null slug."""
    first = alias_dim.groupBy("alias").agg(F.min("city_slug").alias("city_slug"))
    return tokens.join(first, F.lower(F.trim(F.col(token))) == F.col("alias"), "left").drop("alias")


def unknown_tokens(tokens: DataFrame, alias_dim: DataFrame, token: str = "token") -> DataFrame:
    return tokens.join(alias_dim, F.lower(F.trim(F.col(token))) == F.col("alias"), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no parent."""
    return child.join(parent.select(*keys), list(keys), "left_anti")


def cascade(child: DataFrame, surviving: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(surviving.select(*keys), list(keys), "left_semi")


def normal_words(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def _pieces(text: Column, size: int) -> Column:
    stop = F.length(text) - (size - 1)
    return F.when(
        stop >= 1,
        F.transform(F.sequence(F.lit(1), stop), lambda i: F.substring(text, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def alias_scores(names: DataFrame, name: str, targets: DataFrame, target: str, alias: str) -> DataFrame:
    """Score every (name, target) that matches at all: 100 equal, 80 whole words,
    50 substring; the best alias of a target counts.

    Containing an alias means that some piece of the name of the alias's length equals
    it, so names are cut into pieces of the alias lengths in use and meet aliases in an
    equi-join on the whole piece: every joined row is a match.
    """
    al = (
        targets.select(F.col(target), normal_words(F.col(alias)).alias("_alias"))
        .where(F.length("_alias") > 0)
        .distinct()
    )
    # Distinct lengths only: bounded by the longest alias, not by the number of rows.
    sizes = [row[0] for row in al.select(F.length("_alias")).distinct().collect()]
    if not sizes:
        sizes = [1]
    distinct = names.select(F.col(name), normal_words(F.col(name)).alias("_norm")).distinct()
    pieces = F.array_distinct(F.concat(*[_pieces(F.col("_norm"), size) for size in sorted(sizes)]))
    met = distinct.withColumn("_alias", F.explode(pieces)).join(al, "_alias")
    padded = F.concat(F.lit(" "), F.col("_norm"), F.lit(" "))
    score = (
        F.when(F.col("_norm") == F.col("_alias"), 100)
        .when(F.contains(padded, F.concat(F.lit(" "), F.col("_alias"), F.lit(" "))), 80)
        .otherwise(50)
    )
    return (
        met.withColumn("score", score)
        .groupBy(target, name)
        .agg(F.max("score").alias("score"))
    )


def match_targets(
    names: DataFrame, name: str, targets: DataFrame, target: str, alias: str
) -> DataFrame:
    """Per target: the single best name, or status ``ambiguous`` / ``unmatched``."""
    scores = alias_scores(names, name, targets, target, alias)
    per_score = scores.groupBy(target, "score").agg(
        F.count(F.lit(1)).alias("candidates"), F.min(name).alias("matched")
    )
    best = per_score.groupBy(target).agg(
        F.max("score").alias("score"),
        F.max_by("candidates", "score").alias("candidates"),
        F.max_by("matched", "score").alias("matched"),
    )
    status = (
        F.when(F.col("score").isNull(), "unmatched")
        .when(F.col("candidates") > 1, "ambiguous")
        .otherwise("matched")
    )
    return (
        targets.select(target)
        .distinct()
        .join(best, target, "left")
        .select(
            target,
            status.alias("status"),
            F.coalesce("score", F.lit(0)).alias("score"),
            F.coalesce("candidates", F.lit(0)).alias("candidates"),
            F.when(status == "matched", F.col("matched")).alias("matched"),
        )
    )


def station_content_check(df: DataFrame, keys: Sequence[str], station: str, aliases: Sequence[str]) -> DataFrame:
    """Does any row of the group name one of the aliases?"""
    words = F.array(*[F.lit(a.lower()) for a in aliases])
    hit = F.exists(words, lambda a: F.contains(F.lower(F.col(station)), a))
    return df.groupBy(*keys).agg(F.max(F.coalesce(hit, F.lit(False))).alias("content_ok"))


def verify_forecasts(
    forecasts: DataFrame, hourly: DataFrame, verified_at: Column, key: str = "city_slug"
) -> DataFrame:
    """Attach the actual hourly mean to every forecast that has come due.

    ``hourly`` carries (key, hour, us_aqi_avg[, pm2_5_avg, pm10_avg])."""
    actual = {"actual_us_aqi": "us_aqi_avg", "actual_pm2_5": "pm2_5_avg", "actual_pm10": "pm10_avg"}
    have = {a: c for a, c in actual.items() if c in hourly.columns}
    facts = hourly.select(
        F.col(key), F.col("hour").alias("_hour"), *[F.col(c).alias(a) for a, c in have.items()]
    )
    error = F.col("predicted_us_aqi") - F.col("actual_us_aqi")
    return (
        forecasts.withColumn("_hour", F.date_trunc("hour", "horizon_timestamp"))
        .join(facts, [key, "_hour"], "left")
        .drop("_hour")
        .withColumn("prediction_error", error)
        .withColumn("absolute_error", F.abs(error))
        .withColumn("verified_at", F.when(F.col("actual_us_aqi").isNotNull(), verified_at))
    )


def skipped_with_artifacts(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Skipped deep-learning rows whose model file exists all the same.  ``artifacts``
    has one ``artifact_path`` per file."""
    have = artifacts.select("artifact_path").distinct().withColumn("artifact_found", F.lit(True))
    return (
        rows.where((F.col("status") == "skipped") & (F.col("family") == "deep_learning"))
        .join(have, "artifact_path", "left")
        .withColumn("artifact_found", F.coalesce("artifact_found", F.lit(False)))
    )


def timeline(past: DataFrame, future: DataFrame) -> DataFrame:
    """Actuals followed by predictions, each padded with nulls for the other."""
    return past.unionByName(future, allowMissingColumns=True)


def last_known(df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, str]) -> DataFrame:
    """Newest non-null value of each column per key."""
    return df.groupBy(*keys).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(alias)
            for alias, c in values.items()
        ]
    )
