import pytest
from pyspark.sql import functions as F

from breezeline.functions import bands, numeric, text
from breezeline.functions.catalog import aliases, city_catalog
from breezeline.operators import serve as S
from breezeline.operators.aggregate import wide_summary
from breezeline.operators.joins import match_targets, resolve_tokens


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


AQI = [0.0, 50.0, 50.5, 51.0, 100.0, 150.0, 200.0, 300.0, 500.0, 501.0, None]


def test_three_band_rules_differ(spark):
    assert column(spark, AQI, "double", bands.category_inclusive) == [
        "good", "good", "hazardous", "moderate", "moderate", "unhealthy_sg", "unhealthy", "very_unhealthy",
        "hazardous", "hazardous", None,
    ]
    assert column(spark, AQI, "double", bands.category) == [
        "good", "moderate", "moderate", "moderate", "unhealthy_sg", "unhealthy", "very_unhealthy", "hazardous",
        "hazardous", "hazardous", "good",
    ]
    assert column(spark, AQI, "double", bands.risk_band)[-4:] == [
        "very_unhealthy", "very_unhealthy", "very_unhealthy", "good_to_satisfactory",
    ]


def test_unknown_category_gets_moderate_advice(spark):
    got = column(spark, ["nonsense", None, "good"], "string", bands.advisory)
    assert got[0] == got[1] == bands.HEALTH_ADVISORIES["moderate"][0]
    assert got[2] == bands.HEALTH_ADVISORIES["good"][0]


def test_rounding_modes(spark):
    values = [2.5, -2.5, 3.5, 2.4]
    assert column(spark, values, "double", numeric.round_half_up_floor) == [3, -2, 4, 2]
    assert column(spark, values, "double", numeric.round_half_even) == [2, -2, 4, 2]
    assert column(spark, values, "double", numeric.round_half_away) == [3, -3, 4, 2]


def test_confidence(spark):
    got = column(spark, [0.0, 100.0, 1e9, None, float("nan"), float("inf")], "double", bands.confidence_from_rmse)
    assert got == [0.99, 0.5, 0.05, 0.0, 0.0, 0.0]


def test_safe_ratio_and_numbers(spark):
    assert column(spark, [0.0, 4.0, None], "double", lambda v: numeric.safe_ratio(F.lit(2.0), v)) == [None, 0.5, None]
    assert column(spark, ["1.5", "x", "NaN", None], "string", numeric.to_double) == [1.5, None, None, None]


def test_slugs(spark):
    assert column(spark, ["New York City"], "string", text.city_slug) == ["new_york_city"]
    assert column(spark, ["  São-Paulo!! "], "string", text.url_slug) == ["s-o-paulo"]
    assert column(spark, ["Lake -- North."], "string", text.station_slug) == ["lake____north"]
    assert column(spark, ["CNN+LSTM-x y"], "string", text.safe_model_name) == ["cnnpluslstm_x_y"]


def test_catalogue(spark):
    cat = city_catalog(spark)
    assert cat.count() == 36 and cat.select("city_slug").distinct().count() == 36
    tokens = spark.createDataFrame([("london",), ("new-york-city",), ("New York City",), ("nowhere",)], "token string")
    got = {r["token"]: r["city_slug"] for r in resolve_tokens(tokens, aliases(cat)).collect()}
    assert got == {"london": "london", "new-york-city": "new_york_city", "New York City": "new_york_city", "nowhere": None}


def test_fuzzy_match_levels_and_ties(spark):
    names = spark.createDataFrame([("Upper Riverside",), ("Xriversidey",), ("North A",), ("North B",), ("Uni",)], "name string")
    targets = spark.createDataFrame(
        [("P", "Riverside"), ("K", "North"), ("U", "uni"), ("S", "versid"), ("none", "zzz"), ("blank", "--")],
        "target string, alias string",
    )
    got = {r["target"]: r for r in match_targets(names, "name", targets, "target", "alias").collect()}
    assert (got["P"]["status"], got["P"]["score"], got["P"]["matched"]) == ("matched", 80, "Upper Riverside")
    assert got["K"]["status"] == "ambiguous" and got["K"]["candidates"] == 2
    assert got["U"]["score"] == 100
    assert got["S"]["status"] == "ambiguous" and got["S"]["score"] == 50
    assert got["none"]["status"] == got["blank"]["status"] == "unmatched"


def test_trend_of_a_single_row_is_stable(spark):
    h = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 10.0), ("b", 2, 20.0)], "city_slug string, hour int, us_aqi_avg double")
    got = {r["city_slug"]: r for r in S.trend_over_range(h, ["city_slug"]).collect()}
    assert got["a"]["direction"] == "stable" and got["a"]["slope"] == 0
    assert got["b"]["direction"] == "increasing" and got["b"]["slope"] == 5 and got["b"]["change_percent"] == 100


def test_payload_rejects_missing_and_infinite(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("inf"))], "city string, m double")
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r["city"]: r["problem"] for r in S.field_payload(df, ["m"], ["field1"], "city", "ts").collect()}
    assert got == {"a": None, "b": "missing value for m", "c": "non-finite value for m"}
    with pytest.raises(ValueError):
        S.field_payload(df, ["m"], ["field1", "field2"], "city", "ts")


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "s string, v double")
    row = wide_summary(df, ["s"], ["v"]).where("s is null").first()
    assert (row["v_count"], row["v_median"], row["v_max"]) == (2, 3.0, 4.0)
