"""JSON documents: hourly payloads with parallel arrays, listings, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeline.functions.text import config_fingerprint
from breezeline.schema import HOURLY_PAYLOAD, METRICS, RESOURCE_LISTING


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one per line with its city: columns city, body."""
    return spark.read.schema("city string, body string").json(path)


def check_payloads(docs: DataFrame, body: str = "body") -> DataFrame:
    """Parse and add ``problem``: unreadable, empty time, wrong length, bad time."""
    parsed = docs.withColumn("_h", F.from_json(body, HOURLY_PAYLOAD)["hourly"])
    times = F.col("_h.time")
    problem = F.when(F.coalesce(F.size(times), F.lit(0)) <= 0, F.lit("no hourly rows"))
    for m in METRICS:
        values = F.col(f"_h.{m}")
        problem = problem.when(
            values.isNotNull() & (F.size(values) != F.size(times)), F.lit(f"length of {m} differs from time")
        )
    bad_time = F.exists(times, lambda t: F.try_to_timestamp(t).isNull())
    return parsed.withColumn("problem", problem.when(bad_time, F.lit("unreadable time")))


def decode_payloads(docs: DataFrame, city: str = "city", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): parallel arrays zipped to one row per hour; a metric that is
    absent gives nulls."""
    checked = check_payloads(docs, body)
    times = F.col("_h.time")
    blank = F.transform(times, lambda _t: F.lit(None).cast("double"))
    zipped = F.arrays_zip(
        times.alias("time"), *[F.coalesce(F.col(f"_h.{m}"), blank).alias(m) for m in METRICS]
    )
    rows = (
        checked.where("problem is null")
        .select(city, F.explode(zipped).alias("_r"))
        .select(
            city,
            F.to_timestamp(F.col("_r")["time"]).alias("timestamp"),
            *[F.col("_r")[m].alias(m) for m in METRICS],
        )
    )
    bad = checked.where("problem is not null").select(city, body, "problem")
    return rows, bad


def encode_day(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Inverse of decoding, one document per (key, day): at most 24 hourly entries."""
    row = F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm").alias("time"), *METRICS)
    listed = F.array_sort(F.collect_list(row))
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(listed.alias("_rows"))
    hourly = F.struct(*[F.col(f"_rows.{c}").alias(c) for c in ("time", *METRICS)])
    return days.select(
        *keys, "day", F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("body")
    )


def csv_resources(listings: DataFrame, body: str, contains: str) -> DataFrame:
    """CSV entries of resource listings with a link and a matching name."""
    r = F.from_json(body, RESOURCE_LISTING)["result"]["resources"]
    return (
        listings.select(F.explode(r).alias("r"))
        .select("r.*")
        .where(
            (F.upper("format") == "CSV")
            & (F.coalesce(F.length("url"), F.lit(0)) > 0)
            & F.col("name").contains(contains)
        )
    )


RESULT_CONFIG = (
    "hidden_dim",
    "model_dim",
    "num_layers",
    "layers",
    "heads",
    "lr",
    "dropout",
    "epochs",
)
RESULT_DOCUMENT = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField(
            "metrics",
            T.StructType([T.StructField(m, T.StringType()) for m in ("rmse", "mae", "r2")]),
        ),
        T.StructField(
            "config", T.StructType([T.StructField(k, T.StringType()) for k in RESULT_CONFIG])
        ),
    ]
)


def flatten_results(docs: DataFrame) -> DataFrame:
    """Result documents to flat rows with a short configuration text."""
    c = lambda name: F.col(f"config.{name}")
    short = config_fingerprint(
        {
            "h": [c("hidden_dim"), c("model_dim")],
            "layers": [c("num_layers"), c("layers")],
            "heads": [c("heads")],
            "lr": [c("lr")],
            "drop": [c("dropout")],
            "epochs": [c("epochs")],
        }
    )
    stamp = F.substring_index(F.replace(F.col("timestamp"), F.lit("T"), F.lit(" ")), ".", 1)
    return docs.select(
        F.coalesce("city", F.lit("")).alias("city"),
        F.coalesce("model", F.lit("")).alias("model"),
        stamp.alias("timestamp"),
        *[F.col(f"metrics.{m}").try_cast("double").alias(m) for m in ("rmse", "mae", "r2")],
        short.alias("config"),
        *[x for x in docs.columns if x == "path"],
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    docs = (
        spark.read.schema(RESULT_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    return flatten_results(docs)
