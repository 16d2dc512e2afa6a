"""The driver's tables in the roles the library works on, in Spark and in SQL.

``cte(...)`` strings are the independent SQL form of the same roles, for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeline.functions.text import city_slug
from breezeline.operators.aggregate import bucket_aggregate, fold_buckets
from breezeline.operators.blocks import Series
from breezeline.schema import METRICS

HOURLY = Series(keys=("city_slug",), ts="ts", step_seconds=3600, block_rows=256)
# Event types stand for five of the metrics; the value itself is the index.
TYPE_OF = {
    "pm2_5": "view",
    "pm10": "click",
    "carbon_monoxide": "error",
    "nitrogen_dioxide": "purchase",
    "ozone": "signup",
}
FILLED = METRICS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [f.name for f in d.schema if f.dataType.typeName() == "timestamp_ntz"]
    return d.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else d


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("city_key"),
        city_slug("n_name").alias("city_slug"),
        F.col("n_name").alias("city_name"),
        F.col("r_name").alias("country"),
    )


def trailing(spark: SparkSession, sf_dir: str, keep: str) -> tuple[Column, str]:
    """The newest event time, and the time ``keep`` before it in the type it is stored in.

    One row from the bare time column.  As a literal of the stored type the bound reaches
    the parquet reader; a subquery over the joined facts, or a cast of the column, would
    keep it above the scan."""
    newest = F.max("ts")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = e.agg(newest.cast("string").alias("n"), (newest - F.expr(f"INTERVAL {keep}")).cast("string").alias("b")).first()
    return F.lit(row["n"]).cast("timestamp"), row["b"]


def observations(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """One row per event (from ``since`` on), seven metric columns, keyed to a city."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if since is not None:
        e = e.where(F.col("ts") >= F.lit(since).cast(e.schema["ts"].dataType))
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    metric = {m: F.when(F.col("event_type") == t, F.col("value")) for m, t in TYPE_OF.items()}
    metric["sulphur_dioxide"] = F.get_json_object("props", "$.k").cast("double")
    metric["us_aqi"] = F.col("value")
    return e.join(cities(spark, sf_dir), F.col("user_id") % 25 == F.col("city_key")).select(
        "city_slug",
        "city_name",
        "country",
        F.col("ts").alias("observed_at"),
        "event_id",
        "user_id",
        *[metric[m].alias(m) for m in METRICS],
    )


def hourly(
    spark: SparkSession, sf_dir: str, metrics: Sequence[str] = METRICS, since: str | None = None
) -> DataFrame:
    """(city_slug, ts) frame of hourly means, with its natural gaps."""
    return fold_buckets(observations(spark, sf_dir, since), "observed_at", "hour", ["city_slug"], metrics)


def hourly_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_aggregate(
        observations(spark, sf_dir), "hour", ["city_slug", "city_name"], "observed_at", METRICS
    )


def as_of(df: DataFrame, ts: str = "observed_at") -> Column:
    """Newest time as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()


FORECAST_HOURS = (1, 6, 24)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two simple models forecast every hourly mean 1, 6 and 24 hours ahead."""
    h = hourly(spark, sf_dir, ("us_aqi", "pm2_5"))
    models = F.array(
        F.struct(F.lit("Persistence").alias("model_type"), F.lit(1.0).alias("f"), F.lit(0.0).alias("a")),
        F.struct(F.lit("Persistence+Trend").alias("model_type"), F.lit(0.9).alias("f"), F.lit(5.0).alias("a")),
    )
    return (
        h.select("*", F.explode(models).alias("_m"))
        .select("*", F.explode(F.array(*[F.lit(x) for x in FORECAST_HOURS])).alias("horizon_hours"))
        .select(
            F.concat_ws(
                "-", "city_slug", "_m.model_type", F.date_format("ts", "yyyyMMddHH"), "horizon_hours"
            ).alias("forecast_id"),
            "city_slug",
            F.upper("city_slug").alias("city_name"),
            F.col("ts").alias("forecast_timestamp"),
            (F.col("ts") + F.make_dt_interval(F.lit(0), F.col("horizon_hours"))).alias("horizon_timestamp"),
            "horizon_hours",
            (F.col("us_aqi") * F.col("_m.f") + F.col("_m.a")).alias("predicted_us_aqi"),
            F.col("_m.model_type").alias("model_type"),
            F.lit("1.0").alias("model_version"),
            (1.0 / (1.0 + F.col("us_aqi") / 100.0)).alias("confidence"),
        )
    )


def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as benchmark results."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rmse = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 5000.0)
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(cities(spark, sf_dir), F.col("c_nationkey") == F.col("city_key"))
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("city_slug").alias("city"),
            F.col("c_mktsegment").alias("phase"),
            F.col("o_orderpriority").alias("model"),
            F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), "deep_learning")
            .otherwise("classical")
            .alias("family"),
            F.when(F.col("o_orderstatus") == "F", "ok")
            .when(F.col("o_orderstatus") == "O", "skipped")
            .otherwise("failed")
            .alias("status"),
            rmse.alias("rmse"),
            (rmse * 0.75).alias("mae"),
            (1.0 - rmse / 200.0).alias("r2"),
            (F.col("o_totalprice") / 100.0).alias("train_seconds"),
            F.col("o_orderdate").alias("finished_at"),
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as scheduler runs."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    states = {"1-URGENT": "failed", "2-HIGH": "queued", "3-MEDIUM": "running", "4-NOT SPECIFIED": "success"}
    state = F.lit("up_for_retry")
    for priority, name in states.items():
        state = F.when(F.col("o_orderpriority") == priority, name).otherwise(state)
    prefix = F.when(F.col("country") == "AFRICA", F.lit("model_")).otherwise(F.lit("aq_"))
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(cities(spark, sf_dir), F.col("c_nationkey") == F.col("city_key"))
        .select(
            F.concat(prefix, "city_slug").alias("dag_id"),
            F.col("city_slug"),
            F.col("o_orderkey").alias("run_key"),
            F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("dag_run_id"),
            state.alias("state"),
            F.col("o_orderdate").alias("logical_date"),
            (F.col("o_orderstatus") == "P").alias("is_paused"),
            F.col("o_totalprice").alias("rows_fetched"),
        )
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as station readings; one station has no name."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("station"),
        F.col("l_linestatus").alias("side"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("pm2_5"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("no2"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("so2"),
        F.col("l_extendedprice").alias("pm10"),
        F.lit(None).cast("double").alias("humidity_pct"),
        "l_orderkey",
        "l_linenumber",
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a four-field sensor feed, one reading per sensor and minute."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.groupBy(F.col("event_type").alias("sensor"), F.date_trunc("minute", "ts").alias("ts")).agg(
        F.max(F.when(k >= 30, F.col("value"))).alias("pm2_5"), F.max(k).alias("pm10")
    )


SENSOR = Series(keys=("sensor",), ts="ts", step_seconds=60, block_rows=256)


# ---- SQL forms -----------------------------------------------------------------------

_CASES = ",\n ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {m}" for m, t in TYPE_OF.items())

SQL = {
    "cities": """cities AS (SELECT n_nationkey AS city_key, lower(replace(n_name,' ','_')) AS city_slug,
 n_name AS city_name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "obs": f"""obs AS (SELECT city_slug, city_name, country, ts AS observed_at, event_id, user_id,
 {_CASES},
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sulphur_dioxide, value AS us_aqi
 FROM events JOIN cities ON user_id % 25 = city_key)""",
    "newest": "newest AS (SELECT max(observed_at) AS as_of FROM obs)",
    "hourly": "hourly AS (SELECT city_slug, date_trunc('hour', observed_at) AS ts, "
    + ", ".join(f"avg({m}) AS {m}" for m in METRICS)
    + " FROM obs GROUP BY ALL)",
    "forecasts": """forecasts AS (SELECT city_slug || '-' || model_type || '-' || strftime(ts,'%Y%m%d%H') || '-' || h AS forecast_id,
 city_slug, upper(city_slug) AS city_name, ts AS forecast_timestamp, ts + h * INTERVAL 1 HOUR AS horizon_timestamp,
 h AS horizon_hours, us_aqi * f + a AS predicted_us_aqi, model_type, '1.0' AS model_version,
 1.0 / (1.0 + us_aqi / 100.0) AS confidence
 FROM hourly, (VALUES ('Persistence', 1.0::DOUBLE, 0.0::DOUBLE), ('Persistence+Trend', 0.9::DOUBLE, 5.0::DOUBLE)) m(model_type, f, a),
 (VALUES (1), (6), (24)) hh(h))""",
    "bench": """bench AS (SELECT o_orderkey AS row_id, city_slug AS city, c_mktsegment AS phase, o_orderpriority AS model,
 CASE WHEN c_mktsegment IN ('MACHINERY','FURNITURE') THEN 'deep_learning' ELSE 'classical' END AS family,
 CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000.0 END AS rmse,
 CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000.0 END * 0.75 AS mae,
 1.0 - CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000.0 END / 200.0 AS r2,
 o_totalprice / 100.0 AS train_seconds, o_orderdate AS finished_at
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN cities ON c_nationkey = city_key)""",
    "runs": """runs AS (SELECT CASE WHEN country = 'AFRICA' THEN 'model_' ELSE 'aq_' END || city_slug AS dag_id, city_slug,
 o_orderkey AS run_key, 'run_' || o_orderkey AS dag_run_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'running'
  WHEN '4-NOT SPECIFIED' THEN 'success' ELSE 'up_for_retry' END AS state,
 o_orderdate AS logical_date, o_orderstatus = 'P' AS is_paused, o_totalprice AS rows_fetched
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN cities ON c_nationkey = city_key)""",
    "stations": """stations AS (SELECT nullif(l_returnflag,'N') AS station, l_linestatus AS side, l_shipdate::TIMESTAMP AS ts,
 l_quantity AS pm2_5, nullif(l_discount,0) AS no2, nullif(l_tax,0) AS so2, l_extendedprice AS pm10,
 CAST(NULL AS DOUBLE) AS humidity_pct, l_orderkey, l_linenumber FROM lineitem)""",
    "sensors": """sensors AS (SELECT event_type AS sensor, date_trunc('minute', ts) AS ts,
 max(CASE WHEN CAST(json_extract_string(props,'$.k') AS DOUBLE) >= 30 THEN value END) AS pm2_5,
 max(CAST(json_extract_string(props,'$.k') AS DOUBLE)) AS pm10 FROM events GROUP BY ALL)""",
    "hgrid": """bounds AS (SELECT city_slug, min(ts) AS a, max(ts) AS z FROM hourly GROUP BY 1),
steps AS (SELECT city_slug, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM bounds),
hgrid AS (SELECT s.city_slug, s.ts, h.pm2_5, h.pm10, h.us_aqi, h.carbon_monoxide, h.nitrogen_dioxide, h.sulphur_dioxide, h.ozone,
 row_number() OVER (PARTITION BY s.city_slug ORDER BY s.ts) - 1 AS pos,
 count(*) OVER (PARTITION BY s.city_slug) AS len
 FROM steps s LEFT JOIN hourly h USING (city_slug, ts))""",
}
NEEDS = {
    "obs": ["cities"],
    "newest": ["obs"],
    "hourly": ["obs"],
    "forecasts": ["hourly"],
    "bench": ["cities"],
    "runs": ["cities"],
    "hgrid": ["hourly"],
}


def cte(*names: str, extra: Sequence[str] = ()) -> str:
    """WITH clause of the named roles and what they build on, plus own parts."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join([SQL[n] for n in order] + list(extra)) + "\n"


def r6(expr: str, alias: str | None = None) -> str:
    """A double at six places.  The nudge settles decimal halves, which would otherwise
    fall by the order of summation; adding zero removes a negative one."""
    return f"round({expr} + 1e-9, 6) + 0.0 AS {alias or expr}"


def nearest_sql(c: str) -> str:
    """Position and value of the nearest reading on both sides (needs windows wb, wf)."""
    at = f"CASE WHEN {c} IS NOT NULL THEN pos END"
    return (
        f"last_value({at} IGNORE NULLS) OVER wb AS pp_{c}, last_value({c} IGNORE NULLS) OVER wb AS pv_{c}, "
        f"first_value({at} IGNORE NULLS) OVER wf AS np_{c}, first_value({c} IGNORE NULLS) OVER wf AS nv_{c}"
    )


def fill_sql(source: str, target: str, cols: Sequence[str], kind: str, limit: int | None, key: str = "city_slug",
             when: str = "true") -> str:
    """One fill step as its own pair of CTEs, every step looking at its input afresh."""
    k = 10**9 if limit is None else limit
    out = []
    for c in cols:
        line = f"pv_{c} + (nv_{c} - pv_{c}) * (pos - pp_{c}) / (np_{c} - pp_{c})"
        hit, value = {
            "ffill": (f"pos - pp_{c} <= {k}", f"pv_{c}"),
            "bfill": (f"np_{c} - pos <= {k}", f"nv_{c}"),
            "linear": (f"pos - pp_{c} <= {k}", f"coalesce({line}, pv_{c})"),
            "both": (f"(pos - pp_{c} <= {k} OR np_{c} - pos <= {k})", f"coalesce({line}, pv_{c}, nv_{c})"),
        }[kind]
        guard = when.replace("{c}", c)
        out.append(f"CASE WHEN {c} IS NULL AND {hit} AND {guard} THEN {value} ELSE {c} END AS {c}")
    near = ", ".join(nearest_sql(c) for c in cols)
    return f"""{target}_n AS (SELECT *, {near} FROM {source}
 WINDOW wb AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 wf AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{target} AS (SELECT * REPLACE ({", ".join(out)}) FROM (SELECT * FROM {target}_n))"""


def rounded(cols: Sequence[str]) -> str:
    return ", ".join(r6(c) for c in cols)


# ---- registry ------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Stable output types: doubles at six places, whole numbers as bigint, times
    without zone."""

    def shape(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c + 1e-9, 6) + 0.0).alias(f.name)  # as in r6
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("long").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.DateType)):
            return c.cast("timestamp_ntz").alias(f.name)
        return c.alias(f.name)

    return df.select(*[shape(f) for f in df.schema])


def query(name: str, sql: str | None = None):
    from breezeline.session import configure

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
