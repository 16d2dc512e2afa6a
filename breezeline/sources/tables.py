"""CSV and parquet tables: reads with contracts, discovery, keyed upserts, archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeline.functions.text import source_env, source_kind
from breezeline.schema import BENCHMARK_SUMMARY, FORECAST_REQUIRED, require_columns
from breezeline.session import staged


def read_csv(
    spark: SparkSession, path, schema: T.StructType, required: Sequence[str], strict: bool = True
) -> DataFrame:
    """Header CSV read by name: the header decides the order, the contract the types.
    An unreadable value fails the job when ``strict``; otherwise it becomes null, and
    ``unreadable_rows`` gives the rows it stood in."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, required, str(path))
    kinds = {f.name: f.dataType for f in schema}

    def read(c: str) -> Column:
        if c not in kinds:
            return F.col(c)
        value = F.col(c).try_cast(kinds[c])
        if strict:
            bad = F.raise_error(F.concat(F.lit(f"unreadable {c}: "), F.col(c)))
            value = F.when(value.isNull() & F.col(c).isNotNull(), bad.cast(kinds[c])).otherwise(value)
        return value.alias(c)

    return raw.select(*[read(c) for c in raw.columns])


def unreadable_rows(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The rows, as text, of a CSV in which some value does not fit the contract, with
    the names of these columns as ``unreadable``."""
    raw = spark.read.option("header", True).csv(path)
    bad = [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name))
        for f in schema
        if f.name in raw.columns
    ]
    marked = raw.withColumn("unreadable", F.array_join(F.array_compact(F.array(*bad)), ", "))
    return marked.where("unreadable <> ''")


def scan(
    spark: SparkSession, path: str, key: str, keys: Sequence[str] | None, ts: str,
    start=None, end=None, columns: Sequence[str] | None = None, date_col: str | None = None,
) -> DataFrame:
    """Parquet scan with key and time predicates left to pushdown and pruning; with
    ``date_col``, the partition column that holds the time's date, whole days outside of
    the bounds are not opened."""
    d = spark.read.parquet(path)
    if date_col:
        d = within_days(d, date_col, start, end)
    if keys:
        d = d.where(F.col(key).isin(*keys))
    if start is not None:
        d = d.where(F.col(ts) >= F.lit(start))
    if end is not None:
        d = d.where(F.col(ts) < F.lit(end))
    return d.select(*columns) if columns else d


def within_days(df: DataFrame, date_col: str, start=None, end=None) -> DataFrame:
    """Cut by the date partition column to the days that literal time bounds touch."""
    if start is not None:
        df = df.where(F.col(date_col) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(date_col) <= F.to_date(F.lit(end)))
    return df


def discover_summaries(
    spark: SparkSession, root: str, kinds: dict[str, str], default: str, glob: str = "*benchmark_summary*.csv"
) -> DataFrame:
    """All benchmark summaries below a folder with file path, time, kind."""
    raw = (
        spark.read.schema(BENCHMARK_SUMMARY)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .csv(root)
    )
    path = F.col("_metadata.file_path")
    kind = source_kind(path, kinds, default)
    return raw.select(
        "*",
        path.alias("source_path"),
        F.col("_metadata.file_modification_time").alias("source_mtime"),
        kind.alias("source_kind"),
        source_env(kind, "hosted", "hosted", "local").alias("source_env"),
    )


def merge_keyed(
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    now: Column | None = None,
    first_wins: Sequence[str] = (),
) -> DataFrame:
    """Last write wins per key, by ``order``; ``created_at`` and the ``first_wins``
    columns keep their oldest value, ``updated_at`` is set on keys that came in.

    One aggregate over old and new rows together, so a key that comes in a billion
    times is reduced in the map tasks.  On a tie the incoming row wins."""
    stamp = now if now is not None else F.current_timestamp()
    new = incoming.withColumn("_new", F.lit(1))
    if "created_at" not in new.columns:
        new = new.withColumn("created_at", stamp)
    new = new.withColumn("updated_at", stamp)
    both = new if existing is None else existing.withColumn("_new", F.lit(0)).unionByName(new, True)
    values = [c for c in both.columns if c not in (*keys, "created_at", "_new", *first_wins)]
    rank = F.struct(*[F.col(c) for c in order], F.col("_new"))
    oldest = F.struct(F.col("_new"), *[F.col(c) for c in order])
    return (
        both.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*values), rank).alias("_row"),
            F.min("created_at").alias("created_at"),
            *[F.min_by(c, oldest).alias(c) for c in first_wins],
        )
        .select(*keys, "_row.*", *first_wins, "created_at")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet (a first batch without a
    usable row leaves an empty folder)."""
    if not _exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def only_touched(table: DataFrame, rows: DataFrame, partition: str) -> DataFrame:
    """The table cut down to the partitions that ``rows`` touch.

    The distinct partition values come to the driver as literals: they are directory
    names (for facts one per day a batch reaches back), as few as the directories the
    write lists anyway, and with literals the scan is pruned before it starts (a semi
    join without a filter would not prune).  Rows without a value have a directory too."""
    values = [row[0] for row in rows.select(partition).distinct().collect()]
    known = F.col(partition).isin([v for v in values if v is not None])
    return table.where(known | F.col(partition).isNull() if None in values else known)


def upsert_table(
    spark: SparkSession,
    path: str,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    partition_by: Sequence[str],
    now: Column | None = None,
    first_wins: Sequence[str] = (),
    partition_of_key: bool = True,
    cluster_by: Sequence[str] = (),
) -> None:
    """Merge by ``keys`` into a partitioned parquet table, rewriting only the touched
    partitions; ``cluster_by`` orders the rows inside their files.

    Old rows are read from the touched partitions only; dynamic overwrite stages the new
    files and swaps whole partitions at commit, so a lost executor or a repeated batch
    leaves the same table.  ``incoming`` is read twice.

    Where the partition column is not a function of the key (``partition_of_key`` off), a
    key stays where it was first stored: the table's key index says where that is."""
    if not partition_of_key:
        (partition,) = partition_by
        with staged(incoming) as rows, staged(in_stored_partitions(spark, path, rows, keys, order, partition)) as placed:
            first_wins = [*dict.fromkeys([*first_wins, partition])]
            upsert_table(spark, path, placed, keys, order, partition_by, now, first_wins, cluster_by=cluster_by)
        return
    existing = read_if_there(spark, path)
    if existing is not None:
        existing = only_touched(existing, incoming.select(partition_by[0]), partition_by[0])
    merged = merge_keyed(existing, incoming, keys, order, now, first_wins)
    overwrite_partitions(merged, path, partition_by, cluster_by)


def in_stored_partitions(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Sequence[str], partition: str,
    parts: int = 64,
) -> DataFrame:
    """The rows with each key's partition value set to the one the key was first stored in.

    The index lies in the table's folder, where readers of the table do not see it: 128 bits
    of hash and the partition per key, hashed into ``parts`` partitions, of which only those
    of the incoming keys are opened, and only those that gain a key are rewritten. It is
    written before the table; a load that fails in between leaves keys without a row, and
    finds them where the index says when it runs again. A table without an index gets one
    from its key columns."""
    index = f"{path.rstrip('/')}/_keys"
    h1, h2 = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    places = ["h1", "h2", partition, "part"]

    def entries(df: DataFrame) -> DataFrame:
        by = F.struct(*[c for c in order if c in df.columns], partition)
        first = df.groupBy(h1.alias("h1"), h2.alias("h2")).agg(F.min_by(partition, by).alias(partition))
        return first.withColumn("part", F.pmod("h1", F.lit(parts)).cast("int")).select(*places)

    known = read_if_there(spark, index)
    if known is None and (table := read_if_there(spark, path)) is not None:
        overwrite_partitions(entries(table), index, ["part"])
        known = read_if_there(spark, index)
    with staged(entries(rows)) as incoming:
        new = incoming
        if known is not None:
            known = only_touched(known, incoming, "part")
            new = incoming.join(known, ["h1", "h2"], "left_anti").select(*places)
        with staged(new) as new:
            grown = new if known is None else only_touched(known, new, "part").select(*places).unionByName(new)
            overwrite_partitions(grown, index, ["part"])
        stored = only_touched(spark.read.parquet(index), incoming, "part")
    stored = stored.select("h1", "h2", F.col(partition).alias("_stored"))
    return rows.withColumns({"h1": h1, "h2": h2}).join(stored, ["h1", "h2"]).withColumn(partition, F.col("_stored")).drop("h1", "h2", "_stored")


#: Bytes of a row group in clustered tables: small enough that a range of keys skips most.
ROW_GROUP = 16 << 20


def overwrite_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], cluster_by: Sequence[str] = (), row_group: int = ROW_GROUP
) -> None:
    """Replace exactly the partitions that the rows belong to.

    With ``cluster_by`` every file is in that order, so that its row groups and pages hold
    narrow ranges and a filter on a leading column skips the others."""
    dealt = df.hint("rebalance", *[F.col(c) for c in partition_by])  # few files, hot partitions split
    if cluster_by:
        dealt = dealt.sortWithinPartitions(*partition_by, *cluster_by)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    (writer.option("parquet.block.size", row_group) if cluster_by else writer).parquet(path)


def hash_part(keys: Sequence[str], parts: int) -> Column:
    """The partition of a state table that a key falls into."""
    return F.pmod(F.hash(*keys), F.lit(parts))


def write_dimension(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str],
    now: Column | None = None, parts: int = 16,
) -> None:
    """Keyed upsert of a state table (cities, watermarks, latest rows), hashed into
    ``parts`` partitions: a batch rewrites those its keys fall into.  Size ``parts`` to
    the table (some ten thousand keys each) and keep it for the table's life."""
    bucketed = incoming.withColumn("part", hash_part(keys, parts))
    upsert_table(spark, path, bucketed, keys, order, ["part"], now)


def write_run_rows(spark: SparkSession, path: str, rows: DataFrame, now: Column, run: str = "run_id") -> None:
    """Rows of runs, partitioned by the day of ``now``, so directories follow days, not runs.

    A run that is repeated replaces its rows, all of them, and stays in the day it was first
    written in; rows of other runs stay. What is read: the run column of the table, and the
    days that change."""
    stamped = rows.withColumns({"created_at": now, "updated_at": now, "run_date": now.cast("date")})
    table = read_if_there(spark, path)
    if table is None:
        overwrite_partitions(stamped, path, ["run_date"])
        return
    with staged(stamped) as new:
        runs = new.select(run).distinct()
        before = table.select(run, "run_date").join(runs, run, "left_semi").groupBy(run).agg(F.min("run_date").alias("_day"))
        placed = new.join(before, run, "left").withColumn("run_date", F.coalesce("_day", "run_date")).drop("_day")
        kept = only_touched(table, placed, "run_date").join(runs, run, "left_anti")
        overwrite_partitions(kept.unionByName(placed, True), path, ["run_date"])


def write_watermarks(spark: SparkSession, path: str, marks: DataFrame, now: Column | None = None) -> None:
    """Advance watermarks: the later one of a series stays, so a late file lowers none."""
    write_dimension(spark, path, marks, ["city_slug"], ["last_observed_at", "updated_at"], now)


def seed_cities(spark: SparkSession, path: str, cities: DataFrame, now: Column | None = None) -> None:
    write_dimension(
        spark, path, cities.withColumn("active", F.lit(True)), ["city_slug"], ["updated_at"], now
    )


def new_watermarks(rows: DataFrame, key: str, ts: str, source: str, overlap_hours: int = 6) -> DataFrame:
    return rows.groupBy(key).agg(F.max(ts).alias("last_observed_at")).select(
        key,
        "last_observed_at",
        F.lit(overlap_hours).alias("overlap_hours"),
        F.lit(source).alias("source"),
    )


def check_forecasts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loadable rows, rejected rows with the reason)."""
    require_columns(df, FORECAST_REQUIRED, "forecasts")
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in FORECAST_REQUIRED])
    )
    d = df.withColumn("_missing", missing)
    bad = d.where(F.size("_missing") > 0).withColumn(
        "problem", F.concat(F.lit("missing "), F.array_join("_missing", ", "))
    )
    return d.where(F.size("_missing") == 0).drop("_missing"), bad.drop("_missing")


def upsert_forecasts(spark: SparkSession, path: str, df: DataFrame, now: Column | None = None) -> DataFrame:
    """Load forecasts by forecast_id; identity columns keep their first value, the
    predictions of the latest load replace earlier ones.  Returns the rejected rows."""
    good, bad = check_forecasts(df)
    day = good.withColumn("issue_date", F.to_date("forecast_timestamp"))
    upsert_table(
        spark,
        path,
        day,
        ["forecast_id"],
        ["updated_at", "forecast_timestamp"],
        ["issue_date"],
        now,
        first_wins=("city_slug", "city_name", "forecast_timestamp", "horizon_timestamp", "horizon_hours"),
        partition_of_key=False,  # a corrected issue time does not move a forecast
        cluster_by=("city_slug", "horizon_timestamp"),
    )
    return bad


def archive_csv(df: DataFrame, root: str, slug: str, run: str, run_end: Column) -> None:
    """Compressed snapshot below slug / year / month / day / run."""
    (
        df.withColumn("yyyy", F.date_format(run_end, "yyyy"))
        .withColumn("mm", F.date_format(run_end, "MM"))
        .withColumn("dd", F.date_format(run_end, "dd"))
        .withColumn("run_id", F.lit(run))
        .hint("rebalance", F.col(slug))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .option("compression", "gzip")
        .partitionBy(slug, "yyyy", "mm", "dd", "run_id")
        .csv(root)
    )


def write_city_csv(df: DataFrame, root: str, key: str, ts: str) -> None:
    """CSV per series, each file in time order; big series are split by day range."""
    (
        df.repartitionByRange(key, ts)
        .sortWithinPartitions(key, ts)
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy(key)
        .csv(root)
    )


def write_failures(df: DataFrame, path: str) -> None:
    """Series that could not be fetched or read, with the reason, as CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_combined_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """All series in one CSV folder, optionally compressed."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths, sizes and times of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
