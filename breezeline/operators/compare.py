"""Readings set against others: as-of matches, the year before, the order of files, limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], tolerance_seconds: int,
    block_seconds: int = 86_400,
) -> DataFrame:
    """Every left row with the right row of its keys that is nearest in time, at most ``tolerance_seconds`` away
    (``match_ts``, and ``match_<value>``, null where there is none; of two as near the earlier).

    Both sides are cut into blocks of time, and only a block is ordered in one task, however long the series. A block
    also receives the last right row of the block before and the first of the one after: a block is at least as long
    as the tolerance, so a match stands in it or is one of these two. Of right rows at one time the one with the least
    values counts; left rows without a time match nothing."""
    size = max(block_seconds, tolerance_seconds)
    block = F.floor(F.unix_micros(ts) / (size * 1_000_000)).cast("long")
    own = F.struct(F.col(ts).alias("ts"), *values)
    marks = right.where(F.col(ts).isNotNull()).select(*keys, block.alias("_b"), own.alias("_r"))
    points = marks.groupBy(*keys, "_b", F.col("_r.ts").alias("_t")).agg(F.min("_r").alias("_r"))
    ends = points.groupBy(*keys, "_b").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    edges = ends.select(
        *keys, F.inline(F.array(
            F.struct((F.col("_b") + 1).alias("_b"), F.col("_last").alias("_r")),
            F.struct((F.col("_b") - 1).alias("_b"), F.col("_first").alias("_r")),
        ))
    )
    points = points.unionByName(edges.withColumn("_t", F.col("_r.ts")))
    asked = left.select(*keys, block.alias("_b"), F.col(ts).alias("_t"), F.struct("*").alias("_l"))
    both = asked.unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_t")
    before = F.last("_r", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_r", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    met = both.select("_l", "_t", before.alias("_p"), after.alias("_n")).where("_l IS NOT NULL")

    def away(c: str) -> Column:
        return F.abs(F.unix_micros(F.col(f"{c}.ts")) - F.unix_micros("_t"))

    near = F.when(F.col("_n").isNull() | (away("_p") <= away("_n")), F.col("_p")).otherwise(F.col("_n"))
    picked = met.withColumn("_m", F.when(F.col("_t").isNotNull(), near))
    picked = picked.withColumn("_m", F.when(away("_m") <= tolerance_seconds * 1_000_000, F.col("_m")))
    return picked.select("_l.*", F.col("_m.ts").alias("match_ts"), *[F.col(f"_m.{v}").alias(f"match_{v}") for v in values])


def year_over_year(df: DataFrame, keys: Sequence[str], ts: str, metric: str, tolerance_seconds: int = 3600) -> DataFrame:
    """Every reading with the one of a calendar year before (29 February: 28 February), at most ``tolerance_seconds``
    off: keys, ts, metric, ``before_ts``, ``before``, ``change`` and ``change_pct`` (null over zero). Readings of a
    first year, and those in whose place a year before there is a gap, have no partner."""
    known = df.where(F.col(metric).isNotNull()).select(*keys, ts, metric)
    asked = known.withColumn("_own", F.col(ts)).withColumn(ts, F.col(ts) - F.expr("INTERVAL 1 YEAR"))
    met = asof_nearest(asked, known, keys, ts, [metric], tolerance_seconds)
    before = F.col(f"match_{metric}")
    change = F.col(metric) - before
    return met.select(
        *keys, F.col("_own").alias(ts), metric, F.col("match_ts").alias("before_ts"), before.alias("before"),
        change.alias("change"), (100.0 * change / F.nullif(before, F.lit(0.0))).alias("change_pct"),
    )


def order_check(df: DataFrame, ts: str) -> DataFrame:
    """Whether the rows of each file of a file scan stand in time order: file, rows, ordered, and of the first row
    that is earlier than the one before it its number in the file (from 1), its time and that time before.

    ``df`` is the scan itself, with no shuffle in between: its rows number themselves as they are read, and a file is
    known by its path and the starts of its splits. A split is looked through alone and hands on its two edges, so a
    file of any number of splits is checked at every edge without meeting in one task. Rows without a time are skipped."""
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    read = df.select(path.alias("file"), start.alias("_split"), F.monotonically_increasing_id().alias("_at"), F.col(ts).alias("_t"))
    split = Window.partitionBy("file", "_split").orderBy("_at")
    seen = F.last("_t", True).over(split.rowsBetween(Window.unboundedPreceding, -1))
    walked = read.select("*", F.row_number().over(split).alias("_row"), seen.alias("_before"))
    bad = F.col("_t") < F.col("_before")
    each = walked.groupBy("file", "_split").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_row"))).alias("_first"),
        F.min(F.when(F.col("_t").isNotNull(), F.col("_row"))).alias("_first_row"),
        F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("_row"))).alias("_last"),
        F.min(F.when(bad, F.struct("_row", "_t", "_before"))).alias("_inner"),
    )
    # the edges of a file's splits: a row per split
    file = Window.partitionBy("file").orderBy("_split")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    edge = each.select(
        "*", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_done"), F.last("_last", True).over(earlier).alias("_carry")
    )
    across = F.when(F.col("_first") < F.col("_carry"), F.struct(F.col("_first_row").alias("_row"), F.col("_first").alias("_t"), F.col("_carry").alias("_before")))
    found = F.least(across, F.col("_inner"))
    placed = F.when(found.isNotNull(), F.struct((F.col("_done") + found["_row"]).alias("_row"), found["_t"].alias("_t"), found["_before"].alias("_before")))
    return edge.withColumn("_bad", placed).groupBy("file").agg(F.sum("_rows").alias("rows"), F.min("_bad").alias("_bad")).select(
        "file", "rows", F.col("_bad").isNull().alias("ordered"), F.col("_bad._row").alias("row"), F.col("_bad._t").alias("time"),
        F.col("_bad._before").alias("time_before"),
    )


def dominant_metric(limits: Mapping[str, float]) -> Column:
    """Struct of the metric that exceeds its limit most (``metric``, ``exceedance``: value over limit); of equal ones
    the first by name. Null where no metric has a value."""
    shares = [
        F.when(F.col(m).isNotNull() & ~F.isnan(m), F.struct((-F.col(m) / F.lit(float(limit))).alias("less"), F.lit(m).alias("metric")))
        for m, limit in limits.items()
    ]
    most = F.array_min(F.array_compact(F.array(*shares)))
    return F.when(most.isNotNull(), F.struct(most["metric"].alias("metric"), (-most["less"]).alias("exceedance")))
