"""Ordered computation over long series, one bounded block at a time.

``Window.partitionBy(series)`` puts a whole series into one task.  When one series
holds a third of the data that task is the job.  All ordered operators therefore
work on blocks of ``block_rows`` rows of a series:

* ``with_positions``  exact row number of a row inside its series
* ``framed``          bounded ROWS frames; every block also gets the few neighbour
                      rows its frames reach into (the halo)
* ``neighbours``      previous / next non-null reading at any distance; blocks pass
                      one carry row each instead of their data

A series frame has one row per (keys, ts) with non-null keys; ``sources.clean``
and the bucket aggregates produce that.  Raw readings are reduced to it by
aggregates with map-side combine first, so a hot bucket never travels whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

from breezeline.session import materialise


@dataclass(frozen=True)
class Series:
    """How a frame is keyed: series columns, time column, cadence and block size."""

    keys: tuple[str, ...] = ("city_slug",)
    ts: str = "ts"
    step_seconds: int = 3600
    block_rows: int = 65536

    def with_keys(self, *keys: str) -> "Series":
        return replace(self, keys=tuple(keys))

    @property
    def span_micros(self) -> int:
        return self.step_seconds * self.block_rows * 1_000_000

    def block(self) -> Column:
        micros = F.unix_micros(F.col(self.ts))
        span = F.lit(self.span_micros)
        return F.floor((micros - F.pmod(micros, span)) / span).cast("long")


HELPERS = ("_blk", "_pos", "_len")
PART_EDGES = ("_from", "_to")  # added by a split: first and past-the-last position of the part


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*HELPERS, *PART_EDGES)


def with_positions(df: DataFrame, s: Series) -> DataFrame:
    """Add ``_blk``, the 0-based ``_pos`` in the series and the series length ``_len``.

    Only block counts are summed along the series; the rows themselves are numbered
    inside their block.
    """
    d = df.withColumn("_blk", s.block())
    by = [*s.keys, "_blk"]
    along = Window.partitionBy(*s.keys).orderBy("_blk")
    offsets = (
        d.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by,
            F.coalesce(
                F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_off"),
            F.sum("_n").over(Window.partitionBy(*s.keys)).alias("_len"),
        )
    )
    numbered = d.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(s.ts))
    )
    return (
        numbered.join(offsets, by)
        .withColumn("_pos", F.col("_off") + F.col("_rn") - 1)
        .drop("_off", "_rn")
    )


def ensure_positions(df: DataFrame, s: Series) -> DataFrame:
    return df if set(HELPERS) <= set(df.columns) else with_positions(df, s)


def framed(
    df: DataFrame,
    s: Series,
    before: int,
    after: int,
    build: Callable[[WindowSpec], Sequence[Column]],
    keep_helpers: bool = False,
) -> DataFrame:
    """Add the columns of ``build(window)`` whose frames reach at most ``before`` rows
    back and ``after`` rows ahead."""
    had = set(HELPERS) <= set(df.columns)
    d = ensure_positions(df, s)
    size = F.lit(s.block_rows)
    pos, last = F.col("_pos"), F.col("_len") - 1
    first_block = F.floor(F.greatest(pos - after, F.lit(0)) / size)
    last_block = F.floor(F.least(pos + before, last) / size)
    spread = d.withColumn("_home", F.floor(pos / size)).withColumn(
        "_host", F.explode(F.sequence(first_block, last_block))
    )
    window = Window.partitionBy(*s.keys, "_host").orderBy("_pos")
    out = (
        spread.select("*", *build(window))
        .where(F.col("_host") == F.col("_home"))
        .drop("_host", "_home")
    )
    return out if had or keep_helpers else drop_helpers(out)


def neighbours(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """For every column ``c`` add the nearest non-null reading at or before the row
    (``_pp_c``, ``_pv_c``: position, value) and at or after it (``_np_c``, ``_nv_c``).

    Frames without positions get them on the way: the one summary per block carries its
    row count and its outermost readings, so rows are shuffled once, by block."""
    known = set(HELPERS) <= set(df.columns)
    by = [*s.keys, "_blk"]
    if known:
        d, here = df, F.col("_pos")
    else:
        d = df.withColumn("_blk", s.block())
        d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(s.ts)))
        here = F.col("_rn")
    order = "_pos" if known else "_rn"
    back = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = (
        Window.partitionBy(*by)
        .orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def at(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), here)

    ends = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            agg
            for c in cols
            for agg in (
                F.min(at(c)).alias(f"_fp_{c}"),
                F.min_by(F.col(c), at(c)).alias(f"_fv_{c}"),
                F.max(at(c)).alias(f"_lp_{c}"),
                F.max_by(F.col(c), at(c)).alias(f"_lv_{c}"),
            )
        ],
    )
    along = Window.partitionBy(*s.keys).orderBy("_blk")
    up = along.rowsBetween(Window.unboundedPreceding, -1)
    down = (
        Window.partitionBy(*s.keys)
        .orderBy(F.col("_blk").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # _off turns the order inside a block into the position in the series.
    offset = F.lit(0) if known else F.coalesce(F.sum("_n").over(up), F.lit(0)) - 1
    ends = ends.withColumn("_off", offset)
    length = [] if known else [F.sum("_n").over(Window.partitionBy(*s.keys)).alias("_len")]
    carries = ends.select(
        *by,
        "_off",
        *length,
        *[
            col
            for c in cols
            for col in (
                F.last(F.col(f"_lp_{c}") + F.col("_off"), True).over(up).alias(f"_cpp_{c}"),
                F.last(f"_lv_{c}", True).over(up).alias(f"_cpv_{c}"),
                F.last(F.col(f"_fp_{c}") + F.col("_off"), True).over(down).alias(f"_cnp_{c}"),
                F.last(f"_fv_{c}", True).over(down).alias(f"_cnv_{c}"),
            )
        ],
    )
    local = d.select(
        "*",
        *[
            col
            for c in cols
            for col in (
                F.last(at(c), True).over(back).alias(f"_bpp_{c}"),
                F.last(F.col(c), True).over(back).alias(f"_bpv_{c}"),
                F.last(at(c), True).over(ahead).alias(f"_bnp_{c}"),
                F.last(F.col(c), True).over(ahead).alias(f"_bnv_{c}"),
            )
        ],
    )
    positions = [] if known else ["_blk", (F.col("_off") + F.col("_rn")).alias("_pos"), "_len"]
    return local.join(carries, by).select(
        *df.columns,
        *positions,
        *[
            F.coalesce(
                F.col(f"_b{side}_{c}") + F.col("_off") if side[1] == "p" else F.col(f"_b{side}_{c}"),
                F.col(f"_c{side}_{c}"),
            ).alias(f"_{side}_{c}")
            for c in cols
            for side in ("pp", "pv", "np", "nv")
        ],
    )


def drop_neighbours(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c[:4] in ("_pp_", "_pv_", "_np_", "_nv_")])


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in a global order, without a window over the whole frame.

    The range-partitioned sort numbers rows inside each sorted partition; only the
    per-partition counts are summed.  The numbered frame is written out because
    the sampled range bounds must be the same for counting and for ranking.
    """
    numbered = materialise(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_off"),
        )
    )
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(offsets, "_part")  # one row per sorted partition
        .withColumn(name, F.col("_off") + inside + 1)
        .drop("_part", "_off", "_mid")
    )
