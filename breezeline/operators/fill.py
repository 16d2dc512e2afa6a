"""Gap filling, interpolation, outlier caps and the composed cleaning recipes.

All fills of a column are worked out from one ``neighbours`` pass: in the run of
missing rows between two readings every step fills a stretch at the left end, at the
right end, or both.  ``Gap`` follows how far each end has been filled, so a chain of
steps stays column arithmetic and never re-shuffles the frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.functions.numeric import capped, clip
from breezeline.operators.blocks import (
    Series,
    drop_helpers,
    framed,
    neighbours,
    with_positions,
)
from breezeline.operators.grid import bucket_mean, regular_grid
from breezeline.operators.quantiles import between, exact_quantiles, order_statistics, wide_quantiles, widen
from breezeline.session import materialise

STATE = ("l", "lv", "r", "rv", "x")


def _n(part: str, c: str) -> str:
    return f"_g{part}_{c}"


def _start(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = {"l": "_pp_", "lv": "_pv_", "r": "_np_", "rv": "_nv_"}
    return df.select(
        "*",
        *[F.col(f"{src}{c}").alias(_n(p, c)) for c in cols for p, src in pairs.items()],
        *[F.col(c).alias(_n("x", c)) for c in cols],
    )


def _advance(df: DataFrame, cols: Sequence[str], step) -> DataFrame:
    """One select that moves the state of every column by one fill step."""
    moved = {}
    for c in cols:
        l, lv, r, rv, x = (F.col(_n(p, c)) for p in STATE)
        for part, col in zip(STATE, step(F.col("_pos"), l, lv, r, rv, x)):
            moved[_n(part, c)] = col
    return df.withColumns(moved)


def forward_step(limit: int | None):
    def step(i, l, lv, r, rv, x):
        if limit is None:
            reach = F.when(l.isNotNull(), F.coalesce(r - 1, F.col("_len") - 1))
            return reach, lv, r, rv, F.coalesce(x, F.when(l.isNotNull(), lv))
        reach = l + limit
        return reach, lv, r, rv, F.coalesce(x, F.when((i > l) & (i <= reach), lv))

    return step


def backward_step(limit: int | None):
    def step(i, l, lv, r, rv, x):
        if limit is None:
            reach = F.when(r.isNotNull(), F.coalesce(l + 1, F.lit(0)))
            return l, lv, reach, rv, F.coalesce(x, F.when(r.isNotNull(), rv))
        reach = r - limit
        return l, lv, reach, rv, F.coalesce(x, F.when((i < r) & (i >= reach), rv))

    return step


def linear_step(limit: int | None, both: bool = False, when: Column | None = None):
    """Straight line by row position between the ends; past the last reading the last
    value is repeated, and with ``both`` the first value is repeated backwards."""

    def step(i, l, lv, r, rv, x):
        def line(p: Column) -> Column:
            inner = lv + (rv - lv) * (p - l) / (r - l)
            return F.coalesce(inner, lv, rv) if both else F.coalesce(inner, lv)

        room = F.coalesce(r - 1, F.col("_len") - 1)
        l2 = room if limit is None else F.least(l + limit, room)
        l2 = F.when(l.isNotNull(), l2)
        lv2 = F.when(l.isNotNull(), line(l2))
        value = F.when((i > l) & (i <= l2), line(i))
        r2, rv2 = r, rv
        if both:
            floor_ = F.coalesce(l + 1, F.lit(0))
            r2 = floor_ if limit is None else F.greatest(r - limit, floor_)
            r2 = F.when(r.isNotNull(), r2)
            rv2 = F.when(r.isNotNull(), line(r2))
            value = F.coalesce(value, F.when((i < r) & (i >= r2), line(i)))
        new = (l2, lv2, r2, rv2, F.coalesce(x, value))
        if when is None:
            return new
        return tuple(F.when(when, b).otherwise(a) for a, b in zip((l, lv, r, rv, x), new))

    return step


def fill_chain(
    df: DataFrame, s: Series, cols: Sequence[str], steps: Sequence, keep_helpers: bool = False
) -> DataFrame:
    """Apply fill steps in order to every column of ``cols``."""
    had = "_pos" in df.columns
    names = [c for c in df.columns]
    d = _start(neighbours(df, s, cols), cols)
    for step in steps:
        d = _advance(d, cols, step)
    helpers = [h for h in ("_blk", "_pos", "_len") if (keep_helpers or had) and h not in names]
    return d.select(*[F.col(_n("x", c)).alias(c) if c in cols else F.col(c) for c in names], *helpers)


def forward_fill(df, s, cols, limit: int | None = None):
    return fill_chain(df, s, cols, [forward_step(limit)])


def backward_fill(df, s, cols, limit: int | None = None):
    return fill_chain(df, s, cols, [backward_step(limit)])


def interpolate(df, s, cols, limit: int | None = None, both: bool = False):
    return fill_chain(df, s, cols, [linear_step(limit, both)])


def gap_length(c: str) -> Column:
    """Length of the missing run a null row sits in (0 on a reading)."""
    left = F.coalesce(F.col(f"_pp_{c}"), F.lit(-1))
    right = F.coalesce(F.col(f"_np_{c}"), F.col("_len"))
    return F.when(F.col(c).isNull(), right - left - 1).otherwise(F.lit(0))


def gaps(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """One row per missing run: keys, metric, gap_start, gap_end, gap_rows."""
    d = neighbours(df, s, cols)
    runs = d.select(
        *s.keys,
        s.ts,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("metric"),
                        F.coalesce(F.col(f"_pp_{c}"), F.lit(-1)).alias("after"),
                        F.col(c).isNull().alias("missing"),
                    )
                    for c in cols
                ]
            )
        ).alias("_m"),
    ).where("_m.missing")
    return (
        runs.groupBy(*s.keys, F.col("_m.metric").alias("metric"), F.col("_m.after").alias("_after"))
        .agg(
            F.min(s.ts).alias("gap_start"),
            F.max(s.ts).alias("gap_end"),
            F.count(F.lit(1)).alias("gap_rows"),
        )
        .drop("_after")
    )


def small_gap_fill(
    df: DataFrame, s: Series, cols: Sequence[str], max_gap: int = 3, then: Sequence = ()
) -> DataFrame:
    """Interpolate from both sides (``max_gap`` rows each) the columns of a series that
    have at least one run of at most ``max_gap`` rows; other columns are left alone."""
    had = "_pos" in df.columns
    d = neighbours(df, s, cols)
    flags = d.groupBy(*s.keys).agg(
        *[
            F.coalesce(
                F.min(F.when(F.col(c).isNull(), gap_length(c))) <= max_gap, F.lit(False)
            ).alias(f"_small_{c}")
            for c in cols
        ]
    )
    names = df.columns
    d = _start(d.join(flags, list(s.keys)), cols)
    for c in cols:
        d = _advance(d, [c], linear_step(max_gap, both=True, when=F.col(f"_small_{c}")))
    for step in then:
        d = _advance(d, cols, step)
    out = d.select(*[F.col(_n("x", c)).alias(c) if c in cols else F.col(c) for c in names])
    return out if had else drop_helpers(out)


def centered_mean_fill(df: DataFrame, s: Series, cols: Sequence[str], width: int = 10) -> DataFrame:
    """Fill with the mean of the surrounding ``width`` rows (even: one more before)."""
    before, after = width // 2, (width - 1) // 2

    def build(w):
        frame = w.rowsBetween(-before, after)
        return [F.avg(c).over(frame).alias(f"_roll_{c}") for c in cols]

    d = framed(df, s, before, after, build)
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_roll_{c}")) for c in cols}).drop(
        *[f"_roll_{c}" for c in cols]
    )


def fill_from_group(
    df: DataFrame, by: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Fill remaining nulls with the exact median of the group."""
    medians = wide_quantiles(df, by, cols, {"_med": 0.5})
    return df.join(medians, list(by), "left").select(
        *[
            F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def monthly_median_fill(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Group is the month of the year, over all years."""
    return fill_from_group(df.withColumn("_month", F.month(s.ts)), [*s.keys, "_month"], cols).drop(
        "_month"
    )


def _clip_columns(df: DataFrame, s: Series, cols: Sequence[str], limits: DataFrame) -> DataFrame:
    """Clip to the ``_low_`` / ``_high_`` columns of the series; a column without any
    reading has no limits and stays as it is."""
    joined = df.join(limits, list(s.keys), "left")
    return joined.select(
        *[
            F.when(F.col(f"_low_{c}").isNull(), F.col(c))
            .otherwise(clip(c, F.col(f"_low_{c}"), F.col(f"_high_{c}")))
            .alias(c)
            if c in cols
            else F.col(c)
            for c in df.columns
        ]
    )


def winsorize(df: DataFrame, s: Series, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip every column to its own quantiles, per series."""
    return _clip_columns(df, s, cols, wide_quantiles(df, s.keys, cols, {"_low": low, "_high": high}))


def _fences(q1: Column, q3: Column, k: float) -> tuple[Column, Column]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def iqr_cap(df: DataFrame, s: Series, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Clip to the quartiles widened by ``k`` inter-quartile ranges, per series."""
    q = exact_quantiles(df, s.keys, cols, {"q1": 0.25, "q3": 0.75})
    low, high = _fences(F.col("q1"), F.col("q3"), k)
    limits = q.select(*s.keys, "metric", low.alias("_low"), high.alias("_high"))
    return _clip_columns(df, s, cols, widen(limits, s.keys, cols, ["_low", "_high"]))


def winsorize_then_iqr_cap(
    df: DataFrame, s: Series, cols: Sequence[str], low: float = 0.01, high: float = 0.99, k: float = 1.5
) -> DataFrame:
    """Both caps from one pass: clipping keeps the order of readings, so the quartiles
    after the first cap are the clipped order statistics of the raw readings."""
    o = order_statistics(df, s.keys, cols, {"a": low, "q1": 0.25, "q3": 0.75, "b": high})
    a, b = (between(F.col(f"lo_{n}"), F.col(f"hi_{n}"), F.col(f"share_{n}")) for n in "ab")
    o = o.withColumn("_a", a).withColumn("_b", b)

    def quartile(n: str) -> Column:
        lo, hi = (clip(f"{end}_{n}", F.col("_a"), F.col("_b")) for end in ("lo", "hi"))
        return between(lo, hi, F.col(f"share_{n}"))

    f1, f3 = _fences(quartile("q1"), quartile("q3"), k)
    limits = o.select(
        *s.keys,
        "metric",
        F.col("_a").alias("_wlow"),
        F.col("_b").alias("_whigh"),
        f1.alias("_low"),
        f3.alias("_high"),
    )
    names = ["_wlow", "_whigh", "_low", "_high"]
    wide = widen(limits, s.keys, cols, names)
    # clip(clip(x, wlow, whigh), low, high) as one clip
    merged = wide.select(
        *s.keys,
        *[
            clip(f"{side}_{c}", F.col(f"_low_{c}"), F.col(f"_high_{c}")).alias(f"{out}_{c}")
            for c in cols
            for side, out in (("_wlow", "_low"), ("_whigh", "_high"))
        ],
    )
    return _clip_columns(df, s, cols, merged)


def threshold_mask(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    return df.withColumns({c: capped(c, limit) for c, limit in limits.items() if c in df.columns})


def impute_for_benchmark(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Hourly grid; interpolate 6 rows from both sides; carry 24 rows forward, then 24
    back; what is left gets the series median.

    Frames that several branches read are written out once (``materialise``), or every
    branch would redo all steps before it."""
    steps = [linear_step(6, both=True), forward_step(24), backward_step(24)]
    filled = materialise(fill_chain(materialise(regular_grid(df, s, cols)), s, cols, steps))
    return drop_helpers(fill_from_group(filled, s.keys, cols))


def impute_for_training(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Hourly grid; interpolate 6 rows forward; carry 24 forward; back-fill all; then the
    month's median, then the series median."""
    steps = [linear_step(6), forward_step(24), backward_step(None)]
    filled = materialise(fill_chain(materialise(regular_grid(df, s, cols)), s, cols, steps))
    by_month = materialise(monthly_median_fill(filled, s, cols))
    return drop_helpers(fill_from_group(by_month, s.keys, cols))


def clean_sensor_feed(
    df: DataFrame,
    s: Series,
    cols: Sequence[str],
    method: str = "iqr",
    limits: dict[str, float] | None = None,
    bucket_seconds: int = 900,
    max_gap: int = 3,
) -> DataFrame:
    """Winsorize, cap outliers, close small gaps, carry forward then back, and average
    into regular bins; the order of the steps matters."""
    if method == "threshold":
        d = threshold_mask(winsorize(df, s, cols), limits or {})
    else:
        d = winsorize_then_iqr_cap(df, s, cols)
    d = materialise(with_positions(d, s))
    d = small_gap_fill(d, s, cols, max_gap, then=[forward_step(None), backward_step(None)])
    return bucket_mean(drop_helpers(d), s, cols, bucket_seconds, cut=True)
