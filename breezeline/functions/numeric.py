"""Number helpers: rounding modes, guards, clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up_floor(x: Column | str, digits: int = 0) -> Column:
    """Rounds .5 towards +infinity, as browsers do."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5) / F.lit(scale)


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(_c(x), digits)


def round_half_away(x: Column | str, digits: int = 0) -> Column:
    """NUMERIC-style rounding."""
    return F.round(_c(x).cast("decimal(38,18)"), digits).cast("double")


def clip(x: Column | str, low: float | Column, high: float | Column) -> Column:
    """Null stays null (least/greatest alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), low), high))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def nan_to_null(x: Column | str) -> Column:
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def zero_if_missing(x: Column | str) -> Column:
    return F.coalesce(nan_to_null(x), F.lit(0.0))


def to_double(x: Column | str) -> Column:
    """Text to double; anything unreadable or NaN becomes null."""
    return nan_to_null(F.try_cast(_c(x), "double") if hasattr(F, "try_cast") else _c(x).try_cast("double"))


def capped(x: Column | str, limit: float) -> Column:
    """Readings above the limit are treated as missing."""
    return F.when(_c(x) <= limit, _c(x))
