"""Air-quality bands, advisories, trend labels, confidence and uncertainty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from breezeline.functions.text import lookup


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Category, inclusive lower and upper AQI, lower threshold, colour.
AQI_BANDS = (
    ("good", 0, 50, 0, "#10b981"),
    ("moderate", 51, 100, 50, "#f59e0b"),
    ("unhealthy_sg", 101, 150, 100, "#f97316"),
    ("unhealthy", 151, 200, 150, "#ef4444"),
    ("very_unhealthy", 201, 300, 200, "#9333ea"),
    ("hazardous", 301, 500, 300, "#7c2d12"),
)
# Advice per category for everyone, sensitive groups, children.
HEALTH_ADVISORIES = {
    "good": (
        "Air quality is satisfactory, and air pollution poses little or no risk.",
        "Maintain normal activities.",
        "Safe for outdoor activities.",
    ),
    "moderate": (
        "Air quality is acceptable; however, there may be risk for some people, particularly those who are unusually sensitive to air pollution.",
        "Consider limiting prolonged outdoor exertion; keep windows closed during peak hours.",
        "Safe, but sensitive children should limit vigorous outdoor exertion.",
    ),
    "unhealthy_sg": (
        "Members of sensitive groups (children, elderly, people with respiratory disease) may experience health effects.",
        "Reduce prolonged outdoor exertion. Consider moving exertion indoors or rescheduling.",
        "Limit outdoor play. Move vigorous activities indoors or to another time.",
    ),
    "unhealthy": (
        "Some members of the general public may begin to experience health effects; members of sensitive groups may experience more serious health effects.",
        "Avoid outdoor exertion; stay indoors as much as possible.",
        "Avoid all outdoor activities. Stay inside in a well-ventilated building.",
    ),
    "very_unhealthy": (
        "Health alert: The risk of health effects is increased for the entire population.",
        "Health warning of emergency conditions: the entire population is more likely to be affected.",
        "Remain indoors; use air purifier if available. Avoid any exertion.",
    ),
    "hazardous": (
        "Health warning of emergency conditions: everyone is more likely to be affected by serious health effects.",
        "Everyone should avoid all outdoor exertion; remain indoors and keep activity levels low.",
        "Stay indoors. Use air purifier. Seek medical attention if symptoms develop.",
    ),
}


def category_inclusive(aqi: Column | str) -> Column:
    """Integer bands, both ends included; whatever falls between or outside the bands
    is hazardous, null stays null."""
    x = _c(aqi)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for name, low, high, _, _ in AQI_BANDS:
        out = out.when(x.between(low, high), name)
    return out.otherwise("hazardous")


def category(aqi: Column | str) -> Column:
    """Highest threshold reached; null and negative values are good."""
    x = _c(aqi)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, _, _, threshold, _ in reversed(AQI_BANDS):
        out = out.when(x >= threshold, name)
    return out.otherwise("good")


def category_color(name: Column | str) -> Column:
    return lookup(name, {band[0]: band[4] for band in AQI_BANDS})


def advisory(name: Column | str, audience: str = "general") -> Column:
    """Advice text; unknown categories get the moderate one."""
    index = {"general": 0, "sensitive_groups": 1, "children": 2}[audience]
    texts = {key: value[index] for key, value in HEALTH_ADVISORIES.items()}
    return lookup(F.coalesce(_c(name), F.lit("moderate")), texts, default=texts["moderate"])


def risk_band(peak: Column | str) -> Column:
    x = _c(peak)
    return (
        F.when(x >= 200, "very_unhealthy")
        .when(x >= 150, "unhealthy")
        .when(x >= 100, "moderate")
        .otherwise("good_to_satisfactory")
    )


def against_band(
    value: Column | str,
    base: Column | str,
    margin: float,
    labels: tuple[str, str, str] = ("up", "down", "stable"),
) -> Column:
    """Label by whether ``value`` leaves the band ``base`` +/- ``margin``."""
    v, b = _c(value), _c(base)
    return F.when(v > b + margin, labels[0]).when(v < b - margin, labels[1]).otherwise(labels[2])


def change_label(current: Column | str, previous: Column | str) -> Column:
    """Worsening / Improving / Stable; nothing when there is no previous value."""
    prev = _c(previous)
    known = prev.isNotNull() & (prev != 0)
    return F.when(known, against_band(current, prev, 5.0, ("Worsening", "Improving", "Stable")))


def slope_direction(slope: Column | str, threshold: float = 0.15) -> Column:
    s = _c(slope)
    return F.when(s > threshold, "rising").when(s < -threshold, "falling").otherwise("stable")


def percent_direction(change: Column, percent: Column, quiet: float = 2.0) -> Column:
    return (
        F.when(F.abs(percent) < quiet, "stable").when(change > 0, "increasing").otherwise("decreasing")
    )


def confidence_from_rmse(rmse: Column | str) -> Column:
    x = _c(rmse)
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    bounded = F.greatest(F.lit(0.05), F.least(F.lit(0.99), 1.0 / (1.0 + x / 100.0)))
    return F.when(usable, bounded).otherwise(F.lit(0.0))


def raw_confidence(rmse: Column | str) -> Column:
    return 1.0 / (1.0 + _c(rmse) / 100.0)


def uncertainty(confidence: Column | str) -> Column:
    """Half-width of the plotted interval; 20 when no confidence is given."""
    c = _c(confidence)
    return F.when(c.isNotNull() & (c != 0), (1.0 - c) * 50.0).otherwise(F.lit(20.0))


def interval_bounds(predicted: Column | str, half_width: Column | str) -> tuple[Column, Column]:
    """No interval where the prediction is missing or zero."""
    p, u = _c(predicted), _c(half_width)
    shown = p.isNotNull() & (p != 0)
    return F.when(shown, F.greatest(F.lit(0.0), p - u)), F.when(shown, p + u)


def radar_value(metric: Column | str, scale: float = 1.0, ceiling: float = 100.0) -> Column:
    return F.least(F.coalesce(_c(metric), F.lit(0.0)) * scale, F.lit(ceiling))
