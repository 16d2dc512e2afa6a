"""Names, slugs, ids and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def city_slug(name: Column | str) -> Column:
    """Lower case, each space becomes an underscore."""
    return F.replace(F.lower(_c(name)), F.lit(" "), F.lit("_"))


def hyphen_alias(slug: Column | str) -> Column:
    return F.replace(_c(slug), F.lit("_"), F.lit("-"))


def _runs_to(value: Column | str, sep: str) -> Column:
    text = F.lower(F.trim(F.coalesce(_c(value), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def warehouse_slug(value: Column | str) -> Column:
    return _runs_to(value, "_")


def url_slug(value: Column | str) -> Column:
    return _runs_to(value, "-")


def station_slug(value: Column | str) -> Column:
    """Every single non-alphanumeric character becomes an underscore."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(_c(value)), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", ""
    )


def safe_model_name(name: Column | str) -> Column:
    """Lower case with ``+`` spelled out, hyphen and space as underscore."""
    out = F.lower(_c(name))
    for old, new in (("+", "plus"), ("-", "_"), (" ", "_")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def artifact_model_name(name: Column | str) -> Column:
    """Alphanumeric runs joined by single underscores."""
    return _runs_to(name, "_")


def run_id(pipeline: Column | str, started_at: Column | str) -> Column:
    safe = F.regexp_replace(_c(pipeline), r"[^\p{L}\p{N}_-]", "_")
    return F.concat(safe, F.lit("-"), F.date_format(_c(started_at), "yyyyMMdd'T'HHmmssSSSSSS'Z'"))


def benchmark_forecast_id(city: Column, model: Column, issued: Column, hour: Column) -> Column:
    return F.concat_ws(
        "-",
        city,
        safe_model_name(model),
        F.date_format(issued, "yyyyMMdd'T'HHmmss'Z'"),
        F.lpad(hour.cast("string"), 3, "0"),
    )


def baseline_forecast_id(city: Column, issued: Column, hour: Column) -> Column:
    padded = F.when(hour < 10, F.concat(F.lit("0"), hour.cast("string"))).otherwise(hour.cast("string"))
    return F.concat(city, F.lit("_"), F.date_format(issued, "yyyyMMddHHmmss"), F.lit("_h"), padded)


def archive_path(root: str, slug: Column, run_end: Column, run: Column) -> Column:
    return F.concat(
        F.concat_ws("/", F.lit(root), slug, F.date_format(run_end, "yyyy/MM/dd"), run),
        F.lit(".csv.gz"),
    )


def title_case(name: Column | str) -> Column:
    return F.initcap(_c(name))


def source_kind(path: Column | str, kinds: dict[str, str], default: str) -> Column:
    """First marker contained in the path decides, in the order given."""
    text = F.lower(F.replace(_c(path), F.lit("\\"), F.lit("/")))
    out = F.lit(default)
    for marker, kind in reversed(kinds.items()):
        out = F.when(text.contains(marker), F.lit(kind)).otherwise(out)
    return out


def source_env(kind: Column | str, prefix: str, hosted: str, local: str) -> Column:
    return F.when(_c(kind).startswith(prefix), F.lit(hosted)).otherwise(F.lit(local))


def config_fingerprint(parts: dict[str, list[Column]]) -> Column:
    """``h=.. layers=..`` with the first present alternative of each part, else ``-``."""
    return F.concat_ws(
        " ",
        *[
            F.concat(F.lit(f"{label}="), F.coalesce(*[c.cast("string") for c in options], F.lit("-")))
            for label, options in parts.items()
        ],
    )


# Learning family of each model in the comparison table.
MODEL_PHASES = {
    "ARIMA": "Statistical",
    "SARIMA": "Statistical",
    "VAR": "Statistical",
    "SVR": "Classical ML",
    "Random_Forest": "Classical ML",
    "XGBoost": "Classical ML",
    "LightGBM": "Classical ML",
    "RNN": "DL Sequence",
    "LSTM": "DL Sequence",
    "GRU": "DL Sequence",
    "BiLSTM": "DL Sequence",
    "CNN-LSTM": "DL Hybrid",
    "CNN-GRU": "DL Hybrid",
    "BiLSTM_Attention": "DL Hybrid",
    "Transformer": "Transformer",
    "Informer": "Transformer",
    "Autoformer": "Transformer",
    "ST-GCN": "Spatio-Temporal",
}
# Served models as key, tier, family, display name, dashboard category.
MODEL_REGISTRY = (
    ("xgboost", 1, "Tree Ensemble", "XGBoost", "Best"),
    ("lightgbm", 1, "Tree Ensemble", "LightGBM", "Best"),
    ("random_forest", 1, "Tree Ensemble", "Random Forest", "Best"),
    ("cnn_lstm", 2, "DL Hybrid", "CNN-LSTM", "DL Best"),
    ("gru", 2, "DL Sequence", "GRU", "DL Best"),
    ("transformer", 2, "Transformer", "Transformer", "DL Best"),
    ("svr", 3, "Support Vector", "SVR", "Good"),
    ("bilstm", 3, "DL Sequence", "BiLSTM", "Good"),
)


def lookup(key: Column | str, table: dict[str, object], default: object = None) -> Column:
    """Map a column through a small fixed table."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = mapping[_c(key)]
    return found if default is None else F.coalesce(found, F.lit(default))


def model_phase(model: Column | str) -> Column:
    return lookup(model, MODEL_PHASES)


def model_attribute(key: Column | str, attribute: str) -> Column:
    index = {"tier": 1, "family": 2, "name": 3, "category": 4}[attribute]
    return lookup(key, {row[0]: row[index] for row in MODEL_REGISTRY})


def run_severity(state: Column | str) -> Column:
    s = _c(state)
    return F.when(s == "failed", "critical").when(s.isin("running", "queued"), "info")


def run_message(dag: Column, state: Column, when: Column) -> Column:
    failed = F.concat(dag, F.lit(" failed at "), F.coalesce(when, F.lit("unknown time")))
    waiting = F.concat(dag, F.lit(" is currently "), state)
    return F.when(state == "failed", failed).when(state.isin("running", "queued"), waiting)
