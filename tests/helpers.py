"""Small frames for comparing with pandas."""

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from breezeline.operators.blocks import Series

TINY = Series(keys=("k",), ts="ts", step_seconds=3600, block_rows=5)
START = pd.Timestamp("2024-01-01")


def random_series(seed: int, n: int = 60, series=("a", "b", "c"), gappy: bool = False, nulls: float = 0.5):
    rng = np.random.default_rng(seed)
    out = []
    for i, k in enumerate(series):
        hours = np.arange(n + 7 * i)
        if gappy:
            hours = hours[rng.random(len(hours)) > 0.6]
        x = np.round(rng.normal(50, 20, len(hours)), 2)
        y = np.round(rng.normal(5, 2, len(hours)), 2)
        x[rng.random(len(hours)) < nulls] = np.nan
        y[rng.random(len(hours)) < 0.85] = np.nan
        out.append(pd.DataFrame({"k": k, "ts": START + pd.to_timedelta(hours, unit="h"), "x": x, "y": y}))
    return pd.concat(out, ignore_index=True)


def to_spark(spark, pdf: pd.DataFrame):
    rows = [
        tuple(None if (isinstance(v, float) and np.isnan(v)) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r)
        for r in pdf.itertuples(index=False, name=None)
    ]
    kinds = {"k": "string", "ts": "timestamp"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns)
    shuffled = list(np.random.default_rng(0).permutation(len(rows)))
    return spark.createDataFrame([rows[i] for i in shuffled], schema)


def collected(df, by=("k", "ts")) -> pd.DataFrame:
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame, cols, atol=1e-9):
    assert len(got) == len(want)
    for c in cols:
        np.testing.assert_allclose(
            got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), atol=atol, rtol=1e-9, err_msg=c
        )


@contextmanager
def poisoned(files, **values):
    """Files whose columns hold these values for a while: a job that reads one of them gives wrong results."""
    held = {p: p.read_bytes() for p in files}
    for p in held:
        table = pq.ParquetFile(p).read()
        for c, v in values.items():
            at = table.schema.get_field_index(c)
            table = table.set_column(at, c, pa.array([v] * len(table), table.schema.field(c).type))
        pq.write_table(table, p)
        crc = p.with_name(f".{p.name}.crc")
        if crc.exists():
            crc.unlink()
    yield held
    for p, data in held.items():
        assert p.exists()
        p.write_bytes(data)
