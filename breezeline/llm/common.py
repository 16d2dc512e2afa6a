"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Send this module's functions to the executors by value, so that they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

def sent_by_value(spark: SparkSession, thing: object) -> Callable[[], Any]:
    """Broadcast an object of bounded size with its class by value (a broadcast alone names the class, which a worker
    without the library cannot find). The function gives it back in a task; a worker unpacks it once."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(thing))

    def get() -> Any:
        if not hasattr(packed, "unpacked"):
            packed.unpacked = pickle.loads(packed.value)
        return packed.unpacked

    return get


# Stands for a null id while rows travel: it sorts last and is turned back into null in results.
NULL_ID = 2**63 - 1


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(name: str) -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows out by the columns, as many partitions as any other shuffle has."""
    return df.repartition(shuffle_width(df.sparkSession), *cols)


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Cut sorted frames anew so that no run of equal keys is split between two of them."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        values = [frame[k].to_numpy() for k in keys]
        edge = np.zeros(len(frame), bool)
        for v in values:
            edge[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(edge)
        if kept and any(kept[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values)):
            yield pd.concat(kept, ignore_index=True)
            kept = []
        if len(starts):
            kept.append(frame.iloc[: starts[-1]])
            yield pd.concat(kept, ignore_index=True)
            kept = []
        kept.append(frame.iloc[starts[-1] if len(starts) else 0 :])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers where runs of equal keys begin, and the row count at the end."""
    edge = np.zeros(len(frame), bool)
    edge[:1] = True
    for k in keys:
        v = frame[k].to_numpy()
        edge[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(edge), len(frame))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of 0..n-1 over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
