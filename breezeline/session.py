"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.debug.maxToStringFields": "300",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator relies on (UTC above all)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session makes a folder of its own and records it, so that all later calls agree on
    it. On a cluster that would be a folder per machine, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.breezeline.scratch", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="breezeline-")
        spark.conf.set("spark.breezeline.scratch", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame as a table in the shared folder and read it back.

    Unlike an executor-local copy this survives the loss of executors, and unlike a row
    checkpoint the table is columnar: later branches read only the columns they use, and
    the optimizer knows its real size when it picks join strategies."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """The frame written to the shared folder for the writes inside the block, and removed
    after them; nothing lazy may outlive the block."""
    spark = df.sparkSession
    path = scratch_path(spark, "batch")
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
