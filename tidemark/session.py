"""Session settings every job in this package relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_RUNTIME_CONF = {
    # Timestamps are stored and compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joins whose partitions fit into memory look rows up instead of sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Texts and pages travel to Python in batches of few rows and bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # A provisional row replaces only the date partitions it touches.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing stays with the cluster."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Executors and the driver all read it, so a cluster must name one in
    ``spark.checkpoint.dir``. A local master, where every thread sees the
    same disk, falls back to a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(spark: SparkSession, df, partition_by: tuple[str, ...] = (), compression: str = "snappy"):
    """Cut lineage through a table in the shared folder and read it back."""
    path = shared_dir(spark)
    with shuffles_removed(spark):
        df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, which otherwise stay until the driver's memory is collected.

    A write plans its input anew, so no later step could use its shuffles.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
