"""Spark session construction and cluster-facing settings."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces/splits
# shuffle partitions at runtime from real sizes; skew-join splits hot keys.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "revlens", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the scale settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set one only where it is unset.

    The fallback (tests, laptops) is only taken when the session names no
    shared folder and runs in local mode; on a cluster without the setting
    this raises instead of writing to a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        # executors and driver must see the same folder; a local one would split the table
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    target = configured or fallback or os.path.join(os.environ.get("TMPDIR", "/tmp"), "revlens-checkpoints")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def materialize(df):
    """Compute ``df`` once and continue from the stored copy.

    Used where one aggregate feeds both a scalar subquery (bounds, totals)
    and the main query: without it each consumer re-scans the source. The
    copy is a Parquet table in the shared ``spark.checkpoint.dir`` (columnar,
    written by the executors in parallel, readable after an executor is
    lost) and the lineage is cut there. Hadoop deletes it when the driver ends.
    """
    path = stored_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shared(df):
    """A stored copy of ``df`` for the length of a ``with`` block; its folder is deleted when the block ends.

    For inputs that several results are written from (O-09): the copy lives as
    long as its users and not as long as the driver.
    """
    path = stored_path(df.sparkSession, "shared")
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def co_partitioned(spark: SparkSession):
    """Joins planned in this block keep a partitioning by some of their keys, dealt out by the caller, and don't shuffle by all of them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stored_path(spark: SparkSession, tag: str = "tables") -> str:
    """A new path in the shared ``spark.checkpoint.dir``; Hadoop deletes it when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/revlens-{tag}/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)  # the driver owns the copy
    return path
