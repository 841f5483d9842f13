"""Scratch tables in a folder that all machines share, and bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's scratch tables, below spark.checkpoint.dir.

    The setting is read from the session. Only a local session that has none gets a temporary folder of
    its own; on a cluster a missing setting is an error, as no local folder is seen by all machines.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="oddsmill-")
        _roots[app] = f"{base.rstrip('/')}/oddsmill-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, root: str) -> None:
    """Removes the scratch tables when the driver ends."""
    try:
        delete(spark, root)
    except Exception:  # the session is gone already; the folder is the cluster's to clean
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written inside leaves no shuffle files behind; the table that it wrote is all that is read later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared scratch folder and read back: later reads don't recompute it.

    The shuffles behind it go as soon as it is written. drop_cut deletes it; the rest goes when the driver ends.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_cut(*tables: DataFrame) -> None:
    """Deletes tables that cut wrote, when nothing that is still to run reads them."""
    for t in tables:
        delete(t.sparkSession, t.cut_path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds Arrow batches to some rows, as single texts can be very long. Lowers the session's setting only."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """small_batches for what is run inside; the session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
