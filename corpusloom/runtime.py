"""Session helpers: shared scratch tables that cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hand only up to this many rows; beyond it a shuffle join is planned.
BROADCAST_ROWS = 20_000

_scratch: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application: their Python may not have it on its path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="corpusloom-ship-")
        copy = os.path.join(folder, "src")
        shutil.copytree(here, os.path.join(copy, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "corpusloom_package"), "zip", copy))  # served by the driver
        atexit.register(shutil.rmtree, folder, True)
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, else the context's checkpoint
    folder. Where neither is set, a temporary local folder serves a local master; any other master is an error, as its
    executors would write to disks that nobody else reads."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not is_local(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def table(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the result survives the loss of
    executors, has no lineage, and its size is known to the planner. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`table` that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, path)
            _scratch[:] = [x for x in _scratch if x[1] != path]


def drop_tables() -> None:
    """Delete the scratch tables written so far."""
    while _scratch:
        _delete(*_scratch.pop())


atexit.register(drop_tables)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``rows`` rows (counted), else unhinted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
