"""Spark session settings shared by jobs, tests and the bench.

Everything here is plain Spark configuration.  On a cluster the session is
created by the platform and only the SQL settings in ``SQL_SETTINGS`` are
applied (they are session-scoped and safe to set at run time).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Session-scoped SQL settings every job relies on.
SQL_SETTINGS = {
    # Dates are parsed from text and compared with an external oracle.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffles, split skewed join
    # partitions, switch to broadcast when a side turns out to be small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows of pixels and runs take many times their shuffled bytes when sorted:
    # a task's share is small, so that its memory does not follow the input.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Windows and joins keyed on (image_id, ...) reuse a partitioning on
    # image_id alone instead of shuffling again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows with long texts or pixel arrays go to Python in small batches.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def apply_sql_settings(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(cpus: str | int = "*", shuffle_partitions: int | None = None,
                  app: str = "cohort_spark", driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench (UI off, no ports beyond Spark's own)."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is left alone.
    Only when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="cohort-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that
    Python functions find it where only the driver has the repository on its path."""
    sc = spark.sparkContext
    if getattr(sc, "_cohort_package", False):
        return
    root = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="cohort-package-"), "cohort_spark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path(root.name) / path.relative_to(root)))
    sc.addPyFile(target)
    sc._cohort_package = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df):
    """Cut the lineage of a (small or batch-sized) intermediate table.

    The rows are written to the shared checkpoint folder (``spark.checkpoint.dir``)
    so a lost executor never forces the upstream work to be redone, and the
    physical partitioning is kept, so later aggregates on the same keys need
    no shuffle.  The table is persisted for the duration of the write only,
    so it is computed once.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def stored(df, name: str):
    """The rows of ``df``, written once as Parquet under the shared checkpoint folder.

    Unlike ``materialize`` the files are columns, cheap to write and read, their size is
    known to the planner and small shuffles are merged before the write; the
    physical partitioning is not kept.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
