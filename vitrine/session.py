"""Session construction and the shared scratch location.

Intermediate tables (CSV round trips, written snapshots) go below the
cluster's checkpoint directory, which must be a shared file system on a
real cluster.  The directory is read from the session; a private one is
created only when nothing is configured and the master is ``local[...]``,
and is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet scans: 128 MiB splits keep a task's input bounded at any scale.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(
    master: str | None = None,
    app_name: str = "vitrine",
    shuffle_partitions: int | None = None,
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with AQE on, UI off, UTC time zone and Arrow enabled."""
    master = master or os.environ.get("VITRINE_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_single_machine(master: str) -> bool:
    """True for ``local`` and ``local[...]``: driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint directory of the session.

    Reads ``spark.checkpoint.dir`` (or the directory already set on the
    context).  When neither is set, a private directory is created, installed
    and deleted at exit on a ``local[...]`` master; any other master raises,
    since its executors could not see such a folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set in the SQL conf either
            configured = None
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not is_single_machine(sc.master):
        raise ValueError(
            f"spark.checkpoint.dir is not set and the master is {sc.master!r}: scratch tables need a "
            "folder that the driver and all executors share"
        )
    local = tempfile.mkdtemp(prefix="vitrine-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint directory."""
    path = f"{checkpoint_root(spark)}/vitrine/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """Number of scratch tables so far, to clear from."""
    return len(_SCRATCH)


def clear_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch tables written from number ``since`` on, but the last ``keep``; returns how many there are left.

    Call it when their results have been consumed: a long-running session would keep
    a copy for every query otherwise.  ``clear_scratch(spark, len_before)`` after a
    query removes just that query's tables and leaves shared ones.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    end = max(since, len(_SCRATCH) - keep)
    for path in _SCRATCH[since:end]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _SCRATCH[since:end]
    return len(_SCRATCH)


def materialize(df):
    """Cache a small intermediate table that an operator reads several times.

    Lineage is kept, so a block lost with an executor is recomputed.  Used
    only for tables whose size is bounded by groups x bins / strata, never
    for row-level data.
    """
    cached = df.cache()
    cached.count()
    return cached


def reliable_checkpoint(df, name: str = "step"):
    """Write ``df`` as Parquet below the shared checkpoint folder and scan it.

    Cuts lineage with a written table that survives executor loss (never a
    local checkpoint) and computes the plan once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    written._scratch_path = path
    return written


def discard(*tables) -> None:
    """Delete tables of :func:`reliable_checkpoint` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if table._scratch_path in _SCRATCH:
            _SCRATCH.remove(table._scratch_path)
