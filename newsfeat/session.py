"""Session helpers.

Library functions never create a session themselves; they take the one they
are given.  ``build_session`` is for tests, scripts and the bench only.
"""

from __future__ import annotations

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for exact results (wall-clock timestamps are
# compared in UTC) and for sane plans at any scale (AQE re-plans joins from
# runtime sizes, coalesces small shuffle partitions and splits skewed ones).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Reliable checkpoints live on shared storage; drop them once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "newsfeat", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("NEWSFEAT_DRIVER_MEMORY", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/newsfeat-checkpoints") -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset and
    the master runs in this one process (tests, a laptop) is ``fallback`` used.
    On a cluster an unset folder is an error: executors can be lost at any time,
    so intermediate tables must not land on one machine's own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not _single_process(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or fallback)
    return sc.getCheckpointDir()


def _single_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for written tables.  The
    path is deleted when the driver's file system is closed."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/newsfeat-{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping: dict = {"lock": threading.Lock(), "inside": 0, "before": None}


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of what runs here as soon as it is done,
    not when the driver next happens to collect its garbage.  Of threads that are
    inside at a time the last one restores the setting."""
    with _dropping["lock"]:
        if not _dropping["inside"]:
            _dropping["before"] = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _dropping["inside"] += 1
    try:
        yield
    finally:
        with _dropping["lock"]:
            _dropping["inside"] -= 1
            if not _dropping["inside"]:
                if _dropping["before"] is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, _dropping["before"])


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, survives the loss of executors and is planned from its real size.
    The shuffles that made it are deleted."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``written_table`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("newsfeat-"):
            raise ValueError(f"{folder} is no written table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
