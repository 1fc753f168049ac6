"""Session defaults and the shared folder used to cut lineage / stage files."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "rollscope", extra: dict | None = None) -> SparkSession:
    """A session with the settings the plans are written for.

    AQE stays on: it coalesces small shuffle partitions, turns sort-merge
    joins whose build side proves small at runtime into broadcast joins and
    splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a batch to a Python worker holds few large files or many small ones
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
        .config("spark.driver.memory", os.environ.get("ROLLSCOPE_DRIVER_MEMORY", "8g"))
        # file listing of many log folders: a bounded number of listing tasks
        # instead of one task per folder
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(max(64, 8 * shuffle_partitions)))
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage; it is read from the
    session.  Only on a local master, where it may be unset, a private folder is
    created and registered, so later calls see the same place; a cluster without
    the setting is an error, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_value = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf_value:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"{CHECKPOINT_CONF} names no shared folder for master {sc.master}")
        conf_value = tempfile.mkdtemp(prefix="rollscope-ckpt-")
    sc.setCheckpointDir(conf_value)
    return sc.getCheckpointDir() or conf_value


def data_key(sf_dir: str) -> str:
    """Folder name for what is derived from the tables below ``sf_dir``: the name and the whole path's hash."""
    path = sf_dir.rstrip("/")
    return f"{path.rsplit('/', 1)[-1]}-{hashlib.sha256(path.encode()).hexdigest()[:10]}"


def reliable_checkpoint(df):
    """``df.checkpoint()`` that computes ``df`` once.

    A reliable checkpoint writes through a second job; without a persisted
    input that job recomputes the whole lineage.  The input is persisted only
    for the duration of the checkpoint; the result lives in the shared
    checkpoint folder and survives the loss of any executor.
    """
    from pyspark import StorageLevel
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
