"""Spark session settings the library relies on.

Only settings that change *results* are forced (UTC session zone, ANSI mode);
everything else is a default that a cluster's own configuration overrides.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every analysis assumes. The session zone matters because the time
# columns are timestamp_ntz and date_format() goes through the session zone.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Execution defaults, applied only where the cluster has not set them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # Joins whose sides grow with the data are planned as shuffle joins; AQE
    # turns one into a broadcast join only after it has measured the side.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "stagelight",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the library's required settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    launched = SparkConf()  # what spark-submit / spark-defaults already set
    defaults = {k: v for k, v in DEFAULT_CONF.items() if not launched.contains(k)}
    for key, value in {**defaults, **REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings (UTC zone, ANSI mode) to an existing
    session; nothing else is touched and no folder is made."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local tests) is a scratch folder chosen here. A Spark Connect session has
    no SparkContext; its server's configuration governs checkpoints.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # Only materialization needs it; it raises when the folder is missing.
            return None
        configured = tempfile.mkdtemp(prefix="stagelight-ckpt-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def new_shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder, for tables that a
    session derives and reads again."""
    root = ensure_checkpoint_dir(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return f"{root.rstrip('/')}/stagelight-{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that the library made, wherever the cluster keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
