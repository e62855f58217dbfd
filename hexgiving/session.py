"""Spark session settings and the shared working folder.

Cluster settings (shuffle partitions, executor memory) belong to whoever
launches the job; this module only fills in what is unset, so the same code
runs under ``spark-submit`` on a cluster and in ``local[N]`` tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on. AQE re-plans joins and aggregates from
# runtime sizes, coalesces small shuffle partitions and splits skewed join
# partitions, which is how one hot key (a zip holding a third of all rows)
# stays out of a single task.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Launch-time settings that only a local run made here (``master`` given) adds.
LOCAL_RUN = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one.

    Only what the caller passes is fixed here. On a cluster pass nothing:
    master, memory and every ``spark.*`` value come from the submitter, and
    the library's ``DEFAULTS`` are set at run time only where the submitter
    left them unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    conf = {"spark.app.name": app_name} if app_name else {}
    if master:
        conf |= {"spark.master": master} | LOCAL_RUN
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder
    for key, value in (conf | (extra or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql.") and not given.contains(key):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by whoever runs the job and points at storage
    every executor can reach; if it is missing there, this fails rather than
    fall back to a machine-local folder. Only in local mode (tests) is a
    fresh temporary folder created and registered when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on storage shared by all executors")
        configured = tempfile.mkdtemp(prefix="hexgiving-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/hexgiving/{name}-{uuid.uuid4().hex[:12]}"
