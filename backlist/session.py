"""Session helpers.

The library never creates configuration behind the caller's back: operators
use whatever session they are given.  ``get_spark`` is for tests, the bench
and command-line use.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings chosen for the workload: AQE on (runtime coalescing and skew
# splitting), static size-estimate broadcasts off so that only shuffle
# outputs *measured* at run time below the adaptive threshold are broadcast.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no Python call site is taken down for every expression of a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(app: str = "backlist", cpus: int | str = "*", shuffle_partitions: int = 8,
              driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session.  Where nothing is configured, a local session (one
    machine, as in tests) gets a temporary folder; a cluster is refused, as
    its executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not root and jsc.getCheckpointDir().isDefined():
        root = jsc.getCheckpointDir().get()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors "
                               "share; intermediate tables and checkpoints are written there")
        root = tempfile.mkdtemp(prefix="backlist-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root, removed when
    the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path
