"""Session helpers: a sensible local session and the shared work folder.

On a cluster the caller owns the ``SparkSession``; these helpers only fill in
settings that are unset.  ``shared_dir`` always prefers the folder the cluster
names in ``spark.checkpoint.dir`` and only creates a local one when none is
configured (tests, laptops).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    # AQE re-plans at runtime: coalesces small shuffle partitions, splits
    # skewed ones and turns a shuffle join into a broadcast join only when
    # the measured build side is below the (size-checked) threshold.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce to the advisory size, not to one partition per core: small
    # results become few tasks, big ones stay ~128 MB per task
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "txrisk", **conf) -> SparkSession:
    """Return a session with AQE on; ``master`` is only set when given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.setdefault("spark.ui.enabled", "false")
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on sessions without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions expose no SparkContext
        return None


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach, under the session's checkpoint dir.

    ``spark.checkpoint.dir`` (or the SparkContext's checkpoint dir) is read
    from the session.  Only when neither is set and the master is local (one
    machine) is a fresh local folder created and registered as the checkpoint
    dir; a cluster must name a shared one.
    """
    sc = _context(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
    if not base:
        if sc is None or not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="txrisk-ckpt-")
        sc.setCheckpointDir(base)
    elif sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return os.path.join(base, *parts) if parts else base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder (never reused, never cleared)."""
    return shared_dir(spark, "txrisk", f"{name}-{uuid.uuid4().hex[:12]}")


def scaled_conf(input_bytes: int, total_cores: int, partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Shuffle and split sizes for a cluster run over ``input_bytes`` of input.

    Scan splits are ``partition_bytes`` (128 MB) so each task's input fits
    executor memory.  The shuffle starts with enough partitions for the
    widest stage (input size / partition size, at least 3 per core) and AQE
    coalesces them at runtime to ``partition_bytes`` each;
    skewed partitions above 4x the median and 256 MB are split.
    Apply with ``spark.conf.set`` before running queries (all are SQL confs).
    """
    initial = max(3 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    }
