"""Session settings and the shared scratch folder."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import SparkSession

# Settings every job of this library expects, whatever the cluster.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "tidemark", **conf: str) -> SparkSession:
    """Get or create a session; sizing is left to the cluster or to ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, so zone-less table times read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only accepted for a local master, where every
    task runs on this machine.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(root)
    return posixpath.join(root, f"{label}-{uuid.uuid4().hex}")


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions: the session's own measure of its width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
