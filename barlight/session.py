"""Spark session with the settings that the library's results rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Time zone and partition handling that results depend on; the rest is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(app: str = "barlight") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for k, v in REQUIRED.items():
        b = b.config(k, v)
    return b


def require(spark: SparkSession) -> SparkSession:
    """Set the required options on a session made elsewhere."""
    for k, v in REQUIRED.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables on the way that the session names in spark.checkpoint.dir, or that was set before.

    Where neither is, one is made up if all runs on this machine, as in tests. On a cluster each executor would write to its
    own disk, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()
