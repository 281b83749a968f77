"""The session that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "lamina", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic, adaptive execution and Arrow. A master and sizes are the cluster's to set, or given here."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the one that ``spark.checkpoint.dir`` names. Where none is named, a new one on a single machine, as in tests; on a cluster that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lamina-")


def scratch(spark: SparkSession) -> str:
    """The path of a new file or folder in :func:`shared_folder`."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
