"""Session helpers: settings every job needs, and the shared folder for staged tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STAGING_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}

# Labels and calendar buckets assume wall-clock time without a zone, so the session
# zone is pinned; AQE picks partition counts, join strategy and skew splits at run time.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "tallyshelf", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    A session without one is an error, except in local mode, where driver and executors are one process.
    """
    root = spark.conf.get(STAGING_CONF, None) or _local_roots.get(spark.sparkContext.applicationId)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {STAGING_CONF} to a folder that the driver and all executors share")
        root = _local_roots[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tallyshelf-")
    return f"{root.rstrip('/')}/tallyshelf/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same table read back from the shared folder: what follows starts there, also after a lost executor."""
    path = staging_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started from."""
    context = spark.sparkContext
    if getattr(context, "_tallyshelf_shipped", False):
        return
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="tallyshelf-package-"), "tallyshelf")
    context.addPyFile(shutil.make_archive(base, "zip", parent, "tallyshelf"))
    context._tallyshelf_shipped = True
