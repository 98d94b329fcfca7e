"""Path rules: format by extension, output names, existence on any Hadoop file system."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def extension(path: str) -> str:
    """Lower-cased text after the last dot of the last path segment ('' when there is none)."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def processed_path(path: str) -> str:
    """``data/sales.xlsx`` -> ``data/sales_processed.parquet``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name else name
    return f"{folder}/{stem}_processed.parquet" if folder else f"{stem}_processed.parquet"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def stored_or(
    spark: SparkSession, path: str, read: Callable[[str], DataFrame], otherwise: Callable[[], DataFrame]
) -> DataFrame:
    """Read the stored copy when it is there, else whatever ``otherwise`` provides."""
    return read(path) if path_exists(spark, path) else otherwise()
