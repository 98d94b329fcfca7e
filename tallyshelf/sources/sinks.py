"""Writers for processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyshelf.sources.paths import extension

PARTITION_COLUMNS = ("OrderYear", "OrderMonth")


def write_table(df: DataFrame, path: str, *, max_records_per_file: int = 5_000_000, only_these_months: bool = False) -> None:
    """CSV (header, no index) or parquet by extension; parquet is laid out by order year and month.

    The rebalance hint lets AQE cut a month that outgrows a task into several files. With ``only_these_months`` the
    months that occur in the rows replace what is stored of them, and all others stay: a month can be written again alone,
    and a job that is run again changes nothing.
    """
    kind = extension(path)
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unsupported output format {kind!r}: use csv or parquet")
    parts = [c for c in PARTITION_COLUMNS if c in df.columns]
    if only_these_months and (kind == "csv" or not parts):
        raise ValueError(f"only parquet tables with {' and '.join(PARTITION_COLUMNS)} can be replaced by month")
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
        return
    if parts:
        df = df.hint("rebalance", *parts)
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
    writer = writer.option("partitionOverwriteMode", "dynamic" if only_these_months else "static")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
