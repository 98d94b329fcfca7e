"""Invoice lines cleaned as they land.

The row rules and derived columns keep no state, so the job needs no watermark and restarts from its
checkpoint. Removal of copies keeps the lines of a stretch of time: a copy must land while its original is
within the delay. Capping looks at the whole table and stays in the batch job that reads the landed result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyshelf.operators.cleaning import CleaningRules, apply_row_rules
from tallyshelf.operators.features import add_features
from tallyshelf.schema import RAW_RETAIL_SCHEMA
from tallyshelf.sources.files import type_columns
from tallyshelf.sources.sinks import PARTITION_COLUMNS


def landing_stream(
    spark: SparkSession, folder: str, schema: StructType = RAW_RETAIL_SCHEMA, date_formats: Sequence[str] = ()
) -> DataFrame:
    """CSV files appearing in a folder, typed; a file with another header stops the stream instead of being misread."""
    raw = spark.readStream.schema(schema).options(header=True, escape='"', enforceSchema=False).csv(folder)
    return type_columns(raw, date_formats)


def processed_stream(lines: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    return add_features(apply_row_rules(lines, rules))


# Tasks that write one month of a batch: a file each, however many tasks came before.
WRITERS = 16


def without_copies(lines: DataFrame, delay: str = "40 days", ts: str = "InvoiceDate", by: Sequence[str] = ()) -> DataFrame:
    """Lines that have not landed before; their state goes once the newest line is `delay` past them.

    Copies agree in all columns. `by` may name those that the others follow from; only these are kept as state.
    Lines older than that when they land are dropped: they can no longer be told from copies.
    """
    stamped = lines.withColumn("_stamp", F.to_timestamp_ltz(F.col(ts).cast("string"))).withWatermark("_stamp", delay)
    return stamped.dropDuplicatesWithinWatermark(list(by) or lines.columns).drop("_stamp")


def write_stream(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed so far to a partitioned parquet table, then stop.

    The lines of a month are brought to a few tasks, so that not every task writes a file for every month.
    """
    parts = [c for c in PARTITION_COLUMNS if c in lines.columns]
    if parts:
        rest = [c for c in lines.columns if c not in parts]
        lines = lines.repartition(*parts, F.pmod(F.xxhash64(*rest), F.lit(WRITERS)))
    return (
        lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(*parts).outputMode("append").trigger(availableNow=True).start()
    )
