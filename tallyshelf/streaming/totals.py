"""Totals kept up to date as lines land.

The sums live in the state of the stream. Each micro-batch hands on the totals of the keys it changed, which are
stored under the number of the batch: a batch that is replayed after a failure writes the same folder again and
changes nothing. What holds now is, for each key, its row of the last batch; folding the folders together keeps
reading cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyshelf.sources.paths import path_exists

BATCH = "batch"
CHANGES, FOLDED = "changes", "folded"


def put_batch(changed: DataFrame, batch: int, path: str) -> None:
    """Store the changed totals of one batch; the same batch again replaces itself."""
    changed.write.mode("overwrite").parquet(f"{path}/{CHANGES}/{BATCH}={batch}")


def keep_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Bring the stored totals up to what has landed so far, then stop; `totals` is a streaming aggregate by key."""
    return (
        totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda changed, batch: put_batch(changed, batch, path)).start()
    )


def _all_changes(spark: SparkSession, path: str) -> DataFrame:
    changes = spark.read.parquet(f"{path}/{CHANGES}").withColumn(BATCH, F.col(BATCH).cast("long"))
    if path_exists(spark, f"{path}/{FOLDED}"):
        changes = changes.unionByName(spark.read.parquet(f"{path}/{FOLDED}/*"))
    return changes


def current_totals(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last stored row of every key."""
    changes = _all_changes(spark, path)
    values = [c for c in changes.columns if c not in (*keys, BATCH)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_last"))
    return last.select(*keys, "_last.*")


def fold(spark: SparkSession, path: str, keys: Sequence[str], upto: int) -> None:
    """Write one row per key of all batches up to a number; reading again gives the same totals, from fewer rows.

    The folded rows keep the number of their batch, so batches that are still there, or come again, do no harm.
    """
    changes = _all_changes(spark, path).where(F.col(BATCH) <= upto)
    values = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_last")).select(*keys, "_last.*")
    last.write.mode("overwrite").parquet(f"{path}/{FOLDED}/upto={upto}")
