"""Train and test parts of a table of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _at_rank(df: DataFrame, keys: Sequence[str], rank: Column) -> Row:
    """The key of the row with the given rank (from 1) in key order, and the rows with a smaller key.

    Rows are counted per key, the counts are laid out by key range, and only the range that
    holds the rank is ranked, so no task ever sees more than one range. ``rank`` may use the
    total number of rows, ``_total``. One row reaches the driver.
    """
    key = F.struct(*keys).alias("_key")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranges = (
        counts.repartitionByRange(*keys)
        .select(key, "_n")
        .withColumn("_part", F.spark_partition_id())
        .groupBy("_part")
        .agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"), F.sum("_n").alias("_size"))
    )
    # one row per range from here on
    running = Window.orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.select(
        "_lo", "_hi", "_size", (F.sum("_size").over(running) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias("_total"),
    ).withColumn("_rank", rank)
    holding = ranges.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_size")))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_lo").orderBy("_key"))
    ranked = (
        counts.select(key, "_n").join(F.broadcast(holding), F.col("_key").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_upto", upto)
        .where(F.col("_upto") >= F.col("_rank"))
        .select(F.struct("_key", (F.col("_upto") - F.col("_n")).alias("_smaller"), "_rank").alias("_hit"))
    )
    return ranked.agg(F.min("_hit").alias("_hit")).first()["_hit"]


def _literal(value, data_type: T.DataType) -> Column:
    # a wall-clock time keeps its digits as text, whatever zones driver and session are in
    return F.lit(str(value) if isinstance(data_type, T.TimestampNTZType) and value is not None else value).cast(data_type)


def ordered_split(df: DataFrame, order: Sequence[str], test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train part first, then the last ceil(test_size * n) rows in the given order.

    The cut is found on the leading order column first, whose values repeat a lot; only the rows
    that tie with it are compared on the full key. Ties beyond ``order`` are broken by all other
    columns, so only rows equal in every column stay together at the cut. Finding the cut runs
    two jobs; the parts themselves are plain filters that reach the scan.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    types = {f.name: f.dataType for f in df.schema.fields}
    lead = order[0]
    full = [*order, *[c for c in df.columns if c not in order]]
    share = F.col("_total") - F.ceil(F.col("_total") * F.lit(test_size))
    at = _at_rank(df, [lead], share)
    if at is None:  # no rows, or a train part of none
        return df.limit(0), df
    edge = _literal(at["_key"][lead], types[lead])
    tied = df.where(F.col(lead).eqNullSafe(edge))
    last = _at_rank(tied, full, F.lit(at["_rank"] - at["_smaller"]))["_key"]
    in_train = F.struct(*full) <= F.struct(*[_literal(last[c], types[c]).alias(c) for c in full])
    # nulls sort first; the conditions on the leading column alone serve the scan
    train = df.where((F.col(lead).isNull() | (F.col(lead) <= edge)) & in_train)
    test = df.where((F.col(lead) >= edge) & ~in_train) if at["_key"][lead] is not None else df.where(~in_train)
    return train, test


def random_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Seeded random split by share.

    Each row's part follows from a hash of the seed and its key (all columns unless named), so it does not depend on
    how the rows are distributed, and rows with equal keys stay together.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key or df.columns)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    draw = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return df.where(draw >= test_size), df.where(draw < test_size)
