"""Profiles: shape, nulls, describe, previews, column kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.quantiles import approximate_quantiles, quantiles
from tallyshelf.schema import kind_of, require_kind


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: its kind and how many values are missing, from one aggregate."""
    counted = df.agg(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kind_of(f.dataType)).alias("kind"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_missing"),
            ).alias(f"c{i}")
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counted.select(F.inline(F.array(*counted.columns)))


def total_missing(df: DataFrame) -> DataFrame:
    return column_profile(df).agg(F.sum("n_missing").alias("n_missing"))


def describe(df: DataFrame, columns: Sequence[str], *, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles (exact, or from a sketch) and max of numeric columns, one row per column."""
    for c in columns:
        require_kind(df, c, "numeric")
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(f"m_{c}")
            for c in columns
        ]
    )
    cuts = (quantiles if exact else approximate_quantiles)(df, columns, (0.25, 0.5, 0.75)).select(F.struct(*columns)).scalar()
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"m_{c}.{n}").alias(n) for n in ("count", "mean", "std", "min")],
            *[cuts[c][i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
            F.col(f"m_{c}.max").alias("max"),
        )
        for c in columns
    ]
    return moments.select(F.inline(F.array(*rows)))


def preview(df: DataFrame, n: int = 5, *order) -> DataFrame:
    """First rows; give an order for a repeatable answer."""
    return (df.orderBy(*order) if order else df).limit(n)
