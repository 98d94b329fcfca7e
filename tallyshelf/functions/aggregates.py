"""Aggregators picked by name; all skip missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATORS = ("sum", "mean", "median", "first", "last", "count")
# aggregators whose empty bucket is 0, not missing
ZERO_WHEN_EMPTY = ("sum", "count")


_TIMES = (T.TimestampNTZType, T.TimestampType, T.DateType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def order_of(df: DataFrame, names: Sequence[str], value: str) -> Column:
    """One comparable column for the order by `names`, then the value.

    A time, alone or followed by one whole number, is packed into a decimal of fixed width (microseconds times 10^19
    plus the number), which hash aggregates can update in place; a struct would make Spark sort all rows. With a
    whole number as the tie-break the value itself is not looked at.
    """
    types = [df.schema[n].dataType for n in names]
    if len(names) == 2 and isinstance(types[0], _TIMES) and isinstance(types[1], _WHOLE):
        start = F.lit("1970-01-01 00:00:00").cast(types[0])
        micros = F.timestamp_diff("MICROSECOND", start, F.col(names[0])).cast("decimal(19,0)")
        return (micros * F.lit(10**18).cast("decimal(19,0)") * 10 + F.col(names[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*names, value)


def named_aggregate(how: str, value: Column, order: Column) -> Column:
    """Aggregate expression for every name except ``median``, which needs its own plan.

    ``order`` decides what first and last mean; it should be unique within a group.
    """
    if how == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if how == "mean":
        return F.avg(value)
    if how == "count":
        return F.count(value)
    if how in ("first", "last"):
        # a null ordering value takes the row out of the running
        present = F.when(value.isNotNull(), order)
        return (F.min_by if how == "first" else F.max_by)(value, present)
    raise ValueError(f"unknown aggregator {how!r}: use one of {', '.join(AGGREGATORS)}")
