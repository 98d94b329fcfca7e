"""Classical decomposition into trend, season and remainder, for any number of series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.operators.series import BUCKET, series_window
from tallyshelf.schema import require_kind


def _moving_average(value: Column, spec: Window, period: int, pos: Column, n: Column) -> Column:
    """Centred mean over one period; for an even period both ends count half."""
    half = period // 2
    if period % 2:
        mean = F.avg(value).over(spec.rowsBetween(-half, half))
    else:
        inner = F.sum(value).over(spec.rowsBetween(-(half - 1), half - 1))
        ends = F.lag(value, half).over(spec) + F.lead(value, half).over(spec)
        mean = (inner + 0.5 * ends) / period
    return F.when((pos >= half) & (pos < n - half), mean)


def decompose(
    series: DataFrame, value: str, period: int, model: str = "additive",
    by: Sequence[str] = (), order: str = BUCKET,
) -> DataFrame:
    """Columns trend, seasonal, resid and status next to the value.

    Trend: centred moving average, its ends continued by straight lines fitted to the first and
    last ``period`` trend points. Season: mean deviation per phase, centred. Status is ``short``
    (under two periods), ``has_nulls`` or ``non_positive`` (multiplicative); the parts of such
    series are null. All windows share the partitioning by series, so there is one shuffle.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    if period < 2:
        raise ValueError("period must be at least 2")
    require_kind(series, value, "numeric")
    require_kind(series, order, "datetime")
    additive, half = model == "additive", period // 2
    run, whole = series_window(by, order), series_window(by)

    def without(a: Column, b: Column) -> Column:
        return a - b if additive else F.try_divide(a, b)

    n, pos = F.col("_n"), F.col("_pos")
    usable = F.col("status") == "ok"
    df = series.withColumns(
        {
            "_y": F.col(value).cast("double"),
            "_pos": F.row_number().over(run) - 1,
            "_n": F.count(F.lit(1)).over(whole),
            "_present": F.count(value).over(whole),
            "_least": F.min(F.col(value).cast("double")).over(whole),
        }
    )
    status = F.when(n < 2 * period, "short").when(F.col("_present") < n, "has_nulls")
    if not additive:
        status = status.when(F.col("_least") <= 0, "non_positive")
    df = df.withColumn("status", status.otherwise("ok"))
    df = df.withColumn("_ma", F.when(usable, _moving_average(F.col("_y"), run, period, pos, n)))

    # the moving average exists at positions half .. n-1-half; the last of them is not in the tail fit
    last = n - 1 - half
    head = (pos >= half) & (pos < F.least(F.lit(half + period), last))
    tail = (pos >= F.greatest(F.lit(half), last - period)) & (pos < last)

    def line(inside: Column, name: str) -> dict[str, Column]:
        y, x = F.when(inside, F.col("_ma")), F.when(inside, pos.cast("double"))
        return {
            f"_{name}_k": F.regr_slope(y, x).over(whole),
            f"_{name}_c": F.regr_intercept(y, x).over(whole),
            f"_{name}_x": F.max(x).over(whole),
            f"_{name}_y": F.max(y).over(whole),
        }

    def on_line(name: str) -> Column:
        # a single point has no slope: the least-norm line through it is used
        x, y = F.col(f"_{name}_x"), F.col(f"_{name}_y")
        lone = y * (x * pos + 1) / (x * x + 1)
        return F.coalesce(F.col(f"_{name}_k") * pos + F.col(f"_{name}_c"), lone)

    df = df.withColumns(line(head, "h") | line(tail, "t"))
    trend = F.when(pos < half, on_line("h")).when(pos > last, on_line("t")).otherwise(F.col("_ma"))
    df = df.withColumn("trend", F.when(usable, trend))
    df = df.withColumns({"_free": without(F.col("_y"), F.col("trend")), "_phase": pos % period})
    df = df.withColumn("_index", F.avg("_free").over(series_window([*by, "_phase"])))
    # each phase once, whatever the length: the first period holds them all
    centre = F.avg(F.when(pos < period, F.col("_index"))).over(whole)
    df = df.withColumn("seasonal", F.when(usable, without(F.col("_index"), centre)))
    df = df.withColumn("resid", without(F.col("_free"), F.col("seasonal")))
    return df.select(*by, order, value, "trend", "seasonal", "resid", "status")
