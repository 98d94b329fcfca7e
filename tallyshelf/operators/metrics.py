"""Forecast quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.schema import require_columns


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R2 and MAPE in one aggregate, per group if asked.

    MAPE is in percent and replaces a true 0 by 1e-8. For constant truth R2 is 1 when the
    forecast is exact, else 0.
    """
    require_columns(df, actual, predicted, *by)
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y = F.col(actual).cast("double")
    error = y - F.col(predicted).cast("double")
    divisor = F.when(y == 0, 1e-8).otherwise(y)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("_var"),
        (F.min(y) == F.max(y)).alias("_constant"),
        F.max(F.abs(error)).alias("_worst"),
        (F.avg(F.abs(error / divisor)) * 100).alias("mape"),
    )
    r2 = (
        F.when(F.col("n") < 2, None)
        .when(F.col("_constant"), F.when(F.col("_worst") == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.try_divide(F.col("mse"), F.col("_var")))
    )
    return sums.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mape")
