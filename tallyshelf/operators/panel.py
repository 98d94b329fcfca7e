"""Seasonal forecasting of many series at once: one small fit per series, series spread over the cluster.

Differencing, alignment and calendars are Spark windows; only the estimation of a series of
calendar buckets runs in a Python worker. The fitted model is a DataFrame with one row per
series, so it can be stored, joined and filtered like any other table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.buckets import bucket_for
from tallyshelf.functions.seasonal_arma import Orders, errors, estimate, extend
from tallyshelf.operators.series import BUCKET, difference, difference_weights
from tallyshelf.schema import require_columns

SERIES = "series_key"
_NUMBERS = T.ArrayType(T.DoubleType())
_PARTS = ("phi", "seasonal_phi", "theta", "seasonal_theta")


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(SERIES, F.lit("all")), [SERIES])


def fit_panel(
    series: DataFrame,
    value: str = "value",
    orders: Orders = Orders(),
    exog: Sequence[str] = (),
    by: Sequence[str] = (),
) -> DataFrame:
    """Fit every series; one row each with coefficients, fitted values, errors and the state to forecast from.

    ``status`` is that of ``estimate``, or has_nulls for a series with missing or infinite values, which is not
    fitted. Series must have no gaps (see ``resample``).
    """
    require_columns(series, value, BUCKET, *exog, *by)
    df, keys = _keyed(series, by)
    exog = list(exog)
    weights = difference_weights(orders.d, orders.D, orders.s)
    df = df.select(
        *keys, BUCKET, F.col(value).cast("double").alias("_y"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(exog)],
    )
    # A fixed number of partitions: left to itself, AQE packs series by bytes, and a few
    # megabytes of series are already minutes of fitting in one task.
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    levels = ["_y", *[f"_x{i}" for i in range(len(exog))]]
    for c in levels:
        df = difference(df, c, f"_d{c}", orders.d, orders.D, orders.s, keys)
    lost = len(weights) - 1

    schema = T.StructType(
        [series.schema[k] if k in series.columns else T.StructField(k, T.StringType()) for k in keys]
        + [
            T.StructField("status", T.StringType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("first_bucket", series.schema[BUCKET].dataType),
            T.StructField("last_bucket", series.schema[BUCKET].dataType),
            T.StructField("sigma2", T.DoubleType()),
        ]
        + [T.StructField(c, _NUMBERS) for c in ("beta", *_PARTS, "actual", "fitted", "resid", "z_tail", "e_tail", "level_tail")]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BUCKET)
        y = pdf["_y"].to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys}
        row |= {"n": len(y), "first_bucket": pdf[BUCKET].iloc[0], "last_bucket": pdf[BUCKET].iloc[-1], "actual": y}
        nothing = {c: [] for c in ("beta", *_PARTS, "fitted", "resid", "z_tail", "e_tail", "level_tail")}
        if not np.isfinite(pdf[levels].to_numpy(float)).all():
            return pd.DataFrame([row | nothing | {"status": "has_nulls", "sigma2": None}])
        w = pdf["_d_y"].to_numpy(float)[lost:]
        x = pdf[[f"_d_x{i}" for i in range(len(exog))]].to_numpy(float)[lost:]
        beta, parts, status = estimate(w, x, orders)
        e, z = errors(w, x, beta, parts, orders)
        known = min(lost + orders.p + orders.P * orders.s, len(y))
        resid = np.concatenate([np.full(len(y) - len(e), np.nan), e])
        resid[:known] = np.nan
        level = y - pdf[[f"_x{i}" for i in range(len(exog))]].to_numpy(float) @ beta if exog else y
        tail = max(orders.p + orders.P * orders.s, orders.q + orders.Q * orders.s, 1)
        seen = resid[~np.isnan(resid)]
        row |= dict(zip(_PARTS, parts, strict=True))
        row |= {
            "status": status, "beta": beta, "fitted": y - resid, "resid": resid,
            "sigma2": float(np.mean(seen**2)) if len(seen) else None,
            "z_tail": z[-tail:], "e_tail": e[-tail:], "level_tail": level[-max(lost, 1):],
        }
        return pd.DataFrame([row])[[f.name for f in schema.fields]]

    columns = [f.name for f in schema.fields]
    return df.groupBy(*keys).applyInPandas(lambda pdf: fit(pdf)[columns], schema)


def _model_keys(model: DataFrame) -> list[str]:
    return model.columns[: model.columns.index("status")]


def forecast_panel(
    model: DataFrame,
    steps: int,
    freq: str,
    orders: Orders = Orders(),
    future: DataFrame | None = None,
    exog: Sequence[str] = (),
) -> DataFrame:
    """The next ``steps`` buckets of every series: (keys, step, bucket, forecast, status).

    A model trained with exogenous columns needs their future values: ``future`` holds the series keys, the bucket
    and the columns, and is matched by bucket. A series that was not fitted, or lacks a future value (status
    no_future), keeps its rows with missing forecasts.
    """
    keys, rule = _model_keys(model), bucket_for(freq)
    weights = difference_weights(orders.d, orders.D, orders.s)
    if exog and future is None:
        raise ValueError("the model uses exogenous columns: pass their future values")

    def bucket_at(step: Column) -> Column:
        return rule.label(rule.advance(rule.start(F.col("last_bucket")), step * rule.every))

    rows = model
    if exog:
        future, _ = _keyed(future, [] if keys == [SERIES] and SERIES not in future.columns else keys)
        grid = model.select(*keys, "last_bucket", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
        known = future.select(*keys, BUCKET, F.array(*[F.col(c).cast("double") for c in exog]).alias("_known"))
        met = grid.withColumn(BUCKET, bucket_at(F.col("step"))).join(known, [*keys, BUCKET], "left")
        # one entry per step and series
        paths = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "_known"))).alias("_path"))
        flat = F.flatten(F.transform("_path", lambda s: F.coalesce(s["_known"], F.array_repeat(F.lit(None).cast("double"), len(exog)))))
        rows = rows.join(paths.select(*keys, flat.alias("_x")), keys, "left")
    else:
        rows = rows.withColumn("_x", F.array().cast(_NUMBERS))

    schema = T.StructType([
        *[model.schema[k] for k in keys], model.schema["last_bucket"], model.schema["status"], T.StructField("_path", _NUMBERS)])

    def path_of(row: dict) -> tuple[str, np.ndarray]:
        if row["status"] == "has_nulls":
            return "has_nulls", np.full(steps, np.nan)
        parts = [np.asarray(row[c], dtype=float) for c in _PARTS]
        path = extend(steps, row["z_tail"], row["e_tail"], row["level_tail"], weights, parts, orders)
        if not exog:
            return row["status"], path
        x = np.asarray([np.nan if v is None else v for v in row["_x"]], dtype=float)
        if len(x) != steps * len(exog) or not np.isfinite(x).all():
            return "no_future", np.full(steps, np.nan)
        return row["status"], path + x.reshape(steps, len(exog)) @ np.asarray(row["beta"], dtype=float)

    def extend_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [path_of(row) for row in batch.to_dict("records")]
            out = batch[[*keys, "last_bucket"]].copy()
            out["status"], out["_path"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    needed = [*keys, "last_bucket", "status", "beta", *_PARTS, "z_tail", "e_tail", "level_tail", "_x"]
    paths = rows.select(*needed).mapInPandas(extend_rows, schema)
    long = paths.select(*keys, "last_bucket", "status", F.posexplode("_path").alias("_i", "forecast")).withColumn("step", F.col("_i") + 1)
    forecast = F.nanvl(F.col("forecast"), F.lit(None).cast("double"))
    return long.select(*keys, "step", bucket_at(F.col("step")).alias(BUCKET), forecast.alias("forecast"), "status")


def in_sample(model: DataFrame, freq: str, first=None, last=None) -> DataFrame:
    """One-step fitted values and errors, optionally between two buckets (both included)."""
    keys, rule = _model_keys(model), bucket_for(freq)
    points = model.where(F.size("fitted") > 0).select(
        *keys, "first_bucket", F.posexplode(F.arrays_zip("actual", "fitted", "resid")).alias("_i", "_p")
    )
    points = points.withColumn("_start", rule.start(F.col("first_bucket")))

    def number(name: str):
        return F.nanvl(F.col(f"_p.{name}"), F.lit(None).cast("double")).alias(name)

    points = points.select(
        *keys, rule.label(rule.advance(F.col("_start"), F.col("_i") * rule.every)).alias(BUCKET),
        F.col("_p.actual").alias("actual"), number("fitted"), number("resid"),
    )
    if first is not None:
        points = points.where(F.col(BUCKET) >= F.lit(first))
    if last is not None:
        points = points.where(F.col(BUCKET) <= F.lit(last))
    return points


def coefficients(model: DataFrame) -> DataFrame:
    """Long table of the fitted coefficients."""
    keys = _model_keys(model)
    groups = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("values")) for c in ("beta", *_PARTS)])
    rows = model.select(*keys, "status", F.inline(groups))
    return rows.select(*keys, "status", "part", F.posexplode("values").alias("index", "value"))
