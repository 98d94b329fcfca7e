"""Train, hold out, forecast and score in one call, for both kinds of model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.seasonal_arma import Orders
from tallyshelf.operators.forest import default_features, fit_forest, predict_forest
from tallyshelf.operators.metrics import regression_metrics
from tallyshelf.operators.panel import fit_panel, forecast_panel
from tallyshelf.operators.series import BUCKET, length_status, prepare_series, split_tail
from tallyshelf.operators.splits import ordered_split
from tallyshelf.session import stored


@dataclass
class Holdout:
    model: PipelineModel | DataFrame
    predictions: DataFrame
    metrics: DataFrame
    status: DataFrame | None = None


def forest_holdout(
    df: DataFrame, target: str, order: Sequence[str], features: Sequence[str] | None = None, *,
    test_size: float = 0.2, trees: int = 100, max_depth: int = 10, seed: int = 42,
) -> Holdout:
    """Train on the earlier rows in the given order, score on the later ones."""
    features = list(features or default_features(df, target))
    rows = stored(df.select(*dict.fromkeys([*order, target, *features])))
    train, test = ordered_split(rows, order, test_size)
    model = fit_forest(train, target, features, trees=trees, max_depth=max_depth, seed=seed)
    predictions = predict_forest(model, test)
    return Holdout(model, predictions, regression_metrics(predictions, target, "prediction"))


def panel_holdout(
    df: DataFrame, ts: str, target: str, *, how: str = "sum", freq: str = "MS", orders: Orders = Orders(),
    exog: Mapping[str, str] | None = None, by: Sequence[str] = (), n_test: int = 12,
) -> Holdout:
    """Resample, hold out the last ``n_test`` buckets of each series, fit the rest and score.

    ``status`` tells which series are shorter than advised (``short``) or than the test part
    (``rejected``); rejected series are left out.
    """
    exog, by = dict(exog or {}), list(by)
    series = prepare_series(df, ts, target, how, freq, exog, by)
    if not by:
        by, series = ["series_key"], series.withColumn("series_key", F.lit("all"))
    series = stored(series)
    status = length_status(series, n_test, orders.d, orders.D, orders.s, by)
    usable = series.join(status.where("status <> 'rejected'").select(*by), by, "left_semi")
    train, test = split_tail(usable, n_test, by)
    model = stored(fit_panel(train, "value", orders, list(exog), by))
    path = forecast_panel(model, n_test, freq, orders, test if exog else None, list(exog))
    predictions = test.join(path, [*by, BUCKET])
    return Holdout(model, predictions, regression_metrics(predictions, "value", "forecast", by), status)
