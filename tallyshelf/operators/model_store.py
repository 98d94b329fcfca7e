"""Saving, naming, finding and loading fitted models on any Hadoop file system."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions.seasonal_arma import Orders
from tallyshelf.operators.forest import Forest
from tallyshelf.sources.paths import path_exists

# Kinds in the names of stored models, and the time stamp behind them.
FOREST, PANEL = "RandomForest", "SARIMA"
STAMP = "%Y%m%d%H%M%S"


def model_name(kind: str, target: str, moment: dt.datetime | None = None) -> str:
    return f"{kind}_{target}_{(moment or dt.datetime.now()).strftime(STAMP)}"


def kind_from_name(name: str, default: str = FOREST) -> str:
    """Model kind guessed from a name."""
    text = name.rstrip("/").rsplit("/", 1)[-1].lower()
    if "sarima" in text:
        return PANEL
    return FOREST if "randomforest" in text or text.startswith("rf") else default


def _write_card(spark: SparkSession, path: str, card: dict) -> None:
    spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def read_card(spark: SparkSession, path: str) -> dict:
    if not path_exists(spark, f"{path}/card"):
        raise FileNotFoundError(f"no model at {path}")
    return json.loads(spark.read.text(f"{path}/card").first()["value"])


def save_forest(spark: SparkSession, model: Forest | None, path: str, target: str = "", features: Sequence[str] = ()) -> None:
    """Store the trees and, beside them, the codes of the text features."""
    if model is None:
        raise ValueError("there is no trained model to save")
    model.trees.write().overwrite().save(f"{path}/model")
    model.codes.write.mode("overwrite").parquet(f"{path}/codes")
    created = dt.datetime.now().isoformat()
    _write_card(spark, path, {"kind": FOREST, "target": target, "features": list(features), "texts": list(model.texts), "created": created})


def load_forest(spark: SparkSession, path: str) -> Forest:
    card = read_card(spark, path)
    return Forest(PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/codes"), tuple(card["texts"]))


def save_panel(
    spark: SparkSession, model: DataFrame | None, path: str, orders: Orders, freq: str, target: str = "", exog: Sequence[str] = ()
) -> None:
    """Store the coefficient table; reading it back also keeps the fit from running again."""
    if model is None:
        raise ValueError("there is no trained model to save")
    model.write.mode("overwrite").parquet(f"{path}/model")
    created = dt.datetime.now().isoformat()
    card = {"kind": PANEL, "target": target, "exog": list(exog), "freq": freq, "orders": asdict(orders), "created": created}
    _write_card(spark, path, card)


def load_panel(spark: SparkSession, path: str) -> tuple[DataFrame, Orders, str, list[str]]:
    card = read_card(spark, path)
    return spark.read.parquet(f"{path}/model"), Orders(**card["orders"]), card["freq"], card["exog"]


def newest_model(spark: SparkSession, root: str) -> str | None:
    """Path of the model stored last under a folder; only file names and times are listed."""
    if not path_exists(spark, root):
        return None
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
        .select("path", "modificationTime").where(F.col("path").contains("/card/"))
    )
    found = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    return found.rsplit("/card/", 1)[0] if found else None
