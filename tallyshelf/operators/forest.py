"""Random-forest regression on rows, trained by Spark ML, or from histograms (``forest_passes``) where there are many.

Text features are coded by frequency: the most frequent value is 0, equal frequencies follow the text, and a missing
or unseen value comes after all of them. The codes are a table that is joined to the rows and stored with the model,
so a feature may have any number of values; they are numbered by a sort over all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.scalar import date_parts
from tallyshelf.operators import forest_passes
from tallyshelf.schema import columns_of_kind, kind_of, require_columns, require_kind
from tallyshelf.session import stored

MAX_DEPTH = 30  # Spark ML accepts no deeper trees
CODES_SCHEMA = "feature string, label string, code double, values bigint"
TASK_ROWS = 40_000  # fewer rows are not worth a task of their own
# The statistics of the nodes that one pass grows, per task. Every row updates them at a random place for each tree, so
# small ones that stay in a core's cache beat fewer passes by far. The trees are the same for any value.
PASS_MB = 4
# From so many training rows on, passes over binned rows grow the forest: the same trees, whose rows are drawn otherwise.
MANY_ROWS = 1_000_000


@dataclass(frozen=True)
class Forest:
    """Trees over numbers, and the codes of the text features: (feature, label, code, values), one row per value."""

    trees: PipelineModel
    codes: DataFrame
    texts: tuple[str, ...]


def default_features(df: DataFrame, target: str) -> list[str]:
    """The date parts that are present, else the first three numeric or text columns."""
    candidates = [c for c in columns_of_kind(df, "numeric") + columns_of_kind(df, "string") if c != target]
    parts = [c for c in date_parts(F.lit(None).cast("timestamp_ntz")) if c in candidates]
    return parts or candidates[:3]


def feature_columns(df: DataFrame, target: str, features: Sequence[str] | None = None) -> list[str]:
    """The named features, or every column but the target; absent ones are an error."""
    require_columns(df, target)
    if features:
        require_columns(df, *features)
        return list(features)
    return [c for c in df.columns if c != target]


def frequency_codes(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(feature, label, code, values) of every value of the text columns, numbered from 0 by falling frequency.

    `values` is how many a feature has, the code of what is missing or unseen.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("label")) for c in texts])).alias("_p")
    counted = df.select(pairs).select("_p.*").where(F.col("label").isNotNull()).groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"))
    order = ["feature", F.desc("n"), "label"]
    # the id has the partition in its high bits and the place in the partition in the low ones
    placed = stored(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    # one row per partition and feature
    sizes = placed.groupBy("feature", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("feature", "_part", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
                         F.sum("_n").over(Window.partitionBy("feature")).alias("values"))
    numbered = placed.withColumn("_part", part).join(sizes, ["feature", "_part"])
    return numbered.select("feature", "label", (F.col("_before") + F.col("_id") - F.col("_first")).cast("double").alias("code"), "values")


def _coded(df: DataFrame, texts: Sequence[str], codes: DataFrame) -> DataFrame:
    """The rows with `<feature>__code` for every text feature."""
    for c in texts:
        own = codes.where(F.col("feature") == c)
        unseen = own.agg(F.coalesce(F.max("values"), F.lit(0)).cast("double").alias("v")).scalar()
        labels = own.select(F.col("label").alias(c), F.col("code").alias(f"{c}__code"))
        df = df.join(labels, c, "left").withColumn(f"{c}__code", F.coalesce(f"{c}__code", unseen))
    return df


def _stages(df: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    texts = [c for c in features if kind_of(df.schema[c].dataType) == "string"]
    unfit = [c for c in features if kind_of(df.schema[c].dataType) not in ("string", "numeric", "boolean")]
    if unfit:
        raise ValueError(f"features must be numeric, boolean or text, not {unfit}")
    inputs = ", ".join(f"`{c}__code` AS `{c}__in`" if c in texts else f"CAST(`{c}` AS DOUBLE) AS `{c}__in`" for c in features)
    return [
        SQLTransformer(statement=f"SELECT *, {inputs} FROM __THIS__"),
        # missing numbers reach the trees as NaN and sort above every threshold
        VectorAssembler(inputCols=[f"{c}__in" for c in features], outputCol="__features", handleInvalid="keep"),
    ], texts


def _spread(rows: DataFrame) -> DataFrame:
    """The rows in enough parts for all cores; each part in a fixed order, which the bootstrap draws follow.

    Not in more: every part of the rows sends statistics of every node.
    """
    sizes = rows.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)).alias("parts"), F.sum("count").alias("rows")).first()
    parts = min(-(-(sizes["rows"] or 0) // TASK_ROWS), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    if parts <= sizes["parts"]:
        return rows
    return rows.repartition(parts).sortWithinPartitions(*rows.columns)


def fit_forest(
    train: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    *,
    trees: int = 100,
    max_depth: int = 10,
    seed: int = 42,
    max_bins: int = 64,
) -> Forest:
    """Forest with bootstrap rows, all features tried at each split and single-row leaves allowed."""
    features = feature_columns(train, target, features)
    require_kind(train, target, "numeric")
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} exceeds {MAX_DEPTH}, the deepest tree that Spark ML grows")
    forest = RandomForestRegressor(
        featuresCol="__features", labelCol="__label", predictionCol="prediction", numTrees=trees,
        maxDepth=max_depth, seed=seed, maxBins=max_bins, featureSubsetStrategy="all",
        minInstancesPerNode=1, bootstrap=True, subsamplingRate=1.0, maxMemoryInMB=PASS_MB,
    )
    rows = train.select(*features, F.col(target).cast("double").alias("__label")).where("__label IS NOT NULL")
    stages, texts = _stages(rows, features)
    codes = train.sparkSession.createDataFrame([], CODES_SCHEMA)
    if texts:
        codes = stored(frequency_codes(rows, texts))
        rows = _coded(rows, texts, codes)
    many = train.where(F.col(target).isNotNull()).count()
    if many >= MANY_ROWS:
        inputs = [(F.col(f"{c}__code") if c in texts else F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(features)]
        return Forest(PipelineModel([*stages, forest_passes.fit(rows.select(*inputs, "__label"), many, forest)]), codes, tuple(texts))
    # binning and the trees pass over the rows again and again; blocks lost with an executor are
    # computed again from the plan
    rows = _spread(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Forest(Pipeline(stages=[*stages, forest]).fit(rows), codes, tuple(texts))
    finally:
        rows.unpersist()


def trained_features(model: Forest) -> list[str]:
    """Feature names in training order; stored with the model, so loading recovers them."""
    assembler = next(s for s in model.trees.stages if isinstance(s, VectorAssembler))
    return [c.removesuffix("__in") for c in assembler.getInputCols()]


def predict_forest(model: Forest, df: DataFrame) -> DataFrame:
    """The rows with a prediction; columns the model does not know pass through.

    An absent number counts as 0; an absent text gets the label "0", which is unseen unless the training rows had it.
    """
    absent = {c: F.lit("0") if c in model.texts else F.lit(0.0) for c in trained_features(model) if c not in df.columns}
    scored = model.trees.transform(_coded(df.withColumns(absent) if absent else df, model.texts, model.codes))
    return scored.select(*df.columns, "prediction")


def feature_importances(model: Forest, df: DataFrame) -> DataFrame:
    """(Feature, Importance), largest first; ``df`` only lends its session."""
    weights = model.trees.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(trained_features(model), weights, strict=True))
    schema = T.StructType([T.StructField("Feature", T.StringType()), T.StructField("Importance", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("Importance"), "Feature")
