"""The forest that is grown in passes over binned rows, against brute force and Spark ML."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tallyshelf.operators import forest, model_store
from tallyshelf.operators import forest_passes as passes
from tallyshelf.operators.metrics import regression_metrics


@pytest.fixture(scope="module")
def rows(spark):
    """6,000 rows; every third occurs twice and one occurs 500 times more."""
    df = spark.range(4000).select(
        (F.col("id") * 7919 % 1009 / 10).alias("a"), (F.col("id") % 12).cast("int").alias("b"),
        F.when(F.col("id") % 5 == 0, "rare").otherwise("often").alias("c"), F.lit(3).alias("same"),
    )
    df = df.withColumn("y", F.round(F.col("a") * 2 + F.col("b") * F.col("b") + F.when(F.col("c") == "rare", 40).otherwise(0)).cast("int"))
    more = df.where("b % 3 = 0").union(df.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n"))
    return df.union(more).repartition(5).cache()


FEATURES = ["a", "b", "c", "same"]


@pytest.fixture
def many(monkeypatch):
    """Few rows are many, and the histograms of a tree do not fit into one pass."""
    monkeypatch.setattr(forest, "MANY_ROWS", 1000)
    monkeypatch.setattr(passes, "HISTOGRAM_BYTES", 16 * 80 * 100)


def estimator(**more):
    return RandomForestRegressor(featuresCol="__features", labelCol="__label", maxBins=16, seed=7, featureSubsetStrategy="all", **more)


def brute(cells, weights, labels, depth, grown):
    """The tree by trying all splits; grown collects (node depth, feature, bin, weight, sum)."""
    w, s = weights.sum(), labels.sum()
    best = (1e-9, None, None)
    for f in range(len(cells)) if depth else ():
        for cut in range(cells[f].max()):
            left = cells[f] <= cut
            a = weights[left].sum()
            if 1 <= a <= w - 1:
                t = labels[left].sum()
                gain = t * t / a + (s - t) ** 2 / (w - a) - s * s / w
                if gain > best[0] + 1e-6:
                    best = (gain, f, cut)
    _, f, cut = best
    grown.append((depth, f, cut, w, s))
    if f is not None:
        for side in (cells[f] <= cut, cells[f] > cut):
            brute(cells[:, side], weights[side], labels[side], depth - 1, grown)


def test_every_tree_is_the_best_one_for_its_draws(spark, rows, monkeypatch):
    kept = {}

    def keep(df):
        kept["blocks"] = df.collect()
        return spark.createDataFrame(kept["blocks"], df.schema).repartition(3)

    monkeypatch.setattr(passes, "stored", keep)
    monkeypatch.setattr(passes, "HISTOGRAM_BYTES", 16 * 40 * 5)  # five nodes a pass
    numbers = rows.select("a", F.col("b").cast("double"), F.col("same").cast("double"), F.col("y").cast("double").alias("__label"))
    model = passes.fit(numbers, rows.count(), estimator(numTrees=3, maxDepth=4))
    assert model.getNumTrees == 3 and model.numFeatures == 3
    blocks = [passes._Block(b.asDict(), 3, np.uint8) for b in kept["blocks"]]
    # every row is in the blocks once
    assert sum(len(b.labels) + b.numbers.sum() for b in blocks) == rows.count() and any(len(b.numbers) for b in blocks)
    assert sum(b.labels.sum() + (b.many_labels * b.numbers).sum() for b in blocks) == rows.agg(F.sum("y")).first()[0]
    edges = passes._edges(numbers, 16)
    for tree, fitted in enumerate(model.trees):
        sums = [b.sums(7, tree) for b in blocks]
        cells = np.concatenate([b.bins for b in blocks], axis=1)
        grown = []
        brute(cells, np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums]), 4, grown)
        nodes, java = [], [(fitted._call_java("rootNode"), 4)]
        while java:  # in preorder
            node, depth = java.pop()
            stats = list(node.impurityStats().stats())
            if node.subtreeDepth():
                split = node.split()
                f = split.featureIndex()
                nodes.append((depth, f, int(np.searchsorted(edges[f], split.threshold())), stats[0], stats[1]))
                java += [(node.rightChild(), depth - 1), (node.leftChild(), depth - 1)]
            else:
                assert node.prediction() == pytest.approx(stats[1] / stats[0]) and node.impurity() >= 0
                nodes.append((depth, None, None, stats[0], stats[1]))
        assert nodes == grown


def test_as_good_as_the_trees_of_spark(spark, rows, many, monkeypatch, tmp_path):
    fitted = forest.fit_forest(rows, "y", FEATURES, trees=20, max_depth=6)
    again = forest.fit_forest(rows.repartition(2, "a"), "y", FEATURES, trees=20, max_depth=6)
    of = lambda m: m.trees.stages[-1].toDebugString.split("\n", 1)[1]
    assert of(fitted) == of(again)  # the draws follow the rows, not where they lie
    assert of(fitted) != of(forest.fit_forest(rows, "y", FEATURES, trees=20, max_depth=6, seed=1))
    monkeypatch.setattr(forest, "MANY_ROWS", 10**9)
    plain = forest.fit_forest(rows, "y", FEATURES, trees=20, max_depth=6)
    scores = [regression_metrics(forest.predict_forest(m, rows), "y", "prediction").first() for m in (fitted, plain)]
    assert scores[0]["n"] == scores[1]["n"] == rows.count()
    assert scores[0]["r2"] > 0.95 and scores[0]["r2"] == pytest.approx(scores[1]["r2"], abs=0.01)
    weights = [{r["Feature"]: r["Importance"] for r in forest.feature_importances(m, rows).collect()} for m in (fitted, plain)]
    assert weights[0] == pytest.approx(weights[1], abs=0.03) and weights[0]["same"] == 0
    same = ["numTrees", "maxDepth", "seed", "maxBins", "featureSubsetStrategy", "labelCol", "featuresCol", "predictionCol", "maxMemoryInMB"]
    assert len({tuple(m.trees.stages[-1].getOrDefault(p) for p in same) for m in (fitted, plain)}) == 1
    model_store.save_forest(spark, fitted, f"{tmp_path}/m", "y", FEATURES)
    loaded = model_store.load_forest(spark, f"{tmp_path}/m")
    both = [sorted(r["prediction"] for r in forest.predict_forest(m, rows).collect()) for m in (fitted, loaded)]
    assert both[0] == both[1]


def test_odd_rows(spark, rows, many):
    steps = spark.range(3000).select((F.col("id") % 2).alias("x"), F.when(F.col("id") % 2 == 1, 40.1).otherwise(10.1).alias("y"))
    found = forest.predict_forest(forest.fit_forest(steps, "y", ["x"], trees=5, max_depth=3), steps)
    assert found.where("abs(prediction - y) > 1e-9").count() == 0
    flat = forest.fit_forest(steps.withColumn("x", F.lit(1)), "y", ["x"], trees=5, max_depth=3)
    assert flat.trees.stages[-1].totalNumNodes == 5
    without = steps.union(steps.limit(900).withColumn("y", F.lit(None).cast("double")))
    assert forest.predict_forest(forest.fit_forest(without, "y", ["x"], trees=5, max_depth=3), steps).where("abs(prediction - y) > 1e-9").count() == 0
    for bad in (steps.withColumn("x", F.expr("IF(y > 20, NULL, x)")), steps.withColumn("y", F.lit(math.inf))):
        with pytest.raises(Exception, match="NaN or infinite"):
            forest.fit_forest(bad, "y", ["x"], trees=2, max_depth=2)


def test_draws_are_poisson():
    kinds = np.bincount(passes.DRAWS, minlength=256)
    assert kinds[passes.OPEN] <= 10
    for k in range(8):
        assert kinds[k] / 65536 == pytest.approx(math.exp(-1) / math.factorial(k), abs=3 / 65536)
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 8, 50), [300]]).astype(np.int32)  # one cell of more than FEW rows
    n = int(lengths.sum())
    counts = np.where(np.arange(n) % 7 == 0, 100, 1).astype(np.int64)
    labels = rng.normal(size=n)
    row = {"bucket": 2, "block": 0, "lengths": lengths.tobytes(), "labels": labels.tobytes(), "counts": counts.tobytes(),
           "bins": np.arange(51, dtype=np.uint8).tobytes()}
    block = passes._Block(row, 1, np.uint8)
    drawn = np.array([block.sums(1, t, squares=True) for t in range(3000)])
    assert (drawn[5] == np.array(block.sums(1, 5, squares=True))).all()
    cell = np.repeat(np.arange(51), lengths)[:, None] == block.bins[0]
    for i, values in enumerate((np.ones(n), labels, labels * labels)):
        mean, variance = (counts * values) @ cell, (counts * values * values) @ cell
        # a compound Poisson sum: both moments add up row by row
        assert np.abs((drawn[:, i].mean(axis=0) - mean) / np.sqrt(variance / 3000)).max() < 5
        assert drawn[:, i].var(axis=0) == pytest.approx(variance, rel=0.2)


def test_a_hot_cell_is_spread():
    n = 50_000
    batch = pa.RecordBatch.from_arrays([pa.array(np.ones(n)), pa.array(np.arange(n) % 40_000.0)], ["_0", "__label"])
    parts = list(passes._parts([np.array([0.5])], 16)(iter([batch])))
    counts = [np.frombuffer(p["counts"][0].as_py(), np.int64) for p in parts]
    assert len(parts) == 10 and max(map(len, counts)) <= passes.SPILL_LABELS and sum(c.sum() for c in counts) == n


def test_thresholds():
    points = np.arange(100.0)
    assert passes.thresholds(points[:5], np.ones(5), 8).tolist() == [0.5, 1.5, 2.5, 3.5]
    assert passes.thresholds(points, np.ones(100), 4).tolist() == [24.5, 49.5, 74.5]
    heavy = passes.thresholds(points, np.where(points == 10, 1000.0, 1.0), 4)
    assert len(heavy) <= 3 and (np.diff(heavy) > 0).all()
    # summaries of all values, a few of their 2,048th parts off
    values = np.random.default_rng(1).permutation(4_000_000).astype(float)
    batches = (pa.RecordBatch.from_arrays([pa.array(v), pa.array(v)], ["_0", "__label"]) for v in np.split(values, 400))
    (summary,) = passes._summaries(batches)
    points, weights = (np.frombuffer(summary[c][0].as_py(), float) for c in ("points", "weights"))
    assert weights.sum() == 4_000_000 and len(points) <= passes.SUMMARY
    edges = passes.thresholds(points, weights, 64)
    assert len(edges) == 63 and np.abs(edges / 4_000_000 - np.arange(1, 64) / 64).max() < 0.003


def test_blocks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(passes, "BLOCK_DRAWS", 100)
    edges = [np.array([0.5]), np.arange(3) + 0.5, np.array([])]
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 2, 2000) * 1.0, rng.integers(0, 4, 2000) * 1.0, np.ones(2000), rng.integers(0, 60, 2000) / 4]
    rows = [np.append(r, np.full(90, r[0])) for r in rows]  # one row occurs more than UNITS times
    batch = pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["_0", "_1", "_2", "__label"])
    parts = pa.Table.from_batches(list(passes._parts(edges, 1)(iter([batch]))))
    found = passes._blocks(edges)(parts).to_pylist()
    assert [b["block"] for b in found] == list(range(len(found))) and 15 < len(found) < 30
    back = []
    for b in found:
        labels, counts, lengths = (np.frombuffer(b[c], t) for c, t in (("labels", float), ("counts", np.int64), ("lengths", np.int32)))
        bins = np.repeat(np.frombuffer(b["bins"], np.uint8).reshape(3, -1), lengths, axis=1)
        back.append(np.repeat(np.vstack([bins, labels]), counts, axis=1))
        # equal rows stay together, so a block may miss its size by one group of them
        assert len(passes._Block(b, 3, np.uint8).labels) < 100 + passes.UNITS
    wanted = np.vstack([rows[0] > 0.5, rows[1], np.zeros(len(rows[0])), rows[3]])
    assert sorted(map(tuple, np.concatenate(back, axis=1).T)) == sorted(map(tuple, wanted.T))
