import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyshelf.functions.seasonal_arma import Orders, errors, estimate
from tallyshelf.operators import forest, model_store, panel, series
from tallyshelf.operators.metrics import regression_metrics


@pytest.fixture(scope="module")
def training(spark):
    """200 rows: linear target with noise and a month effect, floored at 0."""
    df = spark.range(200).select(
        "id", (F.rand(1) * 100).alias("feature1"), (F.rand(2) * 50).alias("feature2"),
        (F.col("id") % 12 + 1).cast("int").alias("month"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("group"),
    )
    mean = 2 * F.col("feature1") - 0.5 * F.col("feature2") + 5 * F.col("month") + 10 * F.randn(3)
    return df.withColumn("sales_quantity", F.round(F.greatest(mean, F.lit(0.0))).cast("int")).cache()


FEATURES = ["feature1", "feature2", "month", "group"]


@pytest.fixture(scope="module")
def model(training):
    return forest.fit_forest(training, "sales_quantity", FEATURES, trees=20, max_depth=8)


def test_forest_learns(training, model):
    found = forest.predict_forest(model, training)
    assert found.columns == [*training.columns, "prediction"]
    assert regression_metrics(found, "sales_quantity", "prediction").first()["r2"] > 0.9
    weights = forest.feature_importances(model, training).collect()
    assert weights[0]["Feature"] == "feature1"
    assert [w["Importance"] for w in weights] == sorted((w["Importance"] for w in weights), reverse=True)
    assert sum(w["Importance"] for w in weights) == pytest.approx(1)


def test_a_forest_uses_all_cores_and_small_passes(spark, training, monkeypatch):
    monkeypatch.setattr(forest, "TASK_ROWS", 1000)
    rows = spark.range(0, 6000, 1, 1).selectExpr("id % 7 AS a", "id AS __label")
    spread = forest._spread(rows)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) <= 1010 and sum(sizes) == 6000
    at = lambda df: [tuple(r) for r in df.withColumn("_p", F.spark_partition_id()).collect()]
    assert at(spread) == at(forest._spread(rows))  # the bootstrap follows the order of the rows
    assert at(forest._spread(rows.limit(900))) == at(rows.limit(900))
    # how many nodes grow in a pass changes no tree
    trees = []
    for size in (1, 256):
        monkeypatch.setattr(forest, "PASS_MB", size)
        fitted = forest.fit_forest(training, "sales_quantity", FEATURES, trees=5, max_depth=6).trees.stages[-1]
        assert fitted.getMaxMemoryInMB() == size
        trees.append(fitted.toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1]


def test_absent_features_count_as_zero(training, model):
    without = forest.predict_forest(model, training.drop("feature2").withColumn("extra", F.lit(1)))
    zero = forest.predict_forest(model, training.withColumn("feature2", F.lit(0.0)))
    both = without.select("id", F.col("prediction").alias("a")).join(zero.select("id", F.col("prediction").alias("b")), "id")
    assert both.where("a <> b").count() == 0


def test_forest_save_and_load(spark, training, model, tmp_path):
    name = model_store.model_name("RandomForest", "sales_quantity", dt.datetime(2025, 5, 28, 9, 32, 2))
    assert name == "RandomForest_sales_quantity_20250528093202"
    path = f"{tmp_path}/{name}"
    model_store.save_forest(spark, model, path, "sales_quantity", FEATURES)
    loaded = model_store.load_forest(spark, path)
    assert forest.trained_features(loaded) == FEATURES
    a = [r["prediction"] for r in forest.predict_forest(model, training).orderBy("id").collect()]
    b = [r["prediction"] for r in forest.predict_forest(loaded, training).orderBy("id").collect()]
    assert a == b
    assert model_store.newest_model(spark, str(tmp_path)).endswith(name)
    assert model_store.newest_model(spark, f"{tmp_path}/none") is None
    assert model_store.read_card(spark, path)["target"] == "sales_quantity"
    with pytest.raises(FileNotFoundError):
        model_store.load_forest(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        model_store.save_forest(spark, None, path)


def test_kind_from_name():
    assert model_store.kind_from_name("x/SARIMA_q_1") == "SARIMA"
    assert model_store.kind_from_name("rf_model") == "RandomForest"
    assert model_store.kind_from_name("other", "SARIMA") == "SARIMA"


def test_forest_arguments(training):
    assert forest.feature_columns(training, "sales_quantity") == ["id", "feature1", "feature2", "month", "group"]
    assert forest.default_features(training, "sales_quantity") == ["id", "feature1", "feature2"]
    assert forest.default_features(training.withColumn("OrderMonth", F.lit(1)), "sales_quantity") == ["OrderMonth"]
    for bad in (("nope", None), ("sales_quantity", ["nope"]), ("group", ["feature1"])):
        with pytest.raises(ValueError):
            forest.fit_forest(training, *bad)
    with pytest.raises(ValueError, match="max_depth"):
        forest.fit_forest(training.limit(20), "sales_quantity", ["feature1"], trees=1, max_depth=40)


# ---------------------------------------------------------------- seasonal model


def test_known_parameters_are_recovered():
    rng = np.random.default_rng(11)
    orders = Orders(1, 0, 1, 1, 0, 0, 4)
    phi, season, theta, n = 0.6, 0.4, 0.5, 1500
    e = rng.normal(size=n + 100)
    z = np.zeros(n + 100)
    for t in range(5, n + 100):
        z[t] = phi * z[t - 1] + season * z[t - 4] - phi * season * z[t - 5] + e[t] + theta * e[t - 1]
    x = rng.normal(size=(n, 1))
    beta, parts, status = estimate(z[100:] + 2.5 * x[:, 0], x, orders)
    assert status == "ok"
    assert beta[0] == pytest.approx(2.5, abs=0.1)
    assert [float(p[0]) if len(p) else None for p in parts] == [
        pytest.approx(phi, abs=0.1), pytest.approx(season, abs=0.1), pytest.approx(theta, abs=0.1), None
    ]
    resid, _ = errors(z[100:] + 2.5 * x[:, 0], x, beta, parts, orders)
    assert resid[50:].var() == pytest.approx(1, abs=0.15)


ORDERS = Orders(1, 1, 1, 1, 1, 0, 12)


def promotions(n=48, seed=7):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    promo = rng.choice([0.0, 5.0], n, p=[0.8, 0.2])
    value = np.round(np.maximum(0, 0.5 * t + 10 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 2, n) + 50 + 3 * promo))
    return pd.DataFrame({"bucket": pd.date_range("2020-01-01", periods=n, freq="MS").date, "value": value, "promo": promo})


@pytest.fixture(scope="module")
def panel_data(spark):
    parts = [promotions(seed=s).assign(k=f"p{s}") for s in range(4)]
    return spark.createDataFrame(pd.concat(parts), "bucket date, value double, promo double, k string").cache()


def test_forecast_beats_last_year(spark, panel_data):
    train, test = series.split_tail(panel_data, 12, ["k"])
    model = panel.fit_panel(train, orders=ORDERS, exog=["promo"], by=["k"]).cache()
    assert {r["status"] for r in model.collect()} <= {"ok", "ridge", "not_converged"}
    beta = [r["value"] for r in panel.coefficients(model).where("part = 'beta'").collect()]
    assert np.mean(beta) == pytest.approx(3, abs=1)
    path = panel.forecast_panel(model, 12, "MS", ORDERS, test, ["promo"])
    joined = test.join(path, ["k", "bucket"])
    assert joined.count() == 48
    ours = regression_metrics(joined, "value", "forecast").first()["mape"]
    naive = test.join(train.select("k", F.add_months("bucket", 12).alias("bucket"), F.col("value").alias("forecast")), ["k", "bucket"])
    assert ours < regression_metrics(naive, "value", "forecast").first()["mape"]


def test_missing_future_values_are_reported(panel_data):
    model = panel.fit_panel(panel_data, orders=ORDERS, exog=["promo"], by=["k"])
    with pytest.raises(ValueError):
        panel.forecast_panel(model, 3, "MS", ORDERS, exog=["promo"])
    found = panel.forecast_panel(model, 3, "MS", ORDERS, panel_data, ["promo"]).collect()
    assert len(found) == 3 * model.count() and {(r["status"], r["forecast"]) for r in found} == {("no_future", None)}


def test_panel_save_and_load(spark, panel_data, tmp_path):
    model = panel.fit_panel(panel_data, orders=ORDERS, by=["k"])
    model_store.save_panel(spark, model, f"{tmp_path}/SARIMA_value_1", ORDERS, "MS", "value")
    loaded, orders, freq, exog = model_store.load_panel(spark, model_store.newest_model(spark, str(tmp_path)))
    assert (orders, freq, exog) == (ORDERS, "MS", [])
    a = panel.forecast_panel(model, 6, "MS", ORDERS).orderBy("k", "step").collect()
    assert panel.forecast_panel(loaded, 6, freq, orders).orderBy("k", "step").collect() == a
    assert a[0]["bucket"] == dt.date(2024, 1, 1) and a[0]["step"] == 1


def test_in_sample_values(panel_data):
    model = panel.fit_panel(panel_data, orders=ORDERS, by=["k"])
    points = panel.in_sample(model, "MS", dt.date(2022, 1, 1), dt.date(2022, 12, 1))
    joined = points.join(panel_data, ["k", "bucket"])
    assert joined.count() == 48
    assert joined.where("actual <> value OR abs(fitted + resid - value) > 1e-9").count() == 0
    early = panel.in_sample(model, "MS", last=dt.date(2020, 12, 1))
    assert early.where("fitted IS NOT NULL").count() == 0


def test_short_and_gappy_series(spark, panel_data):
    short = panel_data.where("k = 'p0'").where("bucket < '2021-03-01'")
    gaps = panel_data.where("k = 'p1'").withColumn("value", F.when(F.col("bucket") != dt.date(2021, 1, 1), F.col("value")))
    both = short.unionByName(gaps)
    model = panel.fit_panel(both, orders=ORDERS, by=["k"])
    assert {r["k"]: r["status"] for r in model.collect()} == {"p0": "short", "p1": "has_nulls"}
    path = panel.forecast_panel(model, 2, "MS", ORDERS).orderBy("k", "step").collect()
    assert [(r["k"], r["status"]) for r in path] == [("p0", "short")] * 2 + [("p1", "has_nulls")] * 2
    assert [r["forecast"] for r in path[2:]] == [None, None]
    y = [r["value"] for r in short.orderBy("bucket").collect()]
    # no coefficients: last value plus the change of a year ago
    assert path[0]["forecast"] == pytest.approx(y[-1] + y[-12] - y[-13])


def test_single_series_month_ends(spark):
    pdf = promotions()
    pdf["bucket"] = pd.date_range("2020-01-31", periods=48, freq="ME").date
    model = panel.fit_panel(spark.createDataFrame(pdf, "bucket date, value double, promo double"), orders=Orders(0, 1, 1, 0, 1, 1, 12))
    path = panel.forecast_panel(model, 3, "M", Orders(0, 1, 1, 0, 1, 1, 12)).orderBy("step").collect()
    assert [r["bucket"] for r in path] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert {r["series_key"] for r in path} == {"all"}


def test_future_values_are_matched_by_bucket(spark):
    """A gap in the future values takes that series' forecasts, not another month's value."""
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rng = np.random.default_rng(5)
    x = rng.random(40)
    rows = [(k, months[i], float(100 + 50 * x[i] + rng.normal()), float(x[i])) for k in "ab" for i in range(36)]
    known = spark.createDataFrame(rows, "k string, bucket date, value double, x double")
    ahead = [("a", months[36 + i], float(x[36 + i])) for i in (3, 1, 0, 2)] + [("b", months[36 + i], float(x[36 + i])) for i in (0, 2, 3)]
    future = spark.createDataFrame(ahead, "k string, bucket date, x double")
    orders = Orders(0, 0, 0, 0, 0, 0, 12)
    model = panel.fit_panel(known, orders=orders, exog=["x"], by=["k"])
    found = panel.forecast_panel(model, 4, "MS", orders, future, ["x"]).orderBy("k", "step").collect()
    assert [r["bucket"] for r in found[:4]] == months[36:]
    beta = model.where("k = 'a'").first()["beta"][0]
    assert [r["forecast"] for r in found[:4]] == pytest.approx([beta * v for v in x[36:]])
    assert {(r["status"], r["forecast"]) for r in found[4:]} == {("no_future", None)}


def test_a_broken_series_does_not_end_the_job(spark):
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(36)]
    rows = [(k, m, float("inf") if k == "bad" and i == 5 else float(i % 7)) for k in ("good", "bad") for i, m in enumerate(months)]
    series_ = spark.createDataFrame(rows, "k string, bucket date, value double")
    orders = Orders(1, 0, 0, 0, 0, 0, 12)
    model = panel.fit_panel(series_, orders=orders, by=["k"])
    found = panel.forecast_panel(model, 2, "MS", orders).collect()
    assert {(r["k"], r["forecast"] is None) for r in found} == {("good", False), ("bad", True)}
    assert estimate(np.full(30, np.nan), np.zeros((30, 0)), orders)[2] == "failed"
