"""Totals, chart tables, stock, profiles, metrics, diagnostics, splits."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyshelf.operators import charts, diagnostics, inventory, quality, splits, totals
from tallyshelf.operators.metrics import regression_metrics
from tallyshelf.plans.report import headline_texts, sales_report

SAMPLE = pd.DataFrame(
    {
        "Category": list("ABCDEABCDEABCDE"),
        "Value1": [10, 15, 7, 20, 25, 12, 18, 9, 22, 30, 11, 14, 8, 19, 28],
        "Value2": [5, 8, 3, 10, 12, 6, 9, 4, 11, 15, 5, 7, 4, 10, 14],
        "Date": pd.date_range("2023-01-01", periods=15, freq="W"),
        "Group": list("XYXYXYXYXYXYXYX"),
    }
)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE)


def test_bars(sample):
    sums = SAMPLE.groupby("Category")["Value1"].sum()
    top = sums.sort_values(ascending=False).head(3)
    assert rows(charts.bar_table(sample, "Category", "Value1", top_n=3), F.desc("Value1")) == list(top.items())
    low = sums.sort_values().head(4)
    assert rows(charts.bar_table(sample, "Category", "Value1", order="asc", top_n=4), "Value1") == list(low.items())
    assert charts.bar_table(sample, "Category", "Value1").count() == 5
    with pytest.raises(ValueError):
        charts.bar_table(sample, "Category", "Value1", order="up")


def test_pie_folds_the_rest(sample):
    whole = charts.pie_table(sample, "Category", "Value1", max_slices=5).collect()
    assert len(whole) == 5 and not any(r["is_other"] for r in whole)
    folded = {r["Category"]: r for r in charts.pie_table(sample, "Category", "Value1", max_slices=3, other_label="rest").collect()}
    assert set(folded) == {"E", "D", "rest"}
    assert folded["rest"]["Value1"] == SAMPLE["Value1"].sum() - 83 - 61
    assert sum(r["share"] for r in folded.values()) == pytest.approx(1)


def test_pie_name_equal_to_the_label_and_empty_rest(spark):
    df = spark.createDataFrame([("Other", 9), ("b", 5), ("c", 0), ("d", 0)], "n string, v int")
    assert rows(charts.pie_table(df, "n", "v", max_slices=3).select("n", "v", "is_other")) == [("Other", 9, False), ("b", 5, False)]
    df = df.union(spark.createDataFrame([("e", 1)], "n string, v int"))
    assert sorted(rows(charts.pie_table(df, "n", "v", max_slices=3).select("n", "v", "is_other"))) == [
        ("Other", 1, True), ("Other", 9, False), ("b", 5, False)
    ]


def test_histogram_agrees_with_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.r_[np.round(rng.lognormal(0, 1, 500), 2), np.nan]
    df = spark.createDataFrame(pd.DataFrame({"v": values})).withColumn("v", F.nanvl("v", F.lit(None)))
    got = charts.histogram(df, "v").orderBy("bin").toPandas()
    counts, edges = np.histogram(values[:-1], bins=30)
    assert got["n"].sum() == 500 and len(got) == 30
    np.testing.assert_allclose(got["lower"], edges[:-1])
    assert np.abs(got["n"] - counts).sum() <= 2  # a value on an inner edge may fall to either side


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    got = charts.histogram(df, "v").where("n > 0").collect()
    assert len(got) == 1 and got[0]["n"] == 4 and got[0]["lower"] <= 3 <= got[0]["upper"]
    assert charts.density_curve(df, "v").count() == 0
    assert charts.histogram(df.limit(0), "v").count() == 0


def test_density_agrees_with_the_sum_over_all_points(spark):
    values = np.random.default_rng(1).gamma(2, 3, 400)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = charts.density_curve(df, "v").orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min(), values.max(), 200)
    exact = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(1) / (h * math.sqrt(2 * math.pi)) * (np.ptp(values) / 30)
    np.testing.assert_allclose(got["x"], x)
    np.testing.assert_allclose(got["density"], exact, rtol=1e-4, atol=1e-6)


def test_lines_and_points(sample):
    got = {(r["Category"], r["Group"]): r for r in charts.line_table(sample, "Category", "Value1", "Group").collect()}
    part = SAMPLE[(SAMPLE.Category == "A") & (SAMPLE.Group == "X")]["Value1"]
    row = got["A", "X"]
    assert row["mean"] == part.mean() and row["n"] == len(part)
    assert row["high"] - row["mean"] == pytest.approx(charts.Z95 * part.std() / math.sqrt(len(part)))
    trend = charts.trend_table(sample, "Date", "Value1").collect()
    assert [r["mean"] for r in trend] == SAMPLE["Value1"].tolist() and trend[0]["low"] == trend[0]["mean"]
    assert charts.scatter_table(sample, "Value1", "Value2", "Group").count() == 15
    assert charts.scatter_table(sample, "Value1", "Value2", fraction=0.5).columns == ["Value1", "Value2"]


def test_correlation_with_gaps_and_constants(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf["d"] = 7.0
    pdf.loc[rng.random(200) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(200) < 0.2, "b"] = np.nan
    pdf["e"] = np.nan
    got = {(r["row"], r["col"]): r["corr"] for r in totals.correlation_matrix(spark.createDataFrame(pdf)).collect()}
    wanted = pdf.corr()
    assert len(got) == 25
    for (r, c), v in got.items():
        if np.isnan(wanted.loc[r, c]):
            assert v is None
        else:
            assert v == pytest.approx(wanted.loc[r, c])
    with pytest.raises(ValueError):
        totals.correlation_matrix(spark.createDataFrame(pdf[["a"]]))


LINES = [
    ("1", "A", "x", 5.0, dt.datetime(2024, 1, 5), 2.0, "c1", "UK"),
    ("1", "B", "y", 3.0, dt.datetime(2024, 1, 5), 1.0, "c1", "UK"),
    ("C2", "A", "x", -2.0, dt.datetime(2024, 2, 5), 2.0, "UNKNOWN", "FR"),
    ("3", "A", "x", 1.5, dt.datetime(2024, 4, 5), 2.0, "c2", None),
    ("4", "", "z", 9.0, dt.datetime(2024, 4, 6), 1.0, "c2", "FR"),
    ("5", None, "z", 9.0, dt.datetime(2024, 4, 7), 1.0, "c2", "FR"),
    ("C6", "D", "w", -1.0, dt.datetime(2024, 4, 7), 1.0, "c3", "FR"),
]


@pytest.fixture(scope="module")
def lines(spark):
    schema = "InvoiceNo string, StockCode string, Description string, Quantity double, InvoiceDate timestamp_ntz, UnitPrice double, CustomerID string, Country string"
    return spark.createDataFrame(LINES, schema).withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice"))


def test_totals(lines):
    assert rows(totals.total_sold(lines)) == [("A", 6.5), ("B", 3.0)]
    assert rows(totals.distinct_values(lines, "StockCode")) == [("A",), ("B",), ("D",)]
    assert rows(totals.top_by_sum(lines, "Country", "TotalPrice", 1)) == [("FR", 13.0)]
    assert rows(totals.monthly_sales(lines)) == [(dt.date(2024, 1, 1), 13.0), (dt.date(2024, 2, 1), -4.0), (dt.date(2024, 4, 1), 20.0)]
    facts = totals.headline_figures(lines).first()
    assert (facts["records"], facts["features"], facts["invoices"], facts["known_customers"]) == (7, 9, 6, 3)
    assert facts["first_date"] == dt.date(2024, 1, 5)
    texts = headline_texts(lines).first()
    assert texts["best_country"] == "FR" and texts["revenue"] == "29.00" and texts["last_date"] == "2024-04-07"
    assert headline_texts(lines.limit(0)).first()["records"] == 0
    assert totals.headline_figures(lines, approximate=True).first()["products"] in (3, 4, 5)
    for bad in (("nope", "Quantity"), ("StockCode", "Country")):
        with pytest.raises(ValueError):
            totals.total_sold(lines, *bad)
    assert totals.total_sold(lines.limit(0)).columns == ["StockCode", "TotalSold"]


def test_stock(spark, lines):
    stock = inventory.stock_estimate(lines, initial_stock=5)
    assert rows(stock) == [("A", 6, -1), ("B", 3, 2), ("D", 0, 5)]
    assert [r[0] for r in inventory.lowest_stock(stock, 2).collect()] == ["A", "B"]
    assert [r[0] for r in inventory.highest_stock(stock, 2).collect()] == ["D", "B"]
    assert [r[0] for r in inventory.lowest_stock_chart(stock, 2).collect()] == ["B", "A"]
    assert [r[0] for r in inventory.all_stock(stock).collect()] == ["A", "B", "D"]
    assert [r[0] for r in inventory.find_stock(stock, "a|d").collect()] == ["A", "D"]
    opening = spark.createDataFrame([("A", 100)], "StockCode string, OpeningStock int")
    assert rows(inventory.stock_estimate(lines, initial_stock=5, opening=opening))[0] == ("A", 6, 94)
    assert inventory.choose_columns(lines) == ("StockCode", "Quantity")
    assert inventory.choose_columns(lines.select("Country", "UnitPrice")) == ("Country", "UnitPrice")
    with pytest.raises(ValueError):
        inventory.stock_estimate(lines, initial_stock=-1)


def test_profiles(lines):
    profile = {r["column"]: r for r in quality.column_profile(lines).collect()}
    assert profile["StockCode"]["n_missing"] == 1 and profile["InvoiceDate"]["kind"] == "datetime"
    assert quality.total_missing(lines).first()[0] == 2
    assert tuple(quality.shape(lines).first()) == (7, 9)
    stats = quality.describe(lines, ["Quantity"]).first()
    wanted = pd.Series([r[3] for r in LINES]).describe()
    assert [stats[n] for n in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(wanted.tolist())
    assert quality.preview(lines, 2, "InvoiceDate", "StockCode").count() == 2


def test_report_tables(lines):
    tables = sales_report(lines)
    assert {"Quantity_histogram", "TotalPrice_density", "monthly_sales", "top_countries", "top_products", "correlations", "headline"} <= set(tables)
    for df in tables.values():
        assert df.collect() is not None


def test_metrics(spark):
    y, f = [1.0, 0.0, 4.0, 3.0, None], [1.5, 0.5, 3.0, 3.0, 9.0]
    df = spark.createDataFrame(list(zip(y, f, strict=True)), "y double, f double")
    m = regression_metrics(df, "y", "f").first()
    t, p = np.array(y[:4]), np.array(f[:4])
    assert m["mse"] == pytest.approx(((t - p) ** 2).mean()) and m["mae"] == pytest.approx(np.abs(t - p).mean())
    assert m["r2"] == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert m["mape"] == pytest.approx(np.mean(np.abs((t - p) / np.where(t == 0, 1e-8, t))) * 100)
    flat = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 2.0, 1.0), ("b", 2.0, 2.0)], "k string, y double, f double")
    assert {r["k"]: r["r2"] for r in regression_metrics(flat, "y", "f", ["k"]).collect()} == {"a": 1.0, "b": 0.0}


def test_diagnostics(spark):
    x = np.random.default_rng(0).normal(3, 2, 50)
    df = spark.createDataFrame(pd.DataFrame({"bucket": pd.date_range("2020-01-01", periods=50).date, "resid": x}), "bucket date, resid double")
    c = x - x.mean()
    acf = [r["acf"] for r in diagnostics.autocorrelation(df, "resid", 5).orderBy("lag").collect()]
    assert acf == pytest.approx([(c[: 50 - k] * c[k:]).sum() / (c @ c) for k in range(6)])
    points = diagnostics.qq_points(diagnostics.standardized(df)).orderBy("rank").toPandas()
    np.testing.assert_allclose(points["sample"], np.sort(c / c.std()))
    np.testing.assert_allclose(points["theoretical"], [NormalDist().inv_cdf(i / 51) for i in range(1, 51)])


@pytest.mark.parametrize("size", [0.1, 0.25, 0.5, 0.9])
def test_ordered_split_is_exact(spark, size):
    rng = np.random.default_rng(4)
    n = 200
    pdf = pd.DataFrame({"t": np.where(rng.random(n) < 0.4, 50, rng.integers(0, 100, n)), "k": rng.integers(0, 9, n), "id": rng.permutation(n)})
    df = spark.createDataFrame(pdf).withColumn("t", F.when(F.col("id") != 7, F.col("t"))).repartition(5)
    train, test = splits.ordered_split(df, ["t", "k"], size)
    pdf["t"] = pdf["t"].where(pdf["id"] != 7, -1)
    ordered = pdf.sort_values(["t", "k", "id"])["id"].tolist()
    cut = n - math.ceil(n * size)
    assert sorted(r["id"] for r in train.collect()) == sorted(ordered[:cut])
    assert sorted(r["id"] for r in test.collect()) == sorted(ordered[cut:])


def test_ordered_split_on_times_and_small_tables(spark):
    days = [(dt.datetime(2024, 1, 1, 0, 0, 0, 5) + dt.timedelta(hours=i), i) for i in range(10)]
    df = spark.createDataFrame(days, "t timestamp_ntz, id int")
    train, test = splits.ordered_split(df, ["t"], 0.2)
    assert [r["id"] for r in test.orderBy("id").collect()] == [8, 9] and train.count() == 8
    one = splits.ordered_split(df.limit(1), ["t"], 0.2)
    assert (one[0].count(), one[1].count()) == (0, 1)
    with pytest.raises(ValueError):
        splits.ordered_split(df, ["t"], 1.5)
    a, b = splits.random_split(df, 0.3)
    assert a.count() + b.count() == 10


def test_correlations_of_many_columns(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.normal(size=(200, 20)), columns=[f"c{i}" for i in range(20)])
    pdf["c3"] = pdf["c2"] * 2 + 1e6
    pdf["c4"] = 7.0
    pdf.loc[::5, "c5"] = np.nan
    found = {(r["row"], r["col"]): r["corr"] for r in totals.correlation_matrix(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    want = pdf.corr()
    assert len(found) == 400 and found["c4", "c1"] is None
    assert all(abs(found[a, b] - want.loc[a, b]) < 1e-9 for a in pdf for b in pdf if "c4" not in (a, b))
