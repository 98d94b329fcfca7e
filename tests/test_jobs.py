import pytest
from pyspark.sql import functions as F

from tallyshelf.functions.seasonal_arma import Orders
from tallyshelf.operators.cleaning import CleaningAudit, CleaningRules, clean
from tallyshelf.plans.forecasting import forest_holdout, panel_holdout
from tallyshelf.plans.job import run_report
from tallyshelf.plans.report import processed_lines
from tallyshelf.sources.sinks import write_table
from tallyshelf.sources.star import retail_lines


@pytest.fixture(scope="module")
def processed(spark, data):
    return processed_lines(retail_lines(spark, data)).cache()


def test_report_job(spark, data, tmp_path):
    source = str(tmp_path / "sales.csv")
    write_table(retail_lines(spark, data), source)
    run = run_report(spark, source, str(tmp_path / "out"))
    assert run.processed_path.endswith("out/sales_processed.parquet")
    n = spark.read.parquet(run.processed_path).count()
    assert run.audit["rows_in"] == retail_lines(spark, data).count() and run.audit["rows_out"] == n
    assert run.headline.first()["records"] == n
    assert spark.read.parquet(run.table_paths["monthly_sales"]).agg(F.sum("TotalPrice")).first()[0] > 0
    assert spark.read.parquet(run.table_paths["Quantity_histogram"]).count() == 30


def test_audit_is_right_when_capping_reads_the_rows_again(spark, data):
    raw, audit = retail_lines(spark, data), CleaningAudit.new()
    cleaned = clean(raw, CleaningRules(cap_quantity=True, cap_unit_price=True), audit)
    n = len(cleaned.collect())
    counts = audit.counts()
    assert counts["rows_in"] == raw.count() and counts["rows_out"] == n
    assert counts["rows_kept"] == raw.where("Quantity > 0").count()


def test_forest_holdout(processed):
    found = forest_holdout(processed, "TotalPrice", ["InvoiceDate", "InvoiceNo", "StockCode"], ["Quantity", "UnitPrice"], trees=10)
    n = processed.count()
    assert found.predictions.count() == -(-n * 2 // 10)
    assert found.metrics.first()["r2"] > 0.9


def test_panel_holdout(processed):
    orders = Orders(1, 1, 1, 0, 0, 0, 12)
    found = panel_holdout(processed, "InvoiceDate", "Quantity", orders=orders, exog={"UnitPrice": "mean"}, n_test=6)
    assert found.predictions.count() == 6
    assert found.metrics.first()["series_key"] == "all"
    assert {r["status"] for r in found.status.collect()} == {"ok"}
    many = panel_holdout(processed.where("Country < 'NATION_15'"), "InvoiceDate", "Quantity", orders=orders, by=["Country"], n_test=6)
    countries = processed.where("Country < 'NATION_15'").select("Country").distinct().count()
    assert many.metrics.count() == countries and many.predictions.count() == countries * 6
