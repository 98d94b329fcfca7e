import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyshelf.operators import cleaning
from tallyshelf.operators.cleaning import CleaningAudit, CleaningRules
from tallyshelf.operators.features import add_features
from tallyshelf.schema import ROW_ID
from tallyshelf.sources.files import type_columns

HEADER = [" InvoiceNo ", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", " Country"]
DIRTY = [
    ("536365", "85123A", "HEART HOLDER", "6", "12/1/2010 8:26", "2.55", "17850.0", "UK"),
    ("536365", "85123A", "HEART HOLDER", "6", "12/1/2010 8:26", "2.55", "17850.0", "UK"),
    ("536366", "\t71053 ", "\tLANTERN ", "8", "2010-12-01 08:28:00", "3.39", None, "UK"),
    ("C536379", "D", "Discount", "-1", "2010-12-01 09:41:00", "27.50", "14527", "UK"),
    ("536380", "22961", "JAM", "0", "2010-12-01 09:41:00", "1.45", "17809", "UK"),
    ("536381", "22139", "RETRO TIN", "5", "2010-12-01 09:41:00", "0.0", "15311", "UK"),
    ("536382", "10002", "BALLOON", "12", "not a date", "0.85", "16098", "FR"),
    ("536383", "10003", None, "3", "2010-12-02 10:00:00", "1.25", "16098", "FR"),
    ("536384", None, "MUG", "3", "2010-12-02 10:00:00", "1.25", "16098", "FR"),
    ("536385", "10004", "MUG", "NaN", "2010-12-02 10:00:00", "1.25", "16098", "FR"),
    ("536386", "10005", "CUP", "9000", "2011-01-02 23:00:00", "2.10", "12345678.0", "DE"),
    (None, "10006", "CUP", "4", "2010-12-05 10:00:00", "2.10", "12.5.6", "DE"),
]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(DIRTY, ", ".join(f"`{c}` string" for c in HEADER))


def test_known_answers(dirty):
    found = cleaning.clean(dirty)
    assert found.columns == [c.strip() for c in HEADER]
    got = {r["InvoiceNo"]: r for r in found.collect()}
    assert set(got) == {"536365", "536366", "536386", None}
    assert found.count() == 4
    assert got["536365"]["CustomerID"] == "17850"
    assert got["536365"]["InvoiceDate"] == dt.datetime(2010, 12, 1, 8, 26)
    assert (got["536366"]["StockCode"], got["536366"]["Description"], got["536366"]["CustomerID"]) == ("71053", "LANTERN", "UNKNOWN")
    assert got["536386"]["CustomerID"] == "12345678"
    assert got[None]["CustomerID"] == "12"


def test_typed_ingest_gives_the_same(dirty):
    assert rows(cleaning.clean(type_columns(dirty))) == rows(cleaning.clean(dirty))


def test_reasons(dirty):
    dropped = {r["InvoiceNo"]: r[cleaning.REASON] for r in cleaning.rejected_rows(dirty).collect()}
    assert dropped == {
        "C536379": "quantity_not_positive", "536380": "quantity_not_positive", "536381": "price_not_positive",
        "536382": "bad_date", "536383": "no_description", "536384": "no_stock_code", "536385": "quantity_not_positive",
    }


def test_missing_text_kept_on_request(dirty):
    kept = cleaning.clean(dirty, CleaningRules(missing_text="nan"))
    got = {r["InvoiceNo"]: r for r in kept.collect()}
    assert got["536383"]["Description"] == "nan"
    assert got["536384"]["StockCode"] == "nan"
    with pytest.raises(ValueError):
        cleaning.clean(dirty, CleaningRules(missing_text="maybe"))


def test_switches(dirty):
    kept = cleaning.clean(dirty, CleaningRules(remove_cancelled_orders=False, remove_zero_unit_price=False))
    numbers = {r["InvoiceNo"] for r in kept.collect()}
    assert {"C536379", "536380", "536381", "536385"} <= numbers
    flags = {r["InvoiceNo"]: r["IsCancelled"] for r in add_features(kept).collect()}
    assert flags["C536379"] is True and flags["536380"] is False and flags[None] is False


def test_price_and_quantity_rules_need_both_columns(dirty):
    without = cleaning.clean(dirty.drop("UnitPrice"))
    assert "C536379" in {r["InvoiceNo"] for r in without.collect()}


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    assert cleaning.clean(df).count() == 1
    assert add_features(df).columns == ["a", "b"]


def test_duplicate_headers_are_refused(spark):
    with pytest.raises(ValueError):
        cleaning.clean(spark.createDataFrame([(1, 2)], "`a ` int, a int"))


def test_audit_without_a_second_scan(dirty):
    audit = CleaningAudit.new()
    assert len(cleaning.clean(dirty, audit=audit).collect()) == 4
    counts = audit.counts()
    assert counts["rows_in"] == 12 and counts["rows_kept"] == 5 and counts["rows_out"] == 4 and counts["copies"] == 1
    assert counts["bad_date"] == 1 and counts["quantity_not_positive"] == 3 and counts["unknown_customers"] == 1
    report = cleaning.cleaning_report(dirty).first().asDict()
    assert all(counts[k] == v for k, v in report.items())


def test_capping_agrees_with_pandas(spark):
    values = [1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 4.0, 4.0, 5.0, 100.0, -50.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    s = pd.Series(values, dtype=float)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    wanted = s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    got = [r["v"] for r in cleaning.winsorize(df, ["v"]).orderBy("id").collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx(wanted[:-1].tolist())
    counts = cleaning.outlier_counts(df, ["v"]).first()
    assert (counts["n_below"], counts["n_above"]) == (1, 1)
    assert cleaning.winsorize(df, ["absent"]) is df


def test_capping_may_create_copies(spark):
    rows_ = [("a", float(v), 1.0) for v in (1, 2, 3, 4, 5, 6, 7, 8, 500, 600)]
    df = spark.createDataFrame(rows_, "StockCode string, Quantity double, UnitPrice double")
    assert cleaning.clean(df).count() == 10
    assert cleaning.clean(df, CleaningRules(cap_quantity=True)).count() == 9


def test_bounds_are_taken_after_the_row_rules(spark):
    rows_ = [("a", float(v), 1.0, str(v)) for v in (1, 2, 3, 4, 5)] + [("a", -1000.0, 1.0, "x")] * 5
    df = spark.createDataFrame(rows_, "StockCode string, Quantity double, UnitPrice double, id string")
    got = cleaning.clean(df, CleaningRules(cap_quantity=True))
    assert sorted(r["Quantity"] for r in got.collect()) == [1, 2, 3, 4, 5]


def test_first_copy_is_kept(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("b", 1, 4)], f"k string, v int, {ROW_ID} long")
    assert rows(cleaning.drop_copies(df).select("k", "v", ROW_ID)) == [("a", 1, 3), ("b", 1, 4)]


def test_cleaning_twice_changes_nothing(dirty):
    once = cleaning.clean(dirty)
    assert rows(cleaning.clean(once)) == rows(once)


def test_quantile_filter_and_search(spark):
    df = spark.range(1, 101).withColumn("v", F.col("id").cast("double"))
    assert cleaning.at_most_quantile(df, "v", 0.9).count() == 90
    assert cleaning.search(df, "id", "^9").count() == 11
    assert cleaning.search(df, "id", "").count() == 0


def test_features(dirty):
    got = {r["InvoiceNo"]: r for r in add_features(cleaning.clean(dirty)).collect()}
    row = got["536386"]
    assert row["TotalPrice"] == pytest.approx(18900)
    assert (row["OrderYear"], row["OrderWeekOfYear"], row["OrderHour"], row["OrderDayOfWeek"]) == (2011, 52, 23, 6)
