"""State of streams: copies across landings, totals that survive a replay, months written again, sketches, variants."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyshelf.operators.inventory import stock_estimate
from tallyshelf.operators.totals import figure_sketches, merged_figures
from tallyshelf.sources.payload import parse_variants
from tallyshelf.sources.sinks import write_table
from tallyshelf.streaming.lines import landing_stream, processed_stream, without_copies, write_stream
from tallyshelf.streaming.totals import current_totals, fold, keep_totals, put_batch

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"


def land(folder, name, lines):
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")


def line(invoice, product, quantity, day):
    return f"{invoice},{product},THING,{quantity},2011-{day} 10:00:00,2.5,17850,UK"


def test_copies_in_a_later_landing_are_dropped_after_a_restart(spark, tmp_path):
    landing, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()

    def run():
        lines = processed_stream(landing_stream(spark, str(landing)))
        write_stream(without_copies(lines, "10 days"), out, marks).awaitTermination()
        return sorted((r["InvoiceNo"], r["Quantity"]) for r in spark.read.parquet(out).collect())

    land(landing, "a.csv", [line(1, "A", 5, "03-01"), line(2, "A", 6, "03-09"), line(2, "A", 6, "03-09")])
    assert run() == [("1", 5), ("2", 6)]
    land(landing, "b.csv", [line(2, "A", 6, "03-09"), line(2, "A", 7, "03-09"), line(3, "B", 1, "03-12")])
    assert run() == [("1", 5), ("2", 6), ("2", 7), ("3", 1)]
    land(landing, "c.csv", [line(1, "A", 5, "01-01"), line(4, "B", 1, "03-13")])  # too late to be told from a copy
    assert run() == [("1", 5), ("2", 6), ("2", 7), ("3", 1), ("4", 1)]


def test_a_batch_is_few_files_and_its_state_few_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyshelf.streaming.lines.WRITERS", 1)
    landing, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    landing.mkdir()
    for k in range(3):
        land(landing, f"{k}.csv", [line(i, "A", i, f"03-{i % 9 + 1:02d}") for i in range(k * 10 + 1, k * 10 + 21)])
    lines = processed_stream(landing_stream(spark, str(landing)))
    write_stream(without_copies(lines, by=HEADER.split(",")), out, marks).awaitTermination()
    found = spark.read.parquet(out)
    assert sorted(r["Quantity"] for r in found.collect()) == list(range(1, 41))
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == 1


def test_a_replayed_batch_changes_no_total(spark, tmp_path):
    landing, path, marks = tmp_path / "in", str(tmp_path / "stock"), str(tmp_path / "marks")
    landing.mkdir()

    def run():
        keep_totals(stock_estimate(landing_stream(spark, str(landing)), initial_stock=100), path, marks).awaitTermination()
        return rows(current_totals(spark, path, ["StockCode"]))

    land(landing, "a.csv", [line(1, "A", 5, "03-01"), line(2, "B", 1, "03-09")])
    assert run() == [("A", 5, 95), ("B", 1, 99)]
    land(landing, "b.csv", [line(3, "A", 2, "03-10"), line(4, "A", -9, "03-10"), line(5, "C", -1, "03-10")])
    now = [("A", 7, 93), ("B", 1, 99), ("C", 0, 100)]
    assert run() == now and run() == now
    # the batch comes again after a failure
    batch = spark.read.parquet(f"{path}/changes/batch=1")
    put_batch(spark.createDataFrame(batch.collect(), batch.schema), 1, path)
    assert rows(current_totals(spark, path, ["StockCode"])) == now
    fold(spark, path, ["StockCode"], 1)
    assert rows(current_totals(spark, path, ["StockCode"])) == now
    land(landing, "c.csv", [line(6, "C", 4, "03-11")])
    assert run() == [("A", 7, 93), ("B", 1, 99), ("C", 4, 96)]


def test_only_the_written_months_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([(2011, 1, "a"), (2011, 2, "b"), (2012, 1, "c")], "OrderYear int, OrderMonth int, v string")
    write_table(df, path)
    for _ in range(2):
        write_table(df.where("OrderMonth = 2").withColumn("v", F.lit("new")), path, only_these_months=True)
    assert rows(spark.read.parquet(path).select("OrderYear", "OrderMonth", "v")) == [(2011, 1, "a"), (2011, 2, "new"), (2012, 1, "c")]
    write_table(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError, match="replaced by month"):
        write_table(df, str(tmp_path / "t.csv"), only_these_months=True)


def test_variants_of_drifting_records(spark):
    texts = ['{"a": 1, "b": {"c": "x"}}', '{"a": "no number"}', '{"c": "y", "more": [1, 2]}', "[1]", "7", "null", "{broken", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    good, bad = parse_variants(df, "t", {"a": ("$.a", "bigint"), "c": ("$.c|$.b.c", "string")})
    got = {r["id"]: (r["a"], r["c"]) for r in good.select("id", "a", "c").collect()}
    assert got == {0: (1, "x"), 1: (None, None), 2: (None, "y"), 3: (None, None), 4: (None, None), 5: (None, None), 7: (None, None)}
    assert [r["id"] for r in bad.orderBy("id").collect()] == [6, 8]
    assert good.where("id = 2").select(F.to_json("_record")).first()[0] == '{"c":"y","more":[1,2]}'


def test_merged_sketches_are_near_the_counts(spark):
    n = 60_000
    df = spark.range(n).select(
        (F.col("id") % 20_011).cast("string").alias("InvoiceNo"), F.lit(1.5).alias("TotalPrice"),
        F.date_add(F.lit(dt.date(2010, 1, 1)), (F.col("id") % 700).cast("int")).alias("InvoiceDate"))
    stored = figure_sketches(df)
    assert stored.count() == 24
    whole = merged_figures(stored).first()
    assert (whole["records"], whole["revenue"], whole["first_date"]) == (n, 1.5 * n, dt.date(2010, 1, 1))
    assert abs(whole["invoices"] / 20_011 - 1) < 0.04
    assert merged_figures(stored.limit(0)).first()["invoices"] == 0
