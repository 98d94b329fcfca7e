import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tallyshelf.operators.cleaning import clean
from tallyshelf.operators.features import add_features
from tallyshelf.sources import files, payload, sinks
from tallyshelf.sources.paths import extension, path_exists, processed_path, stored_or
from tallyshelf.sources.star import retail_lines

CSV = '''InvoiceNo , StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
536365,85123A,"HEART, ""RED"" HOLDER",6,12/1/2010 8:26,2.55,17850.0,UK
536366,71053,NA,8,2010-12-01 08:28:00,3.39,,UK
536367,22139,TIN,x,not a date,n/a,1,NULL
'''


def test_path_rules():
    assert extension("/a/b.v2/Sales.CSV") == "csv" and extension("/a.b/c") == "" and extension("x/y.parquet/") == "parquet"
    assert processed_path("data/Online Retail.xlsx") == "data/Online Retail_processed.parquet"
    assert processed_path("sales") == "sales_processed.parquet"


def test_csv(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(CSV)
    df = files.read_lines(spark, str(path))
    assert df.columns[:2] == ["InvoiceNo", "StockCode"]
    got = rows(df, "InvoiceNo")
    assert got[0] == ("536365", "85123A", 'HEART, "RED" HOLDER', 6.0, dt.datetime(2010, 12, 1, 8, 26), 2.55, "17850.0", "UK")
    assert got[1][2] is None and got[1][6] is None
    assert got[2][3:] == (None, None, None, "1", None)
    assert files.read_csv(spark, str(path), infer=True).columns[0].strip() == "InvoiceNo"
    with pytest.raises(ValueError):
        files.read_lines(spark, str(tmp_path / "lines.txt"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_lines(spark, str(tmp_path / "absent.csv"))


def test_csv_rejects_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,2\n3,4,5\n6,7\n')
    good, bad = files.split_rejects(files.read_csv(spark, str(path), keep_corrupt=True))
    assert rows(good) == [("1", "2"), ("6", "7")]
    assert [r["_corrupt_record"] for r in bad.collect()] == ["3,4,5"]
    assert (good.count(), bad.count()) == (2, 1)
    quoted = tmp_path / "q.csv"
    quoted.write_text('a,b\n1,"x\ny"\n')
    assert rows(files.read_csv(spark, str(quoted), multiline=True)) == [("1", "x\ny")]


RECORDS = [{"userId": 1, "id": 1, "title": "a", "completed": False}, {"userId": 1, "id": 2, "title": "b", "completed": True}]
SCHEMA = T.StructType([
    T.StructField("userId", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()), T.StructField("completed", T.BooleanType()),
])


@pytest.mark.parametrize("schema", [None, SCHEMA])
def test_json_payloads(spark, tmp_path, schema):
    (tmp_path / "list.json").write_text(json.dumps(RECORDS))
    (tmp_path / "one.json").write_text(json.dumps(RECORDS[0]))
    (tmp_path / "scalar.json").write_text("42")
    read = lambda name: payload.read_records(spark, str(tmp_path / name), schema)
    assert read("list.json")[0].count() == 2 and read("one.json")[0].count() == 1
    records, rejects = read("scalar.json")
    assert records.count() == 0 and rejects.count() == 1
    both, none = payload.read_payload(spark, str(tmp_path / "list.json"), "JSON", schema)
    assert none.count() == 0 and set(both.columns) == {"userId", "id", "title", "completed"}
    with pytest.raises(ValueError):
        payload.read_payload(spark, str(tmp_path / "list.json"), "xml")


def test_json_text_column(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": '), (3, None), (4, "42")], "id int, t string")
    good, bad = payload.parse_objects(df, "t", "k bigint")
    assert rows(good.select("id", "k")) == [(1, 5)]
    assert {r["id"] for r in bad.collect()} == {2, 3, 4}


def test_raw_copy_and_stored_sample(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(CSV)
    files.keep_raw(spark, str(path), str(tmp_path / "raw"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "raw")).collect()) == sorted(CSV.splitlines())
    assert path_exists(spark, str(path)) and not path_exists(spark, str(tmp_path / "none"))
    read = lambda p: files.read_lines(spark, p)
    assert stored_or(spark, str(path), read, lambda: spark.range(1)).count() == 3
    assert stored_or(spark, str(tmp_path / "none.csv"), read, lambda: spark.range(1)).columns == ["id"]


def test_sinks(spark, tmp_path, data):
    df = add_features(clean(retail_lines(spark, data)))
    out = str(tmp_path / "lines_processed.parquet")
    sinks.write_table(df, out)
    back = spark.read.parquet(out)
    assert back.count() == df.count() and set(back.columns) == set(df.columns)
    plan = back.where("OrderYear = 1996 AND OrderMonth = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(OrderYear" in plan
    text = str(tmp_path / "stock.csv")
    sinks.write_table(df.select("StockCode", "Quantity").limit(5), text)
    assert spark.read.option("header", True).csv(text).columns == ["StockCode", "Quantity"]
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x.xlsx"))


def test_headers_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Quantity,UnitPrice,Country\n1,2.5,UK\n2,3.5,FR\n")
    (tmp_path / "b.csv").write_text("UnitPrice, Quantity \n9.5,4\n")
    found = files.read_lines(spark, str(tmp_path), file_format="csv", by_name=True)
    assert rows(found.select("Quantity", "UnitPrice", "Country"), "Quantity") == [(1.0, 2.5, "UK"), (2.0, 3.5, "FR"), (4.0, 9.5, None)]
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_csv(spark, str(tmp_path)).collect()


def test_lines_of_the_wrong_width_come_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Quantity,UnitPrice\n1,2.5\n2\n3,4.5,lost\n")
    good, rejects = files.read_lines_with_rejects(spark, str(tmp_path))
    assert rows(good.select("Quantity", "UnitPrice")) == [(1.0, 2.5)]
    assert sorted(r[0] for r in rejects.collect()) == ["2", "3,4.5,lost"]
    both = payload.read_payload(spark, str(tmp_path))
    assert both[0].count() == 1 and both[1].count() == 2
