import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions import scalar


def one(spark, value, kind, expression):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("c", kind)]))
    return df.select(expression(F.col("c")).alias("r")).first()["r"]


def test_dates_in_every_layout(spark):
    expected = {
        "2010-12-01 08:26:00": dt.datetime(2010, 12, 1, 8, 26),
        "2010-12-01T08:26:00": dt.datetime(2010, 12, 1, 8, 26),
        "2010-12-01 08:26:00.250000": dt.datetime(2010, 12, 1, 8, 26, 0, 250000),
        "2010-12-01 08:26": dt.datetime(2010, 12, 1, 8, 26),
        " 2010-12-01\t": dt.datetime(2010, 12, 1),
        "12/1/2010 8:26": dt.datetime(2010, 12, 1, 8, 26),
        "12/01/2010 08:26:05": dt.datetime(2010, 12, 1, 8, 26, 5),
        "1/31/2011": dt.datetime(2011, 1, 31),
        "13/1/2010": None,
        "2010-02-30": None,
        "not a date": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in expected], "c string")
    found = df.select("c", scalar.parse_timestamp(F.col("c"), T.StringType()).alias("t")).collect()
    assert {r["c"]: r["t"] for r in found} == expected


def test_explicit_patterns(spark):
    got = one(spark, "01.12.2010", T.StringType(), lambda c: scalar.parse_timestamp(c, T.StringType(), ["dd.MM.yyyy"]))
    assert got == dt.datetime(2010, 12, 1)


def test_strip_is_python_strip(spark):
    texts = ["\t a b \n", " x ", "plain", "", " ", "\x1fz\x85", "a　", "​keep"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r in df.select("c", scalar.strip_text(F.col("c")).alias("s")).collect():
        assert r["s"] == r["c"].strip()


def test_customer_keys(spark):
    text = T.StringType()
    for value, wanted in [("17850.0", "17850"), ("12.5.6", "12"), (".5", ""), ("", "UNKNOWN"), (None, "UNKNOWN"), ("A-1", "A-1")]:
        assert one(spark, value, text, lambda c: scalar.customer_text(c, text)) == wanted
    number = T.DoubleType()
    for value, wanted in [(12345678.0, "12345678"), (12.9, "12"), (float("nan"), "UNKNOWN"), (None, "UNKNOWN")]:
        assert one(spark, value, number, lambda c: scalar.customer_text(c, number)) == wanted
    assert one(spark, 42, T.LongType(), lambda c: scalar.customer_text(c, T.LongType())) == "42"


def test_date_parts_agree_with_pandas(spark):
    days = pd.date_range("2017-12-25", "2021-01-10", freq="31h")
    df = spark.createDataFrame(pd.DataFrame({"t": days}))
    df = df.select("t", *[c.alias(n) for n, c in scalar.date_parts(F.col("t")).items()])
    for r in df.collect():
        t = pd.Timestamp(r["t"])
        assert (
            r["OrderYear"], r["OrderMonth"], r["OrderDay"], r["OrderDayOfWeek"], r["OrderHour"],
            r["OrderWeekOfYear"], r["OrderQuarter"],
        ) == (t.year, t.month, t.day, t.dayofweek, t.hour, t.isocalendar().week, t.quarter)


def test_cancelled_flag_and_formats(spark):
    df = spark.createDataFrame([("C1",), ("c1",), ("1",), (None,)], "c string")
    assert [r[0] for r in df.select(scalar.starts_cancelled(F.col("c"))).collect()] == [True, False, False, False]
    t = dt.datetime(2024, 3, 5, 6, 7, 8)
    assert one(spark, t, T.TimestampNTZType(), scalar.day_text) == "2024-03-05"
    assert one(spark, t, T.TimestampNTZType(), scalar.stamp_text) == "20240305060708"
    assert one(spark, 1234567.891, T.DoubleType(), scalar.money_text) == "1,234,567.89"


def test_search_terms(spark):
    df = spark.createDataFrame([("Red Mug",), ("a.b",), ("axb",), (None,)], "c string")
    hits = lambda **k: [r["c"] for r in df.where(scalar.matches_term(F.col("c"), **k)).collect()]
    assert hits(term="red") == ["Red Mug"]
    assert hits(term="A.B") == ["a.b", "axb"]
    assert hits(term="A.B", literal=True) == ["a.b"]


LAYOUTS = {
    "2010/12/01": (2010, 12, 1), "1 Dec 2010": (2010, 12, 1), "December 1, 2010": (2010, 12, 1), "01-Dec-2010 08:26": (2010, 12, 1, 8, 26),
    "12/1/2010 8:26 PM": (2010, 12, 1, 20, 26), "12/1/2010 12:05 am": (2010, 12, 1, 0, 5), "12/1/10 8:26": (2010, 12, 1, 8, 26),
    "12/1/99": (1999, 12, 1), "2010-12-01T08:26:30.5": (2010, 12, 1, 8, 26, 30, 500000), "Sept 3, 2011 1:02:03 PM": (2011, 9, 3, 13, 2, 3),
    "2010/12/1 08:26": (2010, 12, 1, 8, 26), "Dez 1 2010": None, "13/13/2010": None, "12/1/2010 13:00 PM": None, "c 2010": None,
}


def test_date_layouts(spark):
    df = spark.createDataFrame([(t,) for t in LAYOUTS], "t string")
    found = df.select("t", scalar.parse_timestamp(F.col("t"), df.schema["t"].dataType).alias("ts")).collect()
    assert {r["t"]: r["ts"] for r in found} == {t: v and dt.datetime(*v) for t, v in LAYOUTS.items()}
    shown = scalar.parse_timestamp(F.lit("01.12.2010"), df.schema["t"].dataType, ["yyyy/MM/dd", "dd.MM.yyyy"])
    assert spark.range(1).select(shown).first()[0] == dt.datetime(2010, 12, 1)
