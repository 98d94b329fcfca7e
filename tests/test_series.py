import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyshelf.functions.buckets import bucket_for, default_period
from tallyshelf.operators import series

HOWS = ("sum", "mean", "median", "first", "last", "count")
PANDAS_NAMES = {"M": "ME", "Q": "QE", "AS": "YS", "A": "YE"}


def sales(n=400, seed=3):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp("2022-11-03 05:00")
    ts = start + pd.to_timedelta(np.sort(rng.integers(0, 500 * 24 * 60, n)), unit="min")
    ts = ts[~((ts >= "2023-02-10") & (ts < "2023-05-20"))]  # leaves empty weeks and months
    values = np.round(rng.normal(10, 5, len(ts)), 2)
    values[rng.random(len(ts)) < 0.1] = np.nan
    return pd.DataFrame({"ts": ts, "v": values}).drop_duplicates("ts")


@pytest.fixture(scope="module")
def frame(spark):
    pdf = sales()
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return pdf, df


@pytest.mark.parametrize("freq", ["D", "W", "W-WED", "MS", "M", "QS", "Q", "AS", "A", "6h", "12h"])
def test_resample_agrees_with_pandas(frame, freq):
    pdf, df = frame
    wanted = pdf.set_index("ts")["v"].resample(PANDAS_NAMES.get(freq, freq)).agg(list(HOWS))
    got = series.resample(df, "ts", {h: ("v", h) for h in HOWS}, freq).orderBy("bucket").toPandas()
    assert pd.to_datetime(got["bucket"]).tolist() == wanted.index.tolist()
    for h in HOWS:
        np.testing.assert_allclose(got[h].astype(float), wanted[h].astype(float), rtol=1e-9)


def test_calendar_edges(spark):
    points = [
        (dt.datetime(2024, 1, 7, 10), 1.0), (dt.datetime(2024, 1, 8), 2.0), (dt.datetime(2024, 1, 31, 23, 59), None),
        (dt.datetime(2024, 4, 30, 12), 5.0), (dt.datetime(2024, 12, 31), -5.0),
    ]
    df = spark.createDataFrame(points, "ts timestamp_ntz, v double")
    weeks = [r["bucket"] for r in series.resample(df, "ts", {"s": ("v", "sum")}, "W").orderBy("bucket").limit(2).collect()]
    assert weeks == [dt.date(2024, 1, 7), dt.date(2024, 1, 14)]
    months = series.resample(df, "ts", {"s": ("v", "sum"), "n": ("v", "count"), "m": ("v", "mean")}, "MS")
    got = rows(months, "bucket")
    assert got[0] == (dt.date(2024, 1, 1), 3.0, 2, 1.5)
    assert got[1] == (dt.date(2024, 2, 1), 0.0, 0, None)
    filled = [r["m"] for r in series.forward_fill(months, ["m"]).orderBy("bucket").collect()]
    assert filled[:4] == [1.5, 1.5, 1.5, 5.0]
    for freq in ("Q", "A"):
        assert series.resample(df, "ts", {"s": ("v", "sum")}, freq).agg(F.max("bucket")).first()[0] == dt.date(2024, 12, 31)


def test_buckets_keep_the_total(frame):
    pdf, df = frame
    for freq in ("D", "W", "MS"):
        total = series.resample(df, "ts", {"s": ("v", "sum")}, freq).agg(F.sum("s")).first()[0]
        assert total == pytest.approx(pdf["v"].sum())


def test_series_do_not_mix(spark):
    points = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 3), 3.0), ("b", dt.date(2024, 1, 2), 5.0), (None, dt.date(2024, 1, 9), 9.0)]
    df = spark.createDataFrame(points, "k string, d date, v double")
    got = rows(series.prepare_series(df, "d", "v", "mean", "D", by=["k"]))
    assert got == [
        ("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), 1.0), ("a", dt.date(2024, 1, 3), 3.0), ("b", dt.date(2024, 1, 2), 5.0)
    ]


def test_unknown_names_are_refused(frame):
    _, df = frame
    for freq in ("fortnight", "0h", "2X", "W-XYZ"):
        with pytest.raises(ValueError):
            series.resample(df, "ts", {"s": ("v", "sum")}, freq)
    with pytest.raises(ValueError):
        series.resample(df, "ts", {"s": ("v", "mode")}, "D")
    with pytest.raises(ValueError):
        series.resample(df, "v", {"s": ("v", "sum")}, "D")


def test_daily_trend_drops_empty_days(spark):
    points = [(dt.datetime(2024, 1, 1, 1), 1.0), (dt.datetime(2024, 1, 1, 2), -1.0), (dt.datetime(2024, 1, 3), 4.0), (dt.datetime(2024, 1, 4), None)]
    df = spark.createDataFrame(points, "ts timestamp_ntz, v double")
    day = lambda n: dt.date(2024, 1, n)
    assert rows(series.trend(df, "ts", "v")) == [(day(3), 4.0)]
    assert rows(series.trend(df, "ts", "v", "mean")) == [(day(1), 0.0), (day(3), 4.0)]
    assert rows(series.trend(df, "ts", "v", "count")) == [(day(1), 2), (day(3), 1)]
    assert series.trend(df, "ts", "v", "sum", "D").count() == 4


def month_series(spark, n, by=None):
    pdf = pd.DataFrame({"bucket": pd.date_range("2020-01-01", periods=n, freq="MS").date, "value": np.arange(n, dtype=float)})
    df = spark.createDataFrame(pdf, "bucket date, value double")
    return df.withColumn("k", F.lit(by)) if by else df


def test_splits_and_status(spark):
    both = month_series(spark, 30, "a").unionByName(month_series(spark, 5, "b"))
    train, test = series.split_tail(both, 5, ["k"])
    assert train.count() == 25 and test.count() == 10
    status = {r["k"]: r["status"] for r in series.length_status(both, 5, 1, 1, 12, ["k"]).collect()}
    assert status == {"a": "ok", "b": "rejected"}
    assert series.rows_of(both, test, ["k"]).count() == 10
    assert series.align(test, both.withColumnRenamed("value", "x"), ["k"]).count() == 10
    assert series.side_by_side(test, both.withColumnRenamed("value", "x"), ["k"]).count() == 35


def test_frequency_names(spark):
    for freq, wanted, period in [("D", "D", 7), ("W-MON", "W-MON", 52), ("W-SUN", "W-SUN", 52), ("MS", "MS", 12), ("ME", "M", 12),
                                 ("QS", "QS", 4), ("QE", "Q", 4), ("YS", "AS", None), ("YE", "A", None)]:
        days = pd.date_range("2020-01-01", periods=9, freq=freq).date
        df = spark.createDataFrame(pd.DataFrame({"bucket": days}), "bucket date")
        got = series.infer_frequency(df).first()
        assert (got["freq"], got["period"]) == (wanted, period)
        assert default_period(wanted) == period
    odd = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 2, 5, 9)], "bucket date")
    assert series.infer_frequency(odd).first()["freq"] is None
    assert series.infer_frequency(odd.limit(2)).first()["freq"] is None


def test_clock_buckets_are_filled_day_by_day(spark, capsys):
    rng = np.random.default_rng(8)
    at = pd.to_datetime("2024-02-27 22:13:07") + pd.to_timedelta(np.sort(rng.choice(9 * 24 * 60, 60, replace=False)), unit="min")
    at = at[(at.day != 1) & (at.day != 2)]  # two days without any
    pdf = pd.DataFrame({"k": np.where(rng.random(len(at)) < 0.5, "a", "b"), "ts": at, "v": np.where(rng.random(len(at)) < 0.3, np.nan, np.arange(len(at)))})
    df = spark.createDataFrame(pdf, "k string, ts timestamp_ntz, v double").withColumn("v", F.nanvl("v", F.lit(None)))
    for by in ([], ["k"]):
        made = series.resample(df, "ts", {"v": ("v", "last"), "n": ("v", "count")}, "30min", by)
        filled = series.forward_fill(made, ["v"], by)
        assert filled.columns == made.columns
        got = [tuple(r) for r in filled.orderBy(*by, "bucket").collect()]
        wanted = []
        for key, part in (pdf.groupby("k") if by else [(None, pdf)]):
            one = part.set_index("ts")["v"].resample("30min").agg(["last", "count"])
            last = one["last"].ffill()
            wanted += [(*([key] if by else []), t.to_pydatetime(), None if np.isnan(v) else v, n) for t, v, n in zip(one.index, last, one["count"])]
        assert got == wanted


def our_name(name):
    """The library's spelling of what pandas calls a frequency."""
    if name is None:
        return None
    n, unit, anchor = re.fullmatch(r"(\d*)([A-Za-z]+)(-.*)?", name).groups()
    unit = {"ME": "M", "BME": "BM", "QE": "Q", "BQE": "BQ", "YE": "A", "BYE": "BA", "YS": "AS", "BYS": "BAS"}.get(unit, unit)
    default = {"A": "-DEC", "BA": "-DEC", "AS": "-JAN", "BAS": "-JAN", "Q": "-DEC", "BQ": "-DEC", "QS": "-OCT", "BQS": "-OCT"}.get(unit)
    return n + unit + ("" if anchor in (None, default) else anchor)


def test_frequencies_agree_with_pandas(spark):
    made = ["D", "2D", "3D", "W-WED", "2W-FRI", "MS", "ME", "2MS", "3MS", "5ME", "BME", "BMS", "QS", "QE", "QS-FEB", "QE-JAN", "2QS", "BQE", "BQS",
            "YS", "YE", "YS-APR", "YE-MAR", "2YS", "3YE", "BYE", "BYS", "B", "h", "3h", "25h", "15min", "7min", "90s", "s", "500ms", "WOM-2TUE", "WOM-1MON", "36h"]
    stamps = [(f, t) for f in made for t in pd.date_range("2019-03-05 08:30", periods=17, freq=f).to_pydatetime()]
    office = pd.date_range("2024-01-01 09:00", periods=40, freq="bh")
    odd = {
        "office": office, "gap": pd.to_datetime(["2020-01-01", "2020-01-02", "2020-01-05", "2020-01-09"]), "few": pd.date_range("2020-01-01", periods=2),
        "some months": pd.to_datetime(["2020-01-01", "2020-02-01", "2020-04-01", "2020-05-01"]), "workdays": pd.date_range("2024-01-03", periods=4, freq="B"),
        "one weekend": pd.date_range("2024-01-04", periods=4, freq="B"), "clock": pd.to_datetime(["2020-01-01 00:00", "2020-01-01 01:00", "2020-01-01 03:00"]),
    }
    stamps += [(k, t) for k, v in odd.items() for t in v.to_pydatetime()]
    stamps += [("twice", dt.datetime(2020, 1, d)) for d in (1, 2, 2, 3)]
    df = spark.createDataFrame(stamps, "made string, bucket timestamp_ntz")
    got = {r["made"]: r["freq"] for r in series.infer_frequency(df, ["made"]).collect()}
    index = {k: pd.DatetimeIndex([t for m, t in stamps if m == k]) for k in got}
    expected = {k: our_name(pd.infer_freq(v)) if len(v) > 2 and v.is_unique else None for k, v in index.items()}
    assert got == expected


def test_duplicates_are_found(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 1),), (dt.date(2020, 1, 2),)], "bucket date")
    assert rows(series.duplicate_buckets(df)) == [(dt.date(2020, 1, 1), 2)]


@pytest.mark.parametrize("d,seasonal_d", [(1, 0), (2, 0), (0, 1), (1, 1), (2, 2)])
def test_difference_agrees_with_pandas(spark, d, seasonal_d):
    rng = np.random.default_rng(0)
    s = pd.Series(rng.normal(size=40).cumsum())
    df = spark.createDataFrame(pd.DataFrame({"bucket": pd.date_range("2020-01-01", periods=40).date, "value": s}), "bucket date, value double")
    wanted = s
    for _ in range(d):
        wanted = wanted.diff()
    for _ in range(seasonal_d):
        wanted = wanted.diff(4)
    got = series.difference(df, "value", "w", d, seasonal_d, 4).orderBy("bucket").toPandas()["w"]
    np.testing.assert_allclose(got.astype(float), wanted, atol=1e-9)


def test_bucket_steps_round_trip(spark):
    for freq in ("D", "W", "W-TUE", "MS", "M", "QS", "Q", "AS", "A"):
        rule = bucket_for(freq)
        day = F.lit(dt.date(2023, 11, 17))
        here = rule.label(rule.start(day))
        after = rule.label(rule.advance(rule.start(here), F.lit(1)))
        a, b = spark.range(1).select(here, after).first()
        wanted = pd.date_range("2023-11-17", periods=2, freq=PANDAS_NAMES.get(freq, freq))
        labels = pd.Series([1], index=[pd.Timestamp("2023-11-17")]).resample(PANDAS_NAMES.get(freq, freq)).sum().index
        assert pd.Timestamp(a) == labels[0] and (pd.Timestamp(b) == wanted[1] or pd.Timestamp(b) == wanted[0]) and b > a
