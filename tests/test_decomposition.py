import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyshelf.operators.decomposition import decompose


def brute(y, p, additive=True):
    """Textbook version with plain loops."""
    n, half = len(y), p // 2
    kernel = np.ones(p) / p if p % 2 else np.r_[0.5, np.ones(p - 1), 0.5] / p
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = (kernel * y[i - half : i + half + 1]).sum()
    front, back = half, n - 1 - half

    def line(lo, hi, at):
        x = np.arange(lo, hi)
        k, c = np.linalg.lstsq(np.c_[x, np.ones(len(x))], trend[lo:hi], rcond=-1)[0]
        return k * at + c

    head = line(front, min(front + p, back), np.arange(front))
    tail = line(max(front, back - p), back, np.arange(back + 1, n))
    trend[:front], trend[back + 1 :] = head, tail
    free = y - trend if additive else y / trend
    index = np.array([free[k::p].mean() for k in range(p)])
    index = index - index.mean() if additive else index / index.mean()
    seasonal = index[np.arange(n) % p]
    return trend, seasonal, free - seasonal if additive else free / seasonal


def frame(spark, series):
    parts = [
        pd.DataFrame({"k": k, "bucket": pd.date_range("2020-01-01", periods=len(y)).date, "value": y}) for k, y in series.items()
    ]
    return spark.createDataFrame(pd.concat(parts), "k string, bucket date, value double")


def wave(n, p, seed=0):
    t = np.arange(n)
    return 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / p) + np.random.default_rng(seed).normal(0, 2, n)


@pytest.mark.parametrize("n,p", [(40, 12), (41, 7), (24, 12), (14, 7), (30, 4), (6, 3), (4, 2), (5, 2)])
@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_agrees_with_the_textbook(spark, n, p, model):
    both = {"a": wave(n, p), "b": wave(n, p, 1) + 100}
    got = decompose(frame(spark, both), "value", p, model, by=["k"]).orderBy("bucket").toPandas()
    for k, y in both.items():
        part = got[got["k"] == k]
        for column, wanted in zip(("trend", "seasonal", "resid"), brute(y, p, model == "additive"), strict=True):
            np.testing.assert_allclose(part[column].astype(float), wanted, rtol=1e-8, atol=1e-8)
        assert set(part["status"]) == {"ok"}


def test_parts_recombine(spark):
    df = decompose(frame(spark, {"a": wave(60, 12)}).drop("k"), "value", 12)
    assert df.where(F.abs(F.col("trend") + F.col("seasonal") + F.col("resid") - F.col("value")) > 1e-9).count() == 0
    df = decompose(frame(spark, {"a": wave(60, 12)}).drop("k"), "value", 12, "multiplicative")
    assert df.where(F.abs(F.col("trend") * F.col("seasonal") * F.col("resid") - F.col("value")) > 1e-9).count() == 0


def test_unusable_series_are_marked_not_lost(spark):
    gaps, negative = wave(30, 12), wave(30, 12)
    gaps[3], negative[4] = np.nan, -1
    df = frame(spark, {"short": wave(23, 12), "gaps": gaps, "negative": negative, "fine": wave(30, 12)})
    df = df.withColumn("value", F.nanvl("value", F.lit(None)))
    got = decompose(df, "value", 12, "multiplicative", by=["k"])
    status = {r["k"]: (r["status"], r["n"], r["t"]) for r in got.groupBy("k", "status").agg(F.count("*").alias("n"), F.count("trend").alias("t")).collect()}
    assert status == {"short": ("short", 23, 0), "gaps": ("has_nulls", 30, 0), "negative": ("non_positive", 30, 0), "fine": ("ok", 30, 30)}


def test_bad_arguments(spark):
    df = frame(spark, {"a": wave(30, 12)})
    for bad in (dict(period=1), dict(period=12, model="other")):
        with pytest.raises(ValueError):
            decompose(df, "value", **bad)
    with pytest.raises(ValueError):
        decompose(df, "k", 12)
    with pytest.raises(ValueError):
        decompose(df, "value", 12, order="value")
