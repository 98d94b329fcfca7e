"""Tables behind the residual diagnostics of a fitted series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.operators.series import BUCKET, series_window


def standardized(residuals: DataFrame, resid: str = "resid", by: Sequence[str] = ()) -> DataFrame:
    """Residuals minus their mean, over their standard deviation, per series."""
    whole = series_window(by)
    z = F.try_divide(F.col(resid) - F.avg(resid).over(whole), F.stddev_pop(resid).over(whole))
    return residuals.where(F.col(resid).isNotNull()).withColumn("z", z)


# Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9).
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL = 0.02425


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(share: Column) -> Column:
    """Value below which a standard normal variable lies with the given probability."""
    near = F.least(share, 1 - share)
    root = F.sqrt(-2 * F.ln(near))
    tail = _polynomial(root, TAIL_TOP) / _polynomial(root, TAIL_BOTTOM)
    centred = share - 0.5
    squared = centred * centred
    middle = _polynomial(squared, MIDDLE_TOP) * centred / _polynomial(squared, MIDDLE_BOTTOM)
    return F.when(near >= TAIL, middle).when(share < 0.5, tail).otherwise(-tail)


def qq_points(residuals: DataFrame, z: str = "z", by: Sequence[str] = (), order: str = BUCKET) -> DataFrame:
    """Sorted residuals against the normal quantiles of rank / (n + 1)."""
    place = F.row_number().over(series_window(by, z, order))
    total = F.count(F.lit(1)).over(series_window(by))
    ranked = residuals.where(F.col(z).isNotNull()).select(
        *by, F.col(z).alias("sample"), place.alias("rank"), (place / (total + 1)).alias("share")
    )
    return ranked.withColumn("theoretical", normal_quantile(F.col("share")))


def autocorrelation(series: DataFrame, value: str, lags: int = 10, by: Sequence[str] = (), order: str = BUCKET) -> DataFrame:
    """Autocorrelation at lags 0..``lags`` per series, all lags from one window pass and one aggregate."""
    rows = series.where(F.col(value).isNotNull())
    centred = rows.withColumn("_c", F.col(value) - F.avg(value).over(series_window(by)))
    run = series_window(by, order)
    products = centred.select(*by, *[(F.col("_c") * F.lag("_c", k).over(run)).alias(f"_p{k}") for k in range(lags + 1)])
    sums = products.groupBy(*by).agg(*[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(lags + 1)])
    cells = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_s0")).alias("acf")) for k in range(lags + 1)
    ]
    return sums.select(*by, F.inline(F.array(*cells))).where(F.col("acf").isNotNull())


def histogram_by(residuals: DataFrame, z: str = "z", by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per series equal-width bins over its own range, scaled to a density; empty bins show 0."""
    rows = residuals.where(F.col(z).isNotNull()).select(*by, F.col(z).alias("_z"))
    facts = rows.groupBy(*by).agg(F.min("_z").alias("_lo"), F.max("_z").alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    # a series of equal values has no width and one bin of its own, half a unit to each side
    pad = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    facts = facts.select(*by, (F.col("_lo") - pad).alias("_lo"), ((F.col("_hi") - F.col("_lo") + 2 * pad) / bins).alias("_w"), "_rows")
    met = rows.join(facts, list(by)) if by else rows.crossJoin(F.broadcast(facts))
    bin_of = F.least(F.floor((F.col("_z") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = met.select(*by, bin_of.alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = facts.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    found = edges.join(counts, [*by, "bin"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return found.select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"),
                        n.alias("n"), (n / (F.col("_rows") * F.col("_w"))).alias("density"))


def density_by(residuals: DataFrame, z: str = "z", by: Sequence[str] = (), points: int = 50, reach: float = 3.92) -> DataFrame:
    """Per series the Gaussian density estimate (Scott's rule) between -reach and reach, beside the standard normal density."""
    rows = residuals.where(F.col(z).isNotNull()).select(*by, F.col(z).alias("_z"))
    whole = series_window(by)
    spread = rows.withColumns({"_n": F.count(F.lit(1)).over(whole).cast("double"), "_sd": F.stddev_samp("_z").over(whole)})
    spread = spread.withColumn("_h", F.col("_sd") * F.pow("_n", F.lit(-0.2))).where("_h > 0")
    grid = spread.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.lit(-reach) + F.col("point") * F.lit(2 * reach / (points - 1))
    u = (x - F.col("_z")) / F.col("_h")
    summed = grid.select(*by, "point", x.alias("x"), (F.exp(-u * u / 2) / (F.col("_n") * F.col("_h"))).alias("_k")).groupBy(*by, "point", "x").agg(F.sum("_k").alias("_s"))
    root = F.sqrt(2 * F.pi())
    return summed.select(*by, "point", "x", (F.col("_s") / root).alias("density"), (F.exp(-F.col("x") * F.col("x") / 2) / root).alias("normal"))


def diagnose(
    residuals: DataFrame, resid: str = "resid", by: Sequence[str] = (), order: str = BUCKET, *, lags: int = 10, bins: int = 10, points: int = 50
) -> dict[str, DataFrame]:
    """The tables behind the four diagnostic charts of fitted series, all per series.

    ``residuals`` (standardized, in order), ``histogram`` and ``density`` (with the normal one), ``qq`` and ``acf``. Series
    are what a seasonal model was fitted to, so each is small; they are spread by ``by``.
    """
    standard = standardized(residuals, resid, by).select(*by, order, "z")
    return {
        "residuals": standard,
        "histogram": histogram_by(standard, "z", by, bins),
        "density": density_by(standard, "z", by, points),
        "qq": qq_points(standard, "z", by, order),
        "acf": autocorrelation(standard, "z", lags, by, order),
    }


def as_one_table(tables: dict[str, DataFrame], by: Sequence[str] = (), order: str = BUCKET) -> DataFrame:
    """The tables of :func:`diagnose` in long form: (by, chart, place, x, y)."""
    shapes = {
        "residuals": (F.row_number().over(series_window(by, order)), F.lit(None).cast("double"), F.col("z")),
        "histogram": (F.col("bin"), F.col("lower"), F.col("density")), "density": (F.col("point"), F.col("x"), F.col("density")),
        "qq": (F.col("rank"), F.col("theoretical"), F.col("sample")), "acf": (F.col("lag"), F.col("lag").cast("double"), F.col("acf")),
    }
    out = None
    for chart, (place, x, y) in shapes.items():
        one = tables[chart].select(*by, F.lit(chart).alias("chart"), place.cast("int").alias("place"), x.alias("x"), y.alias("y"))
        out = one if out is None else out.unionByName(one)
    return out
