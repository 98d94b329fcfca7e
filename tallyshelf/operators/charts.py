"""The small tables charts are drawn from; drawing itself is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.operators.totals import sum_by
from tallyshelf.schema import nan_to_null, require_columns, require_kind

# Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054

PRIME = (1 << 31) - 1
# below which draw a row is taken 0, 1, ... 9 times; beyond the last one 10 times
POISSON_STEPS = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(10)]


def _facts(values: DataFrame) -> Column:
    """Scalar struct of the column ``_v``: ends of the range, count, spread, whether it varies.

    A constant column gets half a unit of room on each side.
    """
    lo, hi = F.min("_v"), F.max("_v")
    pad = F.when(lo == hi, 0.5).otherwise(0.0)
    facts = values.agg(
        F.struct(
            (lo - pad).alias("lo"), (hi + pad).alias("hi"), F.count("_v").alias("rows"),
            F.stddev_samp("_v").alias("sd"), (lo < hi).alias("varies"),
        )
    )
    return facts.scalar()


def _bin_of(value: Column, facts: Column, bins: int) -> Column:
    share = (value - facts["lo"]) / (facts["hi"] - facts["lo"])
    return F.least(F.floor(share * bins) + 1, F.lit(bins)).cast("int")


def _values(df: DataFrame, column: str) -> DataFrame:
    require_kind(df, column, "numeric")
    return nan_to_null(df.select(F.col(column).cast("double").alias("_v"))).where(F.col("_v").isNotNull())


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins from the minimum to the maximum, the last one closed; empty bins show 0."""
    values = _values(df, column)
    facts = _facts(values)
    counts = values.select(_bin_of(F.col("_v"), facts, bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("_n"))
    edges = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), facts.alias("_f"))
    width = (F.col("_f.hi") - F.col("_f.lo")) / bins
    edges = edges.where(F.col("_f.lo").isNotNull()).select(
        "bin", (F.col("_f.lo") + (F.col("bin") - 1) * width).alias("lower"), (F.col("_f.lo") + F.col("bin") * width).alias("upper")
    )
    return edges.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("_n", F.lit(0)).alias("n"))


CELLS_PER_BANDWIDTH = 16
REACH = 9  # bandwidths; what lies further off adds less than 1e-17 of a row


def density_curve(df: DataFrame, column: str, bins: int = 30, points: int = 200) -> DataFrame:
    """Gaussian density estimate over the value range, scaled to the counts of a ``bins``-bin histogram.

    Rows are reduced to cells of a sixteenth of the bandwidth (Scott's rule), each with its count, mean and central
    moments up to the fourth; only cells that hold rows exist, however wide the range. A grid point adds up the
    cells within nine bandwidths, which it meets by cell number, with the kernel expanded around each cell's mean;
    the sum agrees with the sum over all rows to about nine digits.
    """
    values = _values(df, column)
    facts = values.select("_v").agg(
        F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.stddev_samp("_v").alias("sd"), F.count("_v").alias("rows")).alias("_f"))
    low, width = F.col("_f.lo"), F.col("_f.hi") - F.col("_f.lo")
    bandwidth = F.col("_f.sd") * F.pow(F.col("_f.rows").cast("double"), F.lit(-0.2))
    step = F.col("_h") / CELLS_PER_BANDWIDTH
    cell_of = lambda x: F.floor((x - F.col("_lo")) / step)
    facts = facts.where(width > 0).select(low.alias("_lo"), width.alias("_w"), bandwidth.alias("_h"))
    one = facts.select(F.struct("*"))
    rows = values.withColumn("_f", one.scalar()).select("_v", "_f.*").where("_h IS NOT NULL")
    # values are taken relative to the middle of their cell, which keeps the moments accurate
    rows = rows.withColumn("_cell", cell_of(F.col("_v")))
    rows = rows.withColumn("_d", (F.col("_v") - F.col("_lo") - (F.col("_cell") + 0.5) * step) / F.col("_h"))
    powers = [F.sum(F.pow("_d", F.lit(float(k)))).alias(f"_s{k}") for k in range(1, 5)]
    cells = rows.groupBy("_cell").agg(F.count("*").cast("double").alias("_n"), *powers)
    grid = df.sparkSession.range(points).crossJoin(F.broadcast(facts)).select(
        F.col("id").cast("int").alias("point"), (F.col("_lo") + F.col("id") * (F.col("_w") / (points - 1))).alias("x"), "_lo", "_w", "_h")
    near = F.sequence(cell_of(F.col("x")) - REACH * CELLS_PER_BANDWIDTH, cell_of(F.col("x")) + REACH * CELLS_PER_BANDWIDTH)
    met = grid.withColumn("_cell", F.explode(near)).join(cells, "_cell")
    u = (F.col("x") - F.col("_lo") - (F.col("_cell") + 0.5) * step) / F.col("_h")
    # the kernel at u - d in powers of d: Hermite polynomials of u
    series = (
        F.col("_n") + u * F.col("_s1") + (u * u - 1) / 2 * F.col("_s2") + (u * u * u - 3 * u) / 6 * F.col("_s3")
        + (F.pow(u, F.lit(4.0)) - 6 * u * u + 3) / 24 * F.col("_s4")
    )
    summed = met.groupBy("point").agg(F.sum(F.exp(-0.5 * u * u) * series).alias("_sum"))
    scale = F.col("_w") / bins / (F.col("_h") * F.sqrt(2 * F.pi()))
    return grid.join(F.broadcast(summed), "point", "left").select(
        "point", "x", (scale * F.coalesce("_sum", F.lit(0.0))).alias("density"))


def bar_table(df: DataFrame, x: str, y: str, *, order: str = "desc", top_n: int | None = None) -> DataFrame:
    """Sum of y per x, sorted; ``top_n`` keeps the first n of that order.

    A horizontal chart that sorts ascending before cutting is ``order="asc"``: the smallest n.
    """
    if order not in ("desc", "asc"):
        raise ValueError("order must be 'desc' or 'asc'")
    bars = sum_by(df, x, y).orderBy(F.col(y).desc() if order == "desc" else F.col(y).asc(), x)
    return bars.limit(top_n) if top_n and top_n > 0 else bars


def pie_table(
    df: DataFrame, names: str, values: str, *, max_slices: int = 10, other_label: str = "Other"
) -> DataFrame:
    """Share of each name; beyond ``max_slices`` names the smaller ones become one slice if it is positive."""
    sums = sum_by(df, names, values, "_value")
    rank = F.row_number().over(Window.orderBy(F.desc("_value"), names))
    # at most max_slices + 1 rows reach the unpartitioned window and the broadcast
    leaders = sums.orderBy(F.desc("_value"), names).limit(max_slices + 1).select(names, rank.alias("_rank"))
    leaders = leaders.withColumn("_seen", F.max("_rank").over(Window.partitionBy()))
    leaders = leaders.where((F.col("_rank") < max_slices) | (F.col("_seen") <= max_slices)).select(names, "_rank")
    folded = F.col("_rank").isNull()
    slices = (
        sums.join(F.broadcast(leaders), names, "left")
        .groupBy(
            folded.alias("is_other"),
            F.when(folded, other_label).otherwise(F.col(names).cast("string")).alias(names),
        )
        .agg(F.sum("_value").alias(values))
        .where(~F.col("is_other") | (F.col(values) > 0))
    )
    whole = F.sum(values).over(Window.partitionBy())
    return slices.withColumn("share", F.try_divide(F.col(values).cast("double"), whole.cast("double")))


def _band_keys(df: DataFrame, x: str, y: str, hue: str | None) -> list[str]:
    require_columns(df, x, y)
    return [x, hue] if hue and hue in df.columns else [x]


def line_table(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean of y per x (and hue) with a 95 % band from the normal approximation of the mean."""
    keys = _band_keys(df, x, y, hue)
    means = df.dropna(subset=[*keys, y]).groupBy(*keys).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("_sd"), F.count(y).alias("n")
    )
    half = F.coalesce(Z95 * F.col("_sd") / F.sqrt(F.col("n")), F.lit(0.0))
    return means.select(*keys, "mean", "n", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def _draw(row: Column, replicate: Column, seed: int) -> Column:
    """A whole number below PRIME for a row in a replicate, the same in every run."""
    first = (F.pmod(row, F.lit(PRIME)) * 48_271 + replicate.cast("long") * 69_621 + seed) % PRIME
    second = (first * (first + 16_807)) % PRIME
    return (second * (second + 40_692)) % PRIME


def poisson_weight(draw: Column) -> Column:
    """How often a row is drawn: the inverse of the Poisson distribution with mean 1 at draw / PRIME."""
    weight = F.lit(len(POISSON_STEPS))
    for times in range(len(POISSON_STEPS) - 1, -1, -1):
        weight = F.when(draw < POISSON_STEPS[times], times).otherwise(weight)
    return weight


def line_bootstrap(
    df: DataFrame, x: str, y: str, hue: str | None = None, *, key: Sequence[str], replicates: int = 1000, seed: int = 0
) -> DataFrame:
    """Mean of y per x (and hue) with a 95 % band from the bootstrap of the mean.

    In every replicate a row counts as often as a Poisson variable of mean 1 says, drawn from its ``key``, the replicate
    and the seed, so a run over the same rows draws the same wherever they lie. Sums and weights are partial aggregates
    of one scan: a point with a third of all rows sends one row per replicate and task. The band lies between the
    2.5 % and the 97.5 % quantile (interpolated) of the replicates' means; a replicate that draws no row of a point gives it no mean.
    ``key`` should identify a row: rows with equal keys are drawn together.
    """
    require_columns(df, *key)
    keys = _band_keys(df, x, y, hue)
    whole = len(key) == 1 and isinstance(df.schema[key[0]].dataType, (T.IntegerType, T.LongType))
    row = F.coalesce(F.col(key[0]).cast("long"), F.lit(0)) if whole else F.xxhash64(*key)
    rows = df.dropna(subset=[*keys, y]).select(*keys, F.col(y).cast("double").alias("_y"), row.alias("_row"))
    spread = rows.select(*keys, "_y", "_row", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_replicate"))
    drawn = spread.select(*keys, "_replicate", "_y", _draw(F.col("_row"), F.col("_replicate"), seed).alias("_draw"))
    weighed = drawn.select(*keys, "_replicate", "_y", poisson_weight(F.col("_draw")).alias("_w"))
    sums = weighed.groupBy(*keys, "_replicate").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_y")).alias("_s"))
    means = sums.where("_w > 0").select(*keys, (F.col("_s") / F.col("_w")).alias("_m"))
    # at most `replicates` means per point
    bands = means.groupBy(*keys).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    plain = rows.groupBy(*keys).agg(F.avg("_y").alias("mean"), F.count("_y").alias("n"))
    return plain.join(bands, keys).select(*keys, "mean", "n", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def trend_table(df: DataFrame, date: str, sales: str, *, key: Sequence[str] = (), replicates: int = 1000) -> DataFrame:
    """The line table of sales over dates, in date order; with a ``key``, its band comes from the bootstrap."""
    lines = line_bootstrap(df, date, sales, key=key, replicates=replicates) if key else line_table(df, date, sales)
    return lines.orderBy(date)


def scatter_table(
    df: DataFrame, x: str, y: str, hue: str | None = None, *, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """The points; ``fraction`` draws a seeded sample for charts that cannot take them all."""
    require_columns(df, x, y)
    points = df.select(x, y, *([hue] if hue and hue in df.columns else [])).dropna(subset=[x, y])
    return points.sample(fraction=fraction, seed=seed) if fraction is not None else points
