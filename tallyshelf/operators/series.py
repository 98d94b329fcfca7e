"""Time series from rows: calendar resampling, filling, alignment, splits and checks.

``by`` names the columns that identify a series; with none there is one series. Windows here
run over buckets, never over the rows that were aggregated into them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.aggregates import AGGREGATORS, ZERO_WHEN_EMPTY, named_aggregate, order_of
from tallyshelf.functions.buckets import CHUNK, Bucket, bucket_for
from tallyshelf.functions.quantiles import quantiles
from tallyshelf.functions.scalar import parse_timestamp
from tallyshelf.schema import kind_of, require_columns, require_kind

BUCKET = "bucket"


def series_window(by: Sequence[str], *order) -> Window:
    spec = Window.partitionBy(*by)
    return spec.orderBy(*order) if order else spec


def aggregate_by_key(
    df: DataFrame, keys: Sequence[str], outputs: Mapping[str, tuple[str, str]], order: Sequence[str] = ()
) -> DataFrame:
    """``outputs`` maps a result name to (column, aggregator name); all in one aggregation.

    ``order`` decides first and last (see ``order_of``). Medians come from the distributed quantile plan, because a
    hot group must not fit into one buffer.
    """
    unknown = [how for _, how in outputs.values() if how not in AGGREGATORS]
    if unknown:
        raise ValueError(f"unknown aggregators {unknown}: use {', '.join(AGGREGATORS)}")
    plain = {o: (c, how) for o, (c, how) in outputs.items() if how != "median"}
    medians = {o: c for o, (c, how) in outputs.items() if how == "median"}
    expressions = [
        named_aggregate(how, F.col(c), order_of(df, order, c)).alias(o) for o, (c, how) in plain.items()
    ]
    rows = df.dropna(subset=list(keys))
    # the row count also keeps groups alive whose values are all missing
    result = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *expressions)
    if medians:
        columns = list(dict.fromkeys(medians.values()))
        middle = quantiles(rows, columns, [0.5], by=keys)
        middle = middle.select(*keys, *[F.col(c)[0].alias(o) for o, c in medians.items()])
        result = result.join(middle, list(keys), "left")
    return result.select(*keys, *outputs)


def resample(
    df: DataFrame,
    ts: str,
    outputs: Mapping[str, tuple[str, str]],
    freq: str,
    by: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per calendar bucket from the first to the last of each series, empty ones included.

    Empty buckets hold 0 for sum and count and null for the other aggregators.
    """
    require_kind(df, ts, "datetime")
    require_columns(df, *by, *[c for c, _ in outputs.values()])
    rule, by = bucket_for(freq), list(by)
    columns = dict.fromkeys([*by, *tie_break, *[c for c, _ in outputs.values()]])
    rows = df.where(F.col(ts).isNotNull()).select(
        rule.start(F.col(ts)).alias("_start"), F.col(ts).alias("_ts"), *[F.col(c) for c in columns]
    )
    if rule.every > 1:
        rows = rows.withColumn("_start", rule.anchored(F.col("_start"), _first_start(rows, rule, by)))
    sums = aggregate_by_key(rows, [*by, "_start"], outputs, order=("_ts", *tie_break))

    # each bucket brings the empty ones that follow it: one window, no calendar join; the steps are laid out in
    # chunks, so that no array grows with a gap
    if rule.intraday:
        # clock buckets of one series can be many: windows run inside a day, and a day's last bucket is followed by the
        # first one of the next day that has any, found over one row per day
        sums = sums.withColumn("_day", F.col("_start").cast("date"))
        firsts = sums.groupBy(*by, "_day").agg(F.min("_start").alias("_first"))
        later = firsts.select(*by, "_day", F.lead("_first").over(series_window(by, "_day")).alias("_later"))
        within = F.lead("_start").over(series_window([*by, "_day"], "_start"))
        sums = sums.withColumn("_within", within).join(later, [*by, "_day"])
        following = F.coalesce("_within", "_later")
    else:
        following = F.lead("_start").over(series_window(by, "_start"))
    spans = sums.withColumn("_steps", rule.following(F.col("_start"), following))
    chunks = spans.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_steps") - 1) / CHUNK).cast("int"))))
    base = F.col("_chunk").cast("long") * CHUNK
    spread = chunks.withColumn("_step", F.explode(F.sequence(base, F.least(F.col("_steps") - 1, base + CHUNK - 1))))
    spread = spread.withColumn("_at", rule.advance(F.col("_start"), F.col("_step") * rule.every))
    empty = F.col("_step") != 0

    def value(out: str, how: str) -> Column:
        nothing = F.lit(0).cast(sums.schema[out].dataType) if how in ZERO_WHEN_EMPTY else F.lit(None)
        return F.when(empty, nothing).otherwise(F.col(out)).alias(out)

    return spread.select(
        *by, rule.label(F.col("_at")).alias(BUCKET), *[value(o, how) for o, (_, how) in outputs.items()]
    )


def _first_start(rows: DataFrame, rule: Bucket, by: Sequence[str]) -> Column:
    """The first unit bucket of a row's series, for buckets that are counted from there."""
    first = F.min("_start") if not rule.intraday else F.min(F.date_trunc("day", F.col("_start")).cast("timestamp_ntz"))
    if not by:
        return rows.agg(first.alias("_first")).scalar()
    return first.over(Window.partitionBy(*by))


def forward_fill(series: DataFrame, columns: Sequence[str], by: Sequence[str] = (), order: str = BUCKET) -> DataFrame:
    """Missing values take the last present one before them.

    Points with a time of day are filled inside their day, and what a day begins with comes from the last values of
    the days before, one row per day: a long series of clock buckets is not one task.
    """
    start = Window.unboundedPreceding
    if not isinstance(series.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)):
        past = series_window(by, order).rowsBetween(start, 0)
        return series.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})
    keys = [*by, "_day"]
    days = series.withColumn("_day", F.col(order).cast("date"))
    ends = days.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end{i}") for i, c in enumerate(columns)])
    before = series_window(by, "_day").rowsBetween(start, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.last(f"_end{i}", ignorenulls=True).over(before).alias(f"_carried{i}") for i in range(len(columns))])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    past = series_window(keys, order).rowsBetween(start, 0)
    filled = days.withColumns({f"_in{i}": F.last(c, ignorenulls=True).over(past) for i, c in enumerate(columns)}).join(carried, same, "left")
    values = {c: F.coalesce(f"_in{i}", f"_carried{i}").alias(c) for i, c in enumerate(columns)}
    return filled.select(*[values.get(c, F.col(c)) for c in series.columns])


def daily_trend(df: DataFrame, ts: str, value: str, how: str = "sum", by: Sequence[str] = ()) -> DataFrame:
    """Value per day that occurs: zero days leave for sum and count, missing ones for the rest."""
    rows = df.where(F.col(ts).isNotNull()).withColumns({BUCKET: F.col(ts).cast("date"), "_ts": F.col(ts)})
    days = aggregate_by_key(rows, [*by, BUCKET], {value: (value, how)}, order=("_ts",))
    return days.where(F.col(value) != 0) if how in ZERO_WHEN_EMPTY else days.where(F.col(value).isNotNull())


def trend(df: DataFrame, ts: str, value: str, how: str = "sum", freq: str = "", by: Sequence[str] = (),
          date_formats: Sequence[str] = ()) -> DataFrame:
    """Trend by frequency, or by day that occurs when none is given; dates held as text are parsed first."""
    require_columns(df, ts, value)
    if kind_of(df.schema[ts].dataType) == "string":
        df = df.withColumn(ts, parse_timestamp(F.col(ts), df.schema[ts].dataType, date_formats)).dropna(subset=[ts])
    if not freq.strip():
        return daily_trend(df, ts, value, how, by)
    return resample(df, ts, {value: (value, how)}, freq, by)


def prepare_series(
    df: DataFrame,
    ts: str,
    target: str,
    how: str = "sum",
    freq: str = "MS",
    exog: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Target and exogenous columns resampled together and forward-filled: (by, bucket, value, exog...)."""
    outputs = {"value": (target, how), **{c: (c, agg) for c, agg in (exog or {}).items()}}
    series = resample(df, ts, outputs, freq, by)
    return forward_fill(series, list(outputs), by)


def align(target: DataFrame, exog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Buckets both tables have, side by side."""
    return target.join(exog, [*by, BUCKET], "inner")


def side_by_side(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All buckets of either table."""
    return left.join(right, [*by, BUCKET], "full")


def rows_of(exog: DataFrame, target: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exogenous rows whose bucket occurs in the target."""
    keys = [*by, BUCKET]
    return exog.join(target.select(*keys), keys, "left_semi")


def mark_tail(series: DataFrame, n: int, by: Sequence[str] = (), order: str = BUCKET) -> DataFrame:
    """Flag the last n buckets of each series as the test part."""
    place = F.row_number().over(series_window(by, F.desc(order)))
    return series.withColumn("is_test", place <= n)


def split_tail(series: DataFrame, n: int, by: Sequence[str] = (), order: str = BUCKET) -> tuple[DataFrame, DataFrame]:
    marked = mark_tail(series, n, by, order)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def length_status(
    series: DataFrame, n_test: int, d: int, seasonal_d: int, period: int, by: Sequence[str] = ()
) -> DataFrame:
    """Per series: ``rejected`` when the test part takes it all, ``short`` below the advised length."""
    advised = max(period, d, seasonal_d * period) + n_test + 1
    sizes = series.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") <= n_test, "rejected").when(F.col("n") < advised, "short").otherwise("ok")
    return sizes.select(*by, "n", F.lit(advised).alias("advised"), status.alias("status"))


def duplicate_buckets(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Buckets that occur more than once in a series."""
    return series.groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


# Names of months and weekdays in frequency names.
MONTH_NAMES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAY_NAMES = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
# letters after the unit by where in the month all points lie: calendar end, last working day, first, first working day
ENDS = {"calendar_end": ("M", "Q", "A"), "working_end": ("BM", "BQ", "BA"),
        "calendar_start": ("MS", "QS", "AS"), "working_start": ("BMS", "BQS", "BAS")}
MICROS = {"day": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}


def infer_frequency(series: DataFrame, by: Sequence[str] = (), order: str = BUCKET) -> DataFrame:
    """Frequency name and default season length per series, from the gaps between its points.

    Multiples carry their number (``2D``, ``3W-SUN``, ``15min``). Points a whole number of days apart are years (``A``,
    ``AS``), quarters (``Q``, ``QS``) or months (``M``, ``MS``) if all lie at the same end of the month, ``B`` before those for
    working days; other anchors than the calendar year are named (``A-MAR``, ``QS-FEB`` counts as ``QS-NOV``). Then days, weeks
    and working days (``B``), and the n-th weekday of months (``WOM-2TUE``). Other points are business hours (``bh``) or an
    equal number of hours, minutes, seconds or fractions apart. Null when nothing fits, a point occurs twice, or the series
    has fewer than three points. One aggregate over the gaps; the window runs over the points of a series.
    """
    at = F.col(order).cast("timestamp_ntz")
    points = series.where(F.col(order).isNotNull())
    spec = series_window(by, order)
    day, month_length = F.dayofmonth("_at"), F.dayofmonth(F.last_day("_at"))
    weekday = F.weekday("_at")
    ahead = points.select(*by, at.alias("_at"), F.lead(at).over(spec).alias("_next"))
    hours = F.col("_gap") / MICROS["h"]
    following = F.weekday("_next")
    gaps = ahead.withColumn("_gap", F.timestamp_diff("MICROSECOND", F.col("_at"), F.col("_next"))).select(
        *by, "_at", "_gap", day.alias("_day"), F.month("_at").alias("_month"), weekday.alias("_weekday"),
        (F.year("_next") - F.year("_at")).alias("_years"),
        ((F.year("_next") - F.year("_at")) * 12 + F.month("_next") - F.month("_at")).alias("_months"),
        (day == month_length).alias("calendar_end"),
        ((day == month_length) | ((month_length - day < 3) & (weekday == 4))).alias("working_end"),
        (day == 1).alias("calendar_start"), ((day == 1) | ((day <= 3) & (weekday == 0))).alias("working_start"),
        (((following == 0) & (F.col("_gap") == 3 * MICROS["day"])) | (following.between(1, 4) & (F.col("_gap") == MICROS["day"]))).alias("_working"),
        hours.isin(1, 17, 65).alias("_office"), F.when(day <= 28, F.floor((day - 1) / 7)).alias("_week"),
    )
    ranged = ("_gap", "_years", "_months", "_month", "_weekday", "_week")
    facts = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.month(F.min("_at")).alias("_first_month"), F.max("_weekday").alias("_a_weekday"),
        *[f(c).alias(f"{c}{k}") for c in ranged for k, f in ((0, F.min), (1, F.max))],
        *[F.bool_and(c).alias(c) for c in (*ENDS, "_working", "_office")],
    )

    def alike(name: str) -> Column:
        return F.col(f"{name}0") == F.col(f"{name}1")

    def counted(n: Column, name: Column) -> Column:
        return F.concat(F.when(n > 1, n.cast("string")).otherwise(""), name)

    def named(names: Sequence[str], number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), number.cast("int"))

    def letters(unit: int) -> Column:
        found = F.lit(None).cast("string")
        for place in reversed(ENDS):
            found = F.when(F.col(place), ENDS[place][unit]).otherwise(found)
        return found

    starts = ~F.col("calendar_end") & ~F.col("working_end")
    month, gap = F.col("_first_month"), F.col("_gap0")
    year_anchor = F.when(month == F.when(starts, 1).otherwise(12), "").otherwise(F.concat(F.lit("-"), named(MONTH_NAMES, month)))
    turn = month % 3  # quarters that start in January, or end in December, need no name
    quarter_anchor = F.when(turn == F.when(starts, 1).otherwise(0), "").otherwise(
        F.when(turn == 0, "-DEC").when(turn == 1, "-OCT").otherwise("-NOV"))
    in_place = letters(0).isNotNull() & (F.col("_months0") > 0)
    days = F.floor(gap / MICROS["day"])
    weekday_name = named(DAY_NAMES, F.col("_a_weekday") + 1)
    name = F.when((F.col("n") < 3) | (gap == 0), None)
    daily = gap % MICROS["day"] == 0
    name = name.when(daily & in_place & alike("_years") & alike("_month") & (F.col("_years0") > 0),
                     counted(F.col("_years0"), F.concat(letters(2), year_anchor)))
    name = name.when(daily & in_place & alike("_months") & (F.col("_months0") % 3 == 0),
                     counted(F.floor(F.col("_months0") / 3), F.concat(letters(1), quarter_anchor)))
    name = name.when(daily & in_place & alike("_months"), counted(F.col("_months0"), letters(0)))
    name = name.when(daily & alike("_gap") & (days % 7 == 0), counted(F.floor(days / 7), F.concat(F.lit("W-"), weekday_name)))
    name = name.when(daily & alike("_gap"), counted(days, F.lit("D")))
    name = name.when(daily & F.col("_working") & (F.col("_gap1") == 3 * MICROS["day"]) & (days == 1), "B")
    name = name.when(daily & alike("_weekday") & alike("_week"),
                     F.concat(F.lit("WOM-"), (F.col("_week0") + 1).cast("string"), weekday_name)).when(daily, None)
    name = name.when(F.col("_office") & (gap == MICROS["h"]) & (F.col("_gap1") > gap), "bh")
    for unit in ("h", "min", "s", "ms", "us"):
        name = name.when(alike("_gap") & (gap % MICROS[unit] == 0), counted(F.floor(gap / MICROS[unit]), F.lit(unit)))
    found = facts.select(*by, "n", name.alias("freq"))
    plain = F.regexp_extract("freq", "^[0-9]*([A-Za-z]+)", 1)
    period = (
        F.when(plain == "D", 7).when(plain == "W", 52).when(plain.isin("MS", "M", "BMS", "BM"), 12)
        .when(plain.isin("QS", "Q", "BQS", "BQ"), 4)
    )
    return found.withColumn("period", period)


def difference_weights(d: int, seasonal_d: int, period: int) -> list[int]:
    """Weights of y(t), y(t-1), ... in d plain and ``seasonal_d`` seasonal differences."""
    weights = [1]
    for lag in [1] * d + [period] * seasonal_d:
        longer = weights + [0] * lag
        for i, w in enumerate(weights):
            longer[i + lag] -= w
        weights = longer
    return weights


def difference(
    series: DataFrame, value: str, out: str, d: int = 1, seasonal_d: int = 0, period: int = 1,
    by: Sequence[str] = (), order: str = BUCKET,
) -> DataFrame:
    """Plain and seasonal differences at once; null until enough history is there."""
    spec = series_window(by, order)
    terms = [
        w * (F.lag(value, k).over(spec) if k else F.col(value))
        for k, w in enumerate(difference_weights(d, seasonal_d, period)) if w
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return series.withColumn(out, total)
