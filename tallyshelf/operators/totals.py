"""Sums by key, headline figures and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.schema import UNKNOWN_CUSTOMER, columns_of_kind, nan_to_null, require_columns, require_kind


def valid_key(df: DataFrame, key: str) -> Column:
    present = F.col(key).isNotNull()
    return present & (F.col(key) != "") if isinstance(df.schema[key].dataType, T.StringType) else present


def total_sold(df: DataFrame, product: str = "StockCode", quantity: str = "Quantity") -> DataFrame:
    """Units sold per product, counting positive quantities of rows with a product key."""
    require_columns(df, product)
    require_kind(df, quantity, "numeric")
    sales = df.where((F.col(quantity) > 0) & valid_key(df, product))
    return sales.groupBy(product).agg(F.sum(quantity).alias("TotalSold"))


def sum_by(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Sum per key; rows without a key are left out, missing values count as nothing."""
    require_columns(df, key, value)
    total = F.coalesce(F.sum(value), F.lit(0).cast(df.schema[value].dataType)).alias(out or value)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(total)


def top(df: DataFrame, value: str, n: int, *tie_break: str, smallest: bool = False) -> DataFrame:
    """The n largest (or smallest) rows; each task keeps n rows, nothing is sorted whole."""
    order = F.col(value).asc() if smallest else F.col(value).desc()
    return df.orderBy(order, *tie_break).limit(n)


def top_by_sum(df: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    return top(sum_by(df, key, value), value, n, key)


def monthly_sales(df: DataFrame, ts: str = "InvoiceDate", value: str = "TotalPrice") -> DataFrame:
    """Sum per month that occurs, labelled by its first day."""
    month = F.trunc(F.col(ts).cast("date"), "month").alias("month")
    dated = df.where(F.col(ts).isNotNull())
    return dated.groupBy(month).agg(F.sum(value).alias(value))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.where(valid_key(df, column)).select(column).distinct()


def headline_figures(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """One row: records, columns, revenue, invoices, known customers, products, first and last date.

    Figures whose column is absent are left out. The rows are read once: every distinct count is an entry of its own per row,
    entries of one value are combined on the map side, and the other figures ride along with those of the first count.
    ``approximate`` swaps the exact counts, which shuffle every distinct value, for mergeable sketches.
    """
    have = set(df.columns)
    counted = {"InvoiceNo": "invoices", "CustomerID": "known_customers", "StockCode": "products"}
    counted = {c: name for c, name in counted.items() if c in have}
    if "CustomerID" in have:
        df = df.withColumn("CustomerID", F.when(F.col("CustomerID") != UNKNOWN_CUSTOMER, F.col("CustomerID")))
    dates = {"first_date": F.min, "last_date": F.max} if "InvoiceDate" in have else {}
    day = F.col("InvoiceDate").cast("date")
    features = F.lit(len(df.columns)).alias("features")
    order = ["records", "features", "revenue", *counted.values(), "first_date", "last_date"]
    if approximate or not counted:
        figures = [F.count(F.lit(1)).alias("records"), features, *[f(day).alias(name) for name, f in dates.items()]]
        figures += [F.coalesce(F.sum("TotalPrice"), F.lit(0)).alias("revenue")] if "TotalPrice" in have else []
        found = df.agg(*figures, *[F.approx_count_distinct(F.col(c)).alias(name) for c, name in counted.items()])
        return found.select(*[c for c in order if c in found.columns])

    entry = F.explode(F.array(*[F.lit(i) for i in range(len(counted))])).alias("_entry")
    rows = df.select(*counted, *[c for c in ("TotalPrice", "InvoiceDate") if c in have], entry)
    first, value = F.col("_entry") == 0, None
    for i, c in enumerate(counted):
        value = F.when(F.col("_entry") == i, F.col(c).cast("string")) if value is None else value.when(F.col("_entry") == i, F.col(c).cast("string"))
    sums = [F.sum(F.when(first, F.col("TotalPrice"))).alias("_revenue")] if "TotalPrice" in have else []
    ends = [f(F.when(first, day)).alias(name) for name, f in dates.items()]
    values = rows.groupBy("_entry", value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"), *sums, *ends)
    figures = [F.coalesce(F.sum(F.when(first, F.col("_n"))), F.lit(0)).cast("long").alias("records"), features]
    if "TotalPrice" in have:
        kind = df.agg(F.coalesce(F.sum("TotalPrice"), F.lit(0)).alias("r")).schema["r"].dataType
        figures.append(F.coalesce(F.sum("_revenue"), F.lit(0)).cast(kind).alias("revenue"))
    figures += [F.count_if((F.col("_entry") == i) & F.col("_value").isNotNull()).alias(name) for i, name in enumerate(counted.values())]
    found = values.agg(*figures, *[f(name).alias(name) for name, f in dates.items()])
    return found.select(*[c for c in order if c in found.columns])


SKETCH_BITS = 14  # of the sketches of distinct values: a relative standard error of about 0.8 %


def figure_sketches(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Per month: records, revenue, first and last date, and a sketch of each distinct count, to be stored and merged.

    Months are merged by :func:`merged_figures` for any period without reading the lines again.
    """
    counted = {"InvoiceNo": "invoices", "CustomerID": "known_customers", "StockCode": "products"}
    counted = {c: name for c, name in counted.items() if c in df.columns}
    known = {c: F.col(c).cast("string") for c in counted}
    if "CustomerID" in known:
        known["CustomerID"] = F.when(F.col("CustomerID") != UNKNOWN_CUSTOMER, known["CustomerID"])
    day = F.col(ts).cast("date")
    figures = [F.count(F.lit(1)).alias("records"), F.min(day).alias("first_date"), F.max(day).alias("last_date")]
    if "TotalPrice" in df.columns:
        figures.insert(1, F.coalesce(F.sum("TotalPrice"), F.lit(0)).alias("revenue"))
    sketches = [F.hll_sketch_agg(known[c], SKETCH_BITS).alias(name) for c, name in counted.items()]
    return df.where(F.col(ts).isNotNull()).groupBy(F.trunc(day, "month").alias("month")).agg(*figures, *sketches)


def merged_figures(sketches: DataFrame) -> DataFrame:
    """One row of headline figures for the months in the table; distinct counts are estimates."""
    names = [c for c in ("invoices", "known_customers", "products") if c in sketches.columns]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "revenue") if c in sketches.columns]
    return sketches.agg(
        *sums, *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0).cast("long")).alias(c) for c in names],
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


PAIR_BLOCK = 15  # pairs per aggregate, which keeps generated code small


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present, in long form.

    Each block of pairs is one aggregate over its own columns: partial moments are combined before the shuffle, which
    moves one row per block and task, and no row is copied. A constant column gives null.
    """
    columns = columns or columns_of_kind(df, "numeric")
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    for c in columns:
        require_kind(df, c, "numeric")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def moments(block: list[tuple[int, tuple[str, str]]]) -> DataFrame:
        used = list(dict.fromkeys(c for _, pair in block for c in pair))
        numbers = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in used]))
        aggregates = []
        for i, (a, b) in block:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            # merged moments of a constant are not exactly zero, so constants are told by their range
            varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
            spread = F.stddev_pop(x) * F.stddev_pop(y)
            aggregates.append(F.struct(F.lit(i).alias("pair"), F.covar_pop(x, y).alias("_xy"), spread.alias("_spread"), varies.alias("_varies")))
        return numbers.agg(F.array(*aggregates).alias("_p")).select(F.inline("_p"))

    numbered = list(enumerate(pairs))
    found = moments(numbered[:PAIR_BLOCK])
    for at in range(PAIR_BLOCK, len(numbered), PAIR_BLOCK):
        found = found.unionByName(moments(numbered[at:at + PAIR_BLOCK]))
    corr = F.when(F.col("_varies"), F.try_divide(F.col("_xy"), F.col("_spread")))
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), F.lit(r).alias("row"), F.lit(c).alias("col"))
            for i, pair in enumerate(pairs) for r, c in sorted({pair, pair[::-1]})
        ]
    )
    # both sides have one row per pair
    grid = df.sparkSession.range(1).select(F.inline(cells))
    return grid.join(F.broadcast(found), "pair", "left").select("row", "col", corr.alias("corr"))
