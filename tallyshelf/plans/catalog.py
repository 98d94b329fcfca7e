"""Registered queries: each runs an operator over whole tables, with the equivalent SQL where there is one.

Sums of money go through decimal(18,2) on both sides so that the order of addition cannot show;
means and other doubles are rounded.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.scalar import customer_text, parse_timestamp, strip_text
from tallyshelf.functions.seasonal_arma import Orders
from tallyshelf.operators import charts, cleaning, diagnostics, forest, inventory, model_store, panel, quality, series, splits, totals
from tallyshelf.operators.decomposition import decompose
from tallyshelf.operators.features import add_features
from tallyshelf.operators.metrics import regression_metrics
from tallyshelf.plans.report import headline_texts, processed_lines
from tallyshelf.schema import CORRUPT, ROW_ID
from tallyshelf.session import staging_dir, stored
from tallyshelf.sources import paths
from tallyshelf.sources.files import keep_raw, read_csv, read_csv_with_rejects, read_lines, type_columns
from tallyshelf.sources.payload import parse_objects, parse_variants, read_payload
from tallyshelf.sources.sinks import write_table
from tallyshelf.sources.star import retail_lines, table
from tallyshelf.streaming import lines as line_stream
from tallyshelf.streaming import totals as total_stream

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        CATALOG[name] = Query(run, sql)
        return run

    return add


# ---------------------------------------------------------------- shared pieces

LINES = """lines AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l_partkey AS VARCHAR) AS StockCode, p_name AS Description,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS Quantity,
         o_orderdate AS InvoiceDate, p_retailprice AS UnitPrice,
         CAST(o_custkey AS VARCHAR) AS CustomerID, n_name AS Country
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey)"""
SALES = f"""{LINES}, sales AS (
  SELECT *, CAST(Quantity * UnitPrice AS DECIMAL(18,2)) AS TotalPrice FROM lines
  WHERE InvoiceDate IS NOT NULL AND Description IS NOT NULL AND Quantity > 0 AND UnitPrice > 0)"""
STOCK = """stock AS (
  SELECT StockCode, CAST(COALESCE(SUM(CASE WHEN Quantity > 0 THEN Quantity END), 0) AS BIGINT) AS TotalSold,
         1000 - CAST(COALESCE(SUM(CASE WHEN Quantity > 0 THEN Quantity END), 0) AS BIGINT) AS EstimatedCurrentStock
  FROM lines GROUP BY StockCode)"""


def _sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Lines that pass the row rules, with TotalPrice in exact cents where it can be computed."""
    needed = dict.fromkeys([*columns, "Quantity", "UnitPrice", "InvoiceDate", "Description"])
    df = add_features(cleaning.apply_row_rules(retail_lines(spark, folder, list(needed))))
    return df.withColumn("TotalPrice", F.col("TotalPrice").cast("decimal(18,2)"))


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _r(expression: str, digits: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"(ROUND(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def _cent_mean(value: str) -> str:
    """SQL mean of a column of cents, exactly rounded half up to 6 digits as a decimal average is."""
    cents = f"CAST(SUM(CAST({value} AS DECIMAL(18,2))) * 100 AS HUGEINT)"
    return f"CAST(({cents} * 20000 + COUNT({value})) // (2 * COUNT({value})) AS DOUBLE) / 1000000"


def _cents(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


def _day(df: DataFrame, column: str = "InvoiceDate") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("date"))


# ---------------------------------------------------------------- cleaning and features


@register(
    "retail_clean",
    f"""WITH {LINES} SELECT DISTINCT InvoiceNo, StockCode, Description, Quantity, CAST(InvoiceDate AS DATE) AS InvoiceDate,
    UnitPrice, CustomerID, Country FROM lines
    WHERE InvoiceDate IS NOT NULL AND Description IS NOT NULL AND Quantity > 0 AND UnitPrice > 0""",
)
def _retail_clean(spark, folder):
    return _day(cleaning.clean(retail_lines(spark, folder)))


@register(
    "retail_transform",
    f"""WITH {SALES} SELECT DISTINCT InvoiceNo, StockCode, Description, Quantity, CAST(InvoiceDate AS DATE) AS InvoiceDate,
    UnitPrice, CustomerID, Country, CAST(TotalPrice AS DOUBLE) AS TotalPrice, CAST(year(InvoiceDate) AS INT) AS OrderYear,
    CAST(month(InvoiceDate) AS INT) AS OrderMonth, CAST(day(InvoiceDate) AS INT) AS OrderDay,
    CAST(isodow(InvoiceDate) - 1 AS INT) AS OrderDayOfWeek, CAST(hour(InvoiceDate) AS INT) AS OrderHour,
    CAST(week(InvoiceDate) AS INT) AS OrderWeekOfYear, CAST(quarter(InvoiceDate) AS INT) AS OrderQuarter,
    starts_with(InvoiceNo, 'C') AS IsCancelled FROM sales""",
)
def _retail_transform(spark, folder):
    return _rounded(_day(processed_lines(retail_lines(spark, folder))), 2, "TotalPrice")


DIRTY = """raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS InvoiceNo, CAST(l_partkey AS VARCHAR) AS StockCode,
         CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE p_name END AS Description,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity WHEN l_linestatus = 'O' AND l_linenumber = 3 THEN 0
              WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS Quantity,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS InvoiceDate,
         CASE WHEN p_type = 'SMALL' THEN 0 ELSE p_retailprice END AS UnitPrice,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'UNKNOWN' ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID,
         n_name AS Country
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey),
marked AS (SELECT *, CASE WHEN InvoiceDate IS NULL THEN 'bad_date' WHEN Description IS NULL THEN 'no_description'
  WHEN StockCode IS NULL THEN 'no_stock_code' WHEN Quantity IS NULL OR Quantity <= 0 THEN 'quantity_not_positive'
  WHEN UnitPrice IS NULL OR UnitPrice <= 0 THEN 'price_not_positive' END AS reason FROM raw)"""


def _raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole line table as untidy text: padded headers and cells, mixed and broken dates, gaps."""
    lines = table(spark, folder, "lineitem")
    orders, part = table(spark, folder, "orders"), table(spark, folder, "part")
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    df = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    priority, date = F.col("o_orderpriority"), F.col("o_orderdate")
    date_text = (
        F.when(priority == "5-LOW", "not a date")
        .when(priority == "1-URGENT", F.date_format(date, "M/d/yyyy H:mm"))
        .when(priority == "2-HIGH", F.date_format(date, "yyyy-MM-dd"))
        .otherwise(F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
    )
    quantity = (
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
        .when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 3), 0.0)
        .when(F.col("l_linenumber") == 5, None)
        .otherwise(F.col("l_quantity"))
    )
    return df.select(
        F.col("l_orderkey").cast("string").alias(" InvoiceNo "),
        F.concat(F.lit("\t"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("StockCode"),
        F.when(F.col("p_brand") != "Brand#7", F.concat(F.lit("  "), "p_name", F.lit("\t"))).alias("Description "),
        quantity.cast("string").alias("Quantity"),
        date_text.alias("InvoiceDate"),
        F.when(F.col("p_type") == "SMALL", "0.0").otherwise(F.col("p_retailprice").cast("string")).alias("UnitPrice"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .alias(" CustomerID"),
        F.col("n_name").alias("Country"),
    )


DIRTY_CLEAN = f"""WITH {DIRTY} SELECT DISTINCT InvoiceNo, StockCode, Description, Quantity,
    CAST(InvoiceDate AS DATE) AS InvoiceDate, CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country
    FROM marked WHERE reason IS NULL"""


@register("clean_untidy_text", DIRTY_CLEAN)
def _clean_untidy(spark, folder):
    return _day(cleaning.clean(type_columns(_raw_texts(spark, folder))))


@register(
    "clean_rejects",
    f"""WITH {DIRTY} SELECT InvoiceNo, StockCode, Quantity, reason FROM marked WHERE reason IS NOT NULL""",
)
def _clean_rejects(spark, folder):
    dropped = cleaning.rejected_rows(_raw_texts(spark, folder))
    return dropped.select("InvoiceNo", "StockCode", "Quantity", F.col(cleaning.REASON).alias("reason"))


@register(
    "clean_report",
    f"""WITH {DIRTY} SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (WHERE reason IS NULL) AS rows_kept,
    {", ".join(f"COUNT(*) FILTER (WHERE reason = '{r}') AS {r}" for r in cleaning.REASONS)},
    COUNT(*) FILTER (WHERE CustomerID = 'UNKNOWN') AS unknown_customers FROM marked""",
)
def _clean_report(spark, folder):
    return cleaning.cleaning_report(_raw_texts(spark, folder))


@register("csv_round_trip", DIRTY_CLEAN)
def _csv_round_trip(spark, folder):
    path = f"{staging_dir(spark)}/lines.csv"
    write_table(_raw_texts(spark, folder), path)
    return _day(cleaning.clean(read_lines(spark, path)))


@register(
    "parquet_round_trip",
    f"""WITH {SALES} SELECT CAST(year(InvoiceDate) AS INT) AS OrderYear, CAST(month(InvoiceDate) AS INT) AS OrderMonth,
    COUNT(*) AS n, CAST(SUM(TotalPrice) AS DOUBLE) AS revenue FROM (SELECT DISTINCT * FROM sales) GROUP BY 1, 2""",
)
def _parquet_round_trip(spark, folder):
    path = f"{staging_dir(spark)}/lines.parquet"
    write_table(processed_lines(retail_lines(spark, folder)), path)
    stored = spark.read.parquet(path)
    revenue = F.sum(F.col("TotalPrice").cast("decimal(18,2)")).cast("double")
    return stored.groupBy("OrderYear", "OrderMonth").agg(F.count("*").alias("n"), revenue.alias("revenue"))


@register(
    "date_features",
    """SELECT event_id, CAST(year(ts) AS INT) AS OrderYear, CAST(month(ts) AS INT) AS OrderMonth,
    CAST(day(ts) AS INT) AS OrderDay, CAST(isodow(ts) - 1 AS INT) AS OrderDayOfWeek, CAST(hour(ts) AS INT) AS OrderHour,
    CAST(week(ts) AS INT) AS OrderWeekOfYear, CAST(quarter(ts) AS INT) AS OrderQuarter FROM events""",
)
def _date_features(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("ts").alias("InvoiceDate"))
    return add_features(events).drop("InvoiceDate")


@register(
    "total_price_cancelled",
    f"""WITH {LINES} SELECT InvoiceNo, StockCode, Quantity, {_r("Quantity * UnitPrice", 2)} AS TotalPrice,
    starts_with(InvoiceNo, 'C') AS IsCancelled FROM lines""",
)
def _total_price_cancelled(spark, folder):
    lines = retail_lines(spark, folder, ["InvoiceNo", "StockCode", "Quantity", "UnitPrice"])
    return _rounded(add_features(lines), 2, "TotalPrice").drop("UnitPrice")


@register(
    "customer_keys",
    """SELECT c_custkey, CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS from_number,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'UNKNOWN' ELSE split_part(c_acctbal::VARCHAR, '.', 1) END AS from_text FROM customer""",
)
def _customer_keys(spark, folder):
    customer = table(spark, folder, "customer")
    types = {f.name: f.dataType for f in customer.schema.fields}
    text = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal").cast("string"))
    return customer.select(
        "c_custkey",
        customer_text(F.col("c_acctbal"), types["c_acctbal"]).alias("from_number"),
        customer_text(text, types["c_name"]).alias("from_text"),
    )


@register("strip_texts", "SELECT p_partkey, p_name AS Description FROM part")
def _strip_texts(spark, folder):
    padded = F.concat(F.lit("\t  "), "p_name", F.lit("  \n"))
    return table(spark, folder, "part").select("p_partkey", strip_text(padded).alias("Description"))


def _capped_sql(relation: str, key: str, value: str, multiplier: float) -> str:
    return f"""WITH q AS (SELECT quantile_cont({value}, 0.25) AS a, quantile_cont({value}, 0.75) AS b FROM {relation}),
    f AS (SELECT a - {multiplier} * (b - a) AS lo, b + {multiplier} * (b - a) AS hi FROM q)
    SELECT {key}, {_r(f"CASE WHEN {value} < lo THEN lo WHEN {value} > hi THEN hi ELSE {value} END")} AS {value}
    FROM {relation}, f"""


@register("winsorize_value", _capped_sql("events", "event_id", "value", 1.5))
def _winsorize_value(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return _rounded(cleaning.winsorize(events, ["value"]), 6, "value")


@register("winsorize_orders", _capped_sql("orders", "o_orderkey", "o_totalprice", 0.4))
def _winsorize_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return _rounded(cleaning.winsorize(orders, ["o_totalprice"], 0.4), 6, "o_totalprice")


@register(
    "clean_with_caps",
    f"""WITH {LINES}, kept AS (SELECT * FROM lines WHERE InvoiceDate IS NOT NULL AND Description IS NOT NULL
      AND Quantity > 0 AND UnitPrice > 0),
    q AS (SELECT quantile_cont(Quantity, 0.25) AS qa, quantile_cont(Quantity, 0.75) AS qb,
      quantile_cont(UnitPrice, 0.25) AS pa, quantile_cont(UnitPrice, 0.75) AS pb FROM kept)
    SELECT DISTINCT InvoiceNo, StockCode, Description, CAST(InvoiceDate AS DATE) AS InvoiceDate, CustomerID, Country,
      {_r("LEAST(GREATEST(Quantity, qa - 1.5 * (qb - qa)), qb + 1.5 * (qb - qa))")} AS Quantity,
      {_r("LEAST(GREATEST(UnitPrice, pa - 1.5 * (pb - pa)), pb + 1.5 * (pb - pa))")} AS UnitPrice FROM kept, q""",
)
def _clean_with_caps(spark, folder):
    rules = cleaning.CleaningRules(cap_quantity=True, cap_unit_price=True)
    return _rounded(_day(cleaning.clean(retail_lines(spark, folder), rules)), 6, "Quantity", "UnitPrice")


@register(
    "outlier_counts",
    f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
    f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
    SELECT 'value' AS "column", {_r("MAX(lo)")} AS lower, {_r("MAX(hi)")} AS upper,
    COUNT(*) FILTER (WHERE value < lo) AS n_below, COUNT(*) FILTER (WHERE value > hi) AS n_above FROM events, f""",
)
def _outlier_counts(spark, folder):
    return _rounded(cleaning.outlier_counts(table(spark, folder, "events"), ["value"]), 6, "lower", "upper")


@register(
    "p99_filter",
    "SELECT event_id, value FROM events WHERE value <= (SELECT quantile_cont(value, 0.99) FROM events)",
)
def _p99_filter(spark, folder):
    return cleaning.at_most_quantile(table(spark, folder, "events").select("event_id", "value"), "value")


@register("drop_copies", "SELECT DISTINCT l_suppkey, l_quantity, l_returnflag FROM lineitem")
def _drop_copies(spark, folder):
    return cleaning.drop_copies(table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


@register(
    "drop_copies_first",
    "SELECT user_id, event_type, MIN(event_id) AS event_id FROM events GROUP BY user_id, event_type",
)
def _drop_copies_first(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_type", F.col("event_id").alias(ROW_ID))
    return cleaning.drop_copies(events).withColumnRenamed(ROW_ID, "event_id")


@register(
    "json_records",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'""",
)
def _json_records(spark, folder):
    return parse_objects(_payloads(spark, folder), "payload", "k bigint")[0].select("event_id", "k")


@register("json_rejects", "SELECT event_id, replace(props, '}', '') AS payload FROM events WHERE event_type = 'error'")
def _json_rejects(spark, folder):
    return parse_objects(_payloads(spark, folder), "payload", "k bigint")[1]


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    broken = F.replace(F.col("props"), F.lit("}"), F.lit(""))
    return table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "error", broken).otherwise(F.col("props")).alias("payload")
    )


# ---------------------------------------------------------------- profiles


def _profile_sql(relation: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_missing FROM {relation}"""
        for c, kind in columns.items()
    )


@register(
    "column_profile",
    _profile_sql(
        "orders",
        {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "string", "o_totalprice": "numeric",
         "o_orderdate": "datetime", "o_orderpriority": "string"},
    ),
)
def _column_profile(spark, folder):
    return quality.column_profile(table(spark, folder, "orders"))


@register("table_shape", "SELECT COUNT(*) AS n_rows, CAST(11 AS INT) AS n_columns FROM lineitem")
def _table_shape(spark, folder):
    return quality.shape(table(spark, folder, "lineitem"))


def _describe_sql(relation: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", {_r(f"AVG({c})", 4)} AS mean, {_r(f"STDDEV_SAMP({c})", 4)} AS std,
        MIN({c}) AS "min", {_r(f"quantile_cont({c}, 0.25)")} AS p25, {_r(f"quantile_cont({c}, 0.5)")} AS p50,
        {_r(f"quantile_cont({c}, 0.75)")} AS p75, MAX({c}) AS "max" FROM {relation}"""
        for c in columns
    )


@register("describe_lines", _describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def _describe_lines(spark, folder):
    stats = quality.describe(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return _rounded(_rounded(stats, 4, "mean", "std"), 6, "p25", "p50", "p75")


@register("preview_lines", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _preview_lines(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return quality.preview(orders, 5, F.desc("o_totalprice"), "o_orderkey")


# ---------------------------------------------------------------- stock


def _stock(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.stock_estimate(retail_lines(spark, folder, ["StockCode", "Quantity"]))


@register(
    "total_sold",
    f"""WITH {LINES} SELECT StockCode, CAST(SUM(Quantity) AS BIGINT) AS TotalSold FROM lines WHERE Quantity > 0 GROUP BY StockCode""",
)
def _total_sold(spark, folder):
    sold = totals.total_sold(retail_lines(spark, folder, ["StockCode", "Quantity"]))
    return sold.withColumn("TotalSold", F.col("TotalSold").cast("bigint"))


@register("stock_estimate", f"WITH {LINES}, {STOCK} SELECT * FROM stock")
def _stock_estimate(spark, folder):
    return inventory.all_stock(_stock(spark, folder))


@register("stock_lowest", f"WITH {LINES}, {STOCK} SELECT * FROM stock ORDER BY EstimatedCurrentStock, StockCode LIMIT 10")
def _stock_lowest(spark, folder):
    return inventory.lowest_stock(_stock(spark, folder))


@register(
    "stock_highest", f"WITH {LINES}, {STOCK} SELECT * FROM stock ORDER BY EstimatedCurrentStock DESC, StockCode LIMIT 10"
)
def _stock_highest(spark, folder):
    return inventory.highest_stock(_stock(spark, folder))


@register(
    "stock_lowest_chart",
    f"WITH {LINES}, {STOCK} SELECT * FROM (SELECT * FROM stock ORDER BY EstimatedCurrentStock, StockCode LIMIT 20)",
)
def _stock_lowest_chart(spark, folder):
    return inventory.lowest_stock_chart(_stock(spark, folder), 20)


@register(
    "stock_search", f"WITH {LINES}, {STOCK} SELECT * FROM stock WHERE regexp_matches(StockCode, '^1.*[05]$', 'i')"
)
def _stock_search(spark, folder):
    return inventory.find_stock(_stock(spark, folder), "^1.*[05]$")


@register("product_search", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'RED|bolt$', 'i')")
def _product_search(spark, folder):
    return cleaning.search(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "RED|bolt$")


@register("product_search_literal", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'l w')")
def _product_search_literal(spark, folder):
    return cleaning.search(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "L W", literal=True)


@register(
    "stock_by_opening",
    f"""WITH {LINES}, {STOCK} SELECT StockCode, TotalSold, CAST(p_size * 100 AS BIGINT) - TotalSold AS EstimatedCurrentStock
    FROM stock JOIN part ON StockCode = CAST(p_partkey AS VARCHAR)""",
)
def _stock_by_opening(spark, folder):
    opening = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("StockCode"), (F.col("p_size") * 100).alias("OpeningStock")
    )
    return inventory.stock_estimate(retail_lines(spark, folder, ["StockCode", "Quantity"]), opening=opening)


@register("distinct_products", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS StockCode FROM lineitem")
def _distinct_products(spark, folder):
    return totals.distinct_values(retail_lines(spark, folder, ["StockCode"]), "StockCode")


# ---------------------------------------------------------------- totals and report


@register(
    "monthly_sales",
    f"""WITH {SALES} SELECT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month, CAST(SUM(TotalPrice) AS DOUBLE) AS TotalPrice
    FROM sales GROUP BY 1""",
)
def _monthly_sales(spark, folder):
    return _as_double(totals.monthly_sales(_sales(spark, folder)), "TotalPrice")


@register(
    "country_top10",
    f"""WITH {SALES} SELECT Country, CAST(SUM(TotalPrice) AS DOUBLE) AS TotalPrice FROM sales WHERE Country IS NOT NULL
    GROUP BY Country ORDER BY SUM(TotalPrice) DESC, Country LIMIT 10""",
)
def _country_top10(spark, folder):
    return _as_double(totals.top_by_sum(_sales(spark, folder, "Country"), "Country", "TotalPrice", 10), "TotalPrice")


@register(
    "product_top10",
    f"""WITH {SALES} SELECT Description, SUM(Quantity) AS Quantity FROM sales GROUP BY Description
    ORDER BY SUM(Quantity) DESC, Description LIMIT 10""",
)
def _product_top10(spark, folder):
    return totals.top_by_sum(_sales(spark, folder), "Description", "Quantity", 10)


@register(
    "best_country",
    f"""WITH {SALES} SELECT Country, CAST(SUM(TotalPrice) AS DOUBLE) AS TotalPrice FROM sales WHERE Country IS NOT NULL
    GROUP BY Country ORDER BY SUM(TotalPrice) DESC, Country LIMIT 1""",
)
def _best_country(spark, folder):
    return _as_double(totals.top_by_sum(_sales(spark, folder, "Country"), "Country", "TotalPrice", 1), "TotalPrice")


FIGURES = """COUNT(*) AS records, CAST(17 AS INT) AS features, {revenue} AS revenue,
    COUNT(DISTINCT InvoiceNo) AS invoices,
    COUNT(DISTINCT CASE WHEN CustomerID <> 'UNKNOWN' THEN CustomerID END) AS known_customers,
    COUNT(DISTINCT StockCode) AS products, {first} AS first_date, {last} AS last_date"""


def _processed_cents(spark: SparkSession, folder: str) -> DataFrame:
    df = processed_lines(retail_lines(spark, folder))
    return df.withColumn("TotalPrice", F.col("TotalPrice").cast("decimal(18,2)"))


@register(
    "kpis",
    f"""WITH {SALES} SELECT {FIGURES.format(revenue="CAST(SUM(TotalPrice) AS DOUBLE)",
    first="CAST(MIN(InvoiceDate) AS DATE)", last="CAST(MAX(InvoiceDate) AS DATE)")} FROM (SELECT DISTINCT * FROM sales)""",
)
def _kpis(spark, folder):
    return _as_double(totals.headline_figures(_processed_cents(spark, folder)), "revenue")


@register(
    "report_texts",
    f"""WITH {SALES}, d AS (SELECT DISTINCT * FROM sales),
    b AS (SELECT Country AS best_country, format('{{:,.2f}}', CAST(SUM(TotalPrice) AS DOUBLE)) AS best_country_sales
      FROM d GROUP BY Country ORDER BY SUM(TotalPrice) DESC, Country LIMIT 1)
    SELECT * FROM (SELECT {FIGURES.format(revenue="format('{:,.2f}', CAST(SUM(TotalPrice) AS DOUBLE))",
    first="strftime(MIN(InvoiceDate), '%Y-%m-%d')", last="strftime(MAX(InvoiceDate), '%Y-%m-%d')")} FROM d), b""",
)
def _report_texts(spark, folder):
    return headline_texts(_processed_cents(spark, folder))


@register(
    "aggregates_by_name",
    f"""SELECT event_type, {_r("SUM(value)", 4)} AS v_sum, {_r("AVG(value)")} AS v_mean,
    {_r("quantile_cont(value, 0.5)")} AS v_median, FIRST(value ORDER BY ts, event_id) AS v_first,
    LAST(value ORDER BY ts, event_id) AS v_last, COUNT(value) AS v_count FROM events GROUP BY event_type""",
)
def _aggregates_by_name(spark, folder):
    outputs = {f"v_{how}": ("value", how) for how in ("sum", "mean", "median", "first", "last", "count")}
    found = series.aggregate_by_key(table(spark, folder, "events"), ["event_type"], outputs, order=("ts", "event_id"))
    return _rounded(_rounded(found, 4, "v_sum"), 6, "v_mean", "v_median")


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"row\", '{b}' AS col, {_r(f'corr({a}, {b})')} AS corr FROM lineitem"
        for a in CORRELATED for b in CORRELATED
    ),
)
def _corr_matrix(spark, folder):
    return _rounded(totals.correlation_matrix(table(spark, folder, "lineitem"), CORRELATED), 6, "corr")


# ---------------------------------------------------------------- chart tables


@register(
    "pie_other",
    f"""WITH {SALES}, s AS (SELECT Country, SUM(TotalPrice) AS v FROM sales WHERE Country IS NOT NULL GROUP BY Country),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, Country) AS rn, COUNT(*) OVER () AS n FROM s),
    g AS (SELECT (rn >= 10 AND n > 10) AS is_other, CASE WHEN rn >= 10 AND n > 10 THEN 'Other' ELSE Country END AS Country,
      SUM(v) AS v FROM r GROUP BY 1, 2)
    SELECT is_other, Country, CAST(v AS DOUBLE) AS TotalPrice, {_r("CAST(v AS DOUBLE) / CAST(SUM(v) OVER () AS DOUBLE)")} AS share
    FROM g""",
)
def _pie_other(spark, folder):
    pie = charts.pie_table(_sales(spark, folder, "Country"), "Country", "TotalPrice")
    return _rounded(_as_double(pie, "TotalPrice"), 6, "share")


def _bar_sql(direction: str) -> str:
    return f"""SELECT p_brand, SUM(l_quantity) AS l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY p_brand ORDER BY SUM(l_quantity) {direction}, p_brand LIMIT 5"""


def _brands(spark: SparkSession, folder: str) -> DataFrame:
    lines, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_brand", "l_quantity")


@register("bar_top", _bar_sql("DESC"))
def _bar_top(spark, folder):
    return charts.bar_table(_brands(spark, folder), "p_brand", "l_quantity", top_n=5)


@register("bar_bottom", _bar_sql("ASC"))
def _bar_bottom(spark, folder):
    return charts.bar_table(_brands(spark, folder), "p_brand", "l_quantity", order="asc", top_n=5)


@register(
    "histogram",
    f"""WITH e AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
    b AS (SELECT LEAST(CAST(floor((value - lo) / (hi - lo) * 30) AS INT) + 1, 30) AS bin, COUNT(*) AS n FROM events, e GROUP BY 1)
    SELECT CAST(g AS INT) AS bin, {_r("lo + (g - 1) * ((hi - lo) / 30)")} AS lower, {_r("lo + g * ((hi - lo) / 30)")} AS upper,
    COALESCE(n, 0) AS n FROM e, range(1, 31) t(g) LEFT JOIN b ON b.bin = g""",
)
def _histogram(spark, folder):
    return _rounded(charts.histogram(table(spark, folder, "events"), "value"), 6, "lower", "upper")


def _density_sql(relation: str, digits: int) -> str:
    """The kernel summed over all rows."""
    return f"""WITH v AS ({relation}), f AS (SELECT MIN(v) AS lo, MAX(v) AS hi, STDDEV_SAMP(v) * pow(COUNT(v), -0.2) AS h FROM v),
    g AS (SELECT CAST(i AS INT) AS point, lo + i * ((hi - lo) / 199) AS x, lo, hi, h FROM f, range(0, 200) t(i))
    SELECT point, {_r("x")} AS x, {_r("SUM(exp(-0.5 * pow((x - v) / h, 2))) * ((MAX(hi) - MAX(lo)) / 30 / (MAX(h) * sqrt(2 * pi())))", digits)} AS density
    FROM g, v GROUP BY point, x"""


@register("density_curve", _density_sql("SELECT value AS v FROM events", 4))
def _density_curve(spark, folder):
    return _rounded(_rounded(charts.density_curve(table(spark, folder, "events"), "value"), 6, "x"), 4, "density")


@register("density_heavy_tail", _density_sql("SELECT value * value * value AS v FROM events", 3))
def _density_heavy_tail(spark, folder):
    cubed = table(spark, folder, "events").select((F.col("value") * F.col("value") * F.col("value")).alias("v"))
    return _rounded(_rounded(charts.density_curve(cubed, "v"), 6, "x"), 3, "density")


@register(
    "line_mean",
    f"""WITH a AS (SELECT l_linenumber, l_returnflag, AVG(l_extendedprice) AS m, STDDEV_SAMP(l_extendedprice) AS s, COUNT(*) AS n
      FROM lineitem GROUP BY 1, 2)
    SELECT l_linenumber, l_returnflag, {_r("m", 4)} AS mean, n, {_r("m - COALESCE(1.959963984540054 * s / sqrt(n), 0)", 4)} AS low,
    {_r("m + COALESCE(1.959963984540054 * s / sqrt(n), 0)", 4)} AS high FROM a""",
)
def _line_mean(spark, folder):
    lines = charts.line_table(table(spark, folder, "lineitem"), "l_linenumber", "l_extendedprice", "l_returnflag")
    return _rounded(lines, 4, "mean", "low", "high")


@register(
    "sales_trend",
    f"""WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, {_cent_mean("o_totalprice")} AS m,
      STDDEV_SAMP(o_totalprice) AS s, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT day, m AS mean, n, {_r("m - COALESCE(1.959963984540054 * s / sqrt(n), 0)", 4)} AS low,
    {_r("m + COALESCE(1.959963984540054 * s / sqrt(n), 0)", 4)} AS high FROM a""",
)
def _sales_trend(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    bands = charts.trend_table(_cents(orders, "o_totalprice"), "day", "o_totalprice")
    return _rounded(_as_double(bands, "mean"), 4, "low", "high")


# Values are converted at this rate: an odd factor keeps exact halves out of the rounding.
RATE = 0.7310585786300049
BOOTSTRAP = 200  # replicates of the registered queries


def _bootstrap_sql(rows: str, *keys: str) -> str:
    """The same draws: rows(keys, y, id) times replicates, weighed by the steps of the Poisson distribution."""
    first = f"((id % {charts.PRIME}) * 48271 + r * 69621) % {charts.PRIME}"
    weight = " ".join(f"WHEN d < {step} THEN {times}" for times, step in enumerate(charts.POISSON_STEPS))
    k = ", ".join(keys)
    return f"""WITH rows AS ({rows}), one AS (SELECT *, {first} AS d FROM rows, range({BOOTSTRAP}) t(r)),
    two AS (SELECT * REPLACE ((d * (d + 16807)) % {charts.PRIME} AS d) FROM one),
    three AS (SELECT * REPLACE ((d * (d + 40692)) % {charts.PRIME} AS d) FROM two),
    weighed AS (SELECT *, CASE {weight} ELSE {len(charts.POISSON_STEPS)} END AS w FROM three),
    means AS (SELECT {k}, SUM(w * y) / SUM(w) AS m FROM weighed GROUP BY {k}, r HAVING SUM(w) > 0),
    bands AS (SELECT {k}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY {k}),
    plain AS (SELECT {k}, AVG(y) AS mean, COUNT(*) AS n FROM rows GROUP BY {k})
    SELECT {k}, {_r("mean", 4)} AS mean, n, {_r("low", 4)} AS low, {_r("high", 4)} AS high FROM plain JOIN bands USING ({k})"""


@register(
    "line_bootstrap",
    _bootstrap_sql(f"SELECT l_linenumber, l_returnflag, CAST(l_extendedprice AS DOUBLE) * CAST({RATE} AS DOUBLE) AS y, l_orderkey * 8 + l_linenumber AS id FROM lineitem",
                   "l_linenumber", "l_returnflag"),
)
def _line_bootstrap(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("id", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long"))
    lines = lines.withColumn("l_extendedprice", F.col("l_extendedprice").cast("double") * RATE)
    bands = charts.line_bootstrap(lines, "l_linenumber", "l_extendedprice", "l_returnflag", key=["id"], replicates=BOOTSTRAP)
    return _rounded(bands, 4, "mean", "low", "high")


@register(
    "trend_bootstrap",
    _bootstrap_sql(f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_totalprice AS DOUBLE) * CAST({RATE} AS DOUBLE) AS y, o_orderkey AS id FROM orders", "month"),
)
def _trend_bootstrap(spark, folder):
    orders = table(spark, folder, "orders").withColumn("month", F.trunc(F.col("o_orderdate").cast("date"), "month"))
    orders = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("double") * RATE)
    bands = charts.trend_table(orders, "month", "o_totalprice", key=["o_orderkey"], replicates=BOOTSTRAP)
    return _rounded(bands, 4, "mean", "low", "high")


@register("scatter_points", "SELECT p_size, p_retailprice, p_type FROM part")
def _scatter_points(spark, folder):
    return charts.scatter_table(table(spark, folder, "part"), "p_size", "p_retailprice", "p_type")


# ---------------------------------------------------------------- time series

# DuckDB expressions: bucket start from a timestamp, label from a start, step between starts
SQL_BUCKETS = {
    "D": ("CAST({t} AS DATE)", "{s}", "1 day"),
    "W": ("CAST(date_trunc('week', {t}) AS DATE)", "{s} + INTERVAL 6 DAY", "7 day"),
    "MS": ("CAST(date_trunc('month', {t}) AS DATE)", "{s}", "1 month"),
    "M": ("CAST(date_trunc('month', {t}) AS DATE)", "last_day({s})", "1 month"),
    "QS": ("CAST(date_trunc('quarter', {t}) AS DATE)", "{s}", "3 month"),
    "Q": ("CAST(date_trunc('quarter', {t}) AS DATE)", "last_day({s} + INTERVAL 2 MONTH)", "3 month"),
    "AS": ("CAST(date_trunc('year', {t}) AS DATE)", "{s}", "12 month"),
    "A": ("CAST(date_trunc('year', {t}) AS DATE)", "make_date(year({s}), 12, 31)", "12 month"),
}


def _resample_sql(freq: str) -> str:
    start, label, step = SQL_BUCKETS[freq]
    return f"""WITH a AS (SELECT {start.format(t="o_orderdate")} AS s, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
      {_cent_mean("o_totalprice")} AS mean, quantile_cont(o_totalprice, 0.5) AS median, FIRST(o_totalprice ORDER BY o_orderdate, o_orderkey) AS v_first,
      LAST(o_totalprice ORDER BY o_orderdate, o_orderkey) AS v_last, COUNT(*) AS n FROM orders GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series(MIN(s), MAX(s), INTERVAL {step})) AS DATE) AS s FROM a)
    SELECT CAST({label.format(s="g.s")} AS DATE) AS bucket, COALESCE(total, 0) AS total, mean, {_r("median")} AS median, v_first, v_last, COALESCE(n, 0) AS n FROM g LEFT JOIN a ON g.s = a.s"""


def _resample(freq: str) -> Run:
    def run(spark, folder):
        orders = table(spark, folder, "orders").withColumn("cents", F.col("o_totalprice").cast("decimal(18,2)"))
        outputs = {
            "total": ("cents", "sum"), "mean": ("cents", "mean"), "median": ("o_totalprice", "median"),
            "v_first": ("o_totalprice", "first"), "v_last": ("o_totalprice", "last"), "n": ("o_totalprice", "count"),
        }
        found = series.resample(orders, "o_orderdate", outputs, freq, tie_break=("o_orderkey",))
        return _rounded(_as_double(found, "total", "mean"), 6, "median")

    return run


for _freq in SQL_BUCKETS:
    register(f"resample_{_freq.lower()}", _resample_sql(_freq))(_resample(_freq))


# multiples count from the first unit: SQL for the unit start, its index after the first one, the way back, the step
SQL_MULTIPLES = {
    "2D": ("CAST(o_orderdate AS DATE)", "first + CAST(2 * floor(datediff('day', first, u) / 2.0) AS INT)", "s", "2 day"),
    "3MS": ("CAST(date_trunc('month', o_orderdate) AS DATE)",
            "CAST(first + to_months(CAST(3 * floor(datediff('month', first, u) / 3.0) AS INT)) AS DATE)", "s", "3 month"),
    "2W": ("CAST(date_trunc('week', o_orderdate) AS DATE)", "first + CAST(14 * ceil(datediff('day', first, u) / 14.0) AS INT)",
           "s + 6", "14 day"),
    "2M": ("CAST(date_trunc('month', o_orderdate) AS DATE)",
           "CAST(first + to_months(CAST(2 * ceil(datediff('month', first, u) / 2.0) AS INT)) AS DATE)", "last_day(s)", "2 month"),
}


def _multiple_sql(freq: str) -> str:
    unit, start, label, step = SQL_MULTIPLES[freq]
    return f"""WITH r AS (SELECT {unit} AS u, o_totalprice FROM orders), f AS (SELECT MIN(u) AS first FROM r),
    a AS (SELECT {start} AS s, COUNT(*) AS n, quantile_cont(o_totalprice, 0.5) AS median FROM r, f GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series(MIN(s), MAX(s), INTERVAL {step})) AS DATE) AS s FROM a)
    SELECT CAST({label} AS DATE) AS bucket, COALESCE(n, 0) AS n, {_r("median")} AS median FROM (SELECT g.s, n, median FROM g LEFT JOIN a ON g.s = a.s)"""


def _counted(freq: str) -> Run:
    def run(spark, folder):
        outputs = {"n": ("o_totalprice", "count"), "median": ("o_totalprice", "median")}
        return _rounded(series.resample(table(spark, folder, "orders"), "o_orderdate", outputs, freq), 6, "median")

    return run


for _freq in SQL_MULTIPLES:
    register(f"resample_{_freq.lower()}", _multiple_sql(_freq))(_counted(_freq))

register(
    "resample_b",
    f"""WITH a AS (SELECT CAST(o_orderdate AS DATE) - greatest(isodow(o_orderdate) - 5, 0)::INT AS s, COUNT(*) AS n,
      quantile_cont(o_totalprice, 0.5) AS median FROM orders GROUP BY 1),
    g AS (SELECT s FROM (SELECT CAST(unnest(generate_series(MIN(s), MAX(s), INTERVAL 1 DAY)) AS DATE) AS s FROM a) WHERE isodow(s) < 6)
    SELECT g.s AS bucket, COALESCE(n, 0) AS n, {_r("median")} AS median FROM g LEFT JOIN a ON g.s = a.s""",
)(_counted("B"))


def _clock_sql(seconds: int) -> str:
    return f"""WITH f AS (SELECT date_trunc('day', MIN(ts)) AS first FROM events),
    a AS (SELECT CAST(floor(date_diff('second', first, date_trunc('second', ts)) / {seconds}.0) AS BIGINT) AS k, COUNT(*) AS n FROM events, f GROUP BY 1),
    g AS (SELECT unnest(range(MIN(k), MAX(k) + 1)) AS k FROM a)
    SELECT strftime(first + to_seconds(g.k * {seconds}), '%Y-%m-%d %H:%M:%S') AS bucket, COALESCE(n, 0) AS n FROM f, g LEFT JOIN a ON g.k = a.k"""


def _clock(freq: str) -> Run:
    def run(spark, folder):
        found = series.resample(table(spark, folder, "events"), "ts", {"n": ("value", "count")}, freq)
        return found.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))

    return run


register("resample_15min", _clock_sql(900))(_clock("15min"))
register("resample_7min", _clock_sql(420))(_clock("7min"))
register("resample_30s", _clock_sql(30))(_clock("30s"))


MONTHLY = f"""m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, COUNT(*) AS n_orders,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * CAST({RATE} AS DOUBLE) AS value FROM orders GROUP BY 1)"""
PANEL = f"""a AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1, 2),
  g AS (SELECT o_orderpriority, CAST(unnest(generate_series(MIN(bucket), MAX(bucket), INTERVAL 1 MONTH)) AS DATE) AS bucket
    FROM a GROUP BY 1),
  m AS (SELECT g.o_orderpriority, g.bucket, COALESCE(total, 0) * CAST({RATE} AS DOUBLE) AS value
    FROM g LEFT JOIN a ON g.o_orderpriority = a.o_orderpriority AND g.bucket = a.bucket)"""


def _monthly(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """Order value per month, in one series or one per key; every month occurs in the data."""
    orders = _cents(table(spark, folder, "orders"), "o_totalprice")
    months = series.resample(orders, "o_orderdate", {"value": ("o_totalprice", "sum")}, "MS", by)
    return months.withColumn("value", F.col("value").cast("double") * RATE)


@register(
    "resample_panel_w",
    """WITH a AS (SELECT o_orderpriority, CAST(date_trunc('week', o_orderdate) AS DATE) AS s, COUNT(*) AS n FROM orders GROUP BY 1, 2),
    g AS (SELECT o_orderpriority, CAST(unnest(generate_series(MIN(s), MAX(s), INTERVAL 7 DAY)) AS DATE) AS s FROM a GROUP BY 1)
    SELECT g.o_orderpriority, CAST(g.s + INTERVAL 6 DAY AS DATE) AS bucket, COALESCE(n, 0) AS n
    FROM g LEFT JOIN a ON g.s = a.s AND g.o_orderpriority = a.o_orderpriority""",
)
def _resample_panel_w(spark, folder):
    outputs = {"n": ("o_totalprice", "count")}
    return series.resample(table(spark, folder, "orders"), "o_orderdate", outputs, "W", ["o_orderpriority"])


@register(
    "ffill_hourly",
    f"""WITH a AS (SELECT event_type, date_trunc('hour', ts) AS s, {_cent_mean("value")} AS v FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(MIN(s), MAX(s), INTERVAL 1 HOUR)) AS s FROM a GROUP BY 1)
    SELECT g.event_type, strftime(g.s, '%Y-%m-%d %H:%M') AS bucket,
    {_r("LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.s)")} AS value
    FROM g LEFT JOIN a ON g.s = a.s AND g.event_type = a.event_type""",
)
def _ffill_hourly(spark, folder):
    events = _cents(table(spark, folder, "events"), "value")
    hours = series.resample(events, "ts", {"value": ("value", "mean")}, "1h", ["event_type"])
    filled = series.forward_fill(hours, ["value"], ["event_type"])
    return _rounded(filled.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm")), 6, "value")


@register(
    "daily_trend",
    f"""WITH {LINES} SELECT CAST(InvoiceDate AS DATE) AS bucket, SUM(Quantity) AS Quantity FROM lines WHERE InvoiceDate IS NOT NULL
    GROUP BY 1 HAVING SUM(Quantity) <> 0""",
)
def _daily_trend(spark, folder):
    return series.trend(retail_lines(spark, folder, ["InvoiceDate", "Quantity"]), "InvoiceDate", "Quantity")


@register(
    "trend_of_text_dates",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, COUNT(*) AS o_totalprice FROM orders
    WHERE o_orderpriority <> '5-LOW' GROUP BY 1""",
)
def _trend_of_text_dates(spark, folder):
    date = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderpriority") == "5-LOW", "no date")
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(date, "M/d/yyyy"))
        .otherwise(F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
    )
    orders = table(spark, folder, "orders").select(text.alias("day"), "o_totalprice")
    return series.trend(orders, "day", "o_totalprice", "count", "MS").where("o_totalprice > 0")


@register(
    "tail_split",
    f"""WITH {MONTHLY} SELECT bucket, value, row_number() OVER (ORDER BY bucket DESC) <= 12 AS is_test FROM m""",
)
def _tail_split(spark, folder):
    return series.mark_tail(_monthly(spark, folder), 12)


@register(
    "length_status",
    f"""WITH {PANEL}, c AS (SELECT o_orderpriority, COUNT(*) AS n FROM m GROUP BY 1)
    SELECT o_orderpriority, n, CAST(85 AS INT) AS advised,
    CASE WHEN n <= 72 THEN 'rejected' WHEN n < 85 THEN 'short' ELSE 'ok' END AS status FROM c""",
)
def _length_status(spark, folder):
    return series.length_status(_monthly(spark, folder, "o_orderpriority"), 72, 1, 1, 12, ["o_orderpriority"])


@register(
    "infer_frequency",
    f"""WITH {PANEL}, l AS (SELECT *, LEAD(bucket) OVER (PARTITION BY o_orderpriority ORDER BY bucket) AS nxt FROM m)
    SELECT o_orderpriority, COUNT(*) AS n,
    CASE WHEN bool_and(nxt IS NULL OR datediff('month', bucket, nxt) = 1) THEN 'MS' END AS freq,
    CASE WHEN bool_and(nxt IS NULL OR datediff('month', bucket, nxt) = 1) THEN CAST(12 AS INT) END AS period FROM l GROUP BY 1""",
)
def _infer_frequency(spark, folder):
    return series.infer_frequency(_monthly(spark, folder, "o_orderpriority"), ["o_orderpriority"])


@register(
    "duplicate_buckets",
    """SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS bucket, COUNT(*) AS n FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def _duplicate_buckets(spark, folder):
    days = table(spark, folder, "orders").withColumn("bucket", F.col("o_orderdate").cast("date"))
    return series.duplicate_buckets(days, ["o_orderpriority"])


EXOG = f"""{MONTHLY}, x AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket, AVG(l_discount) AS discount
    FROM lineitem GROUP BY 1)"""


def _exog(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return series.resample(lines, "l_shipdate", {"discount": ("l_discount", "mean")}, "MS")


@register(
    "exog_align", f"""WITH {EXOG} SELECT m.bucket, value, {_r("discount")} AS discount FROM m JOIN x ON m.bucket = x.bucket"""
)
def _exog_align(spark, folder):
    return _rounded(series.align(_monthly(spark, folder), _exog(spark, folder)), 6, "discount")


@register(
    "exog_side_by_side",
    f"""WITH {EXOG} SELECT COALESCE(m.bucket, x.bucket) AS bucket, value, {_r("discount")} AS discount
    FROM m FULL JOIN x ON m.bucket = x.bucket""",
)
def _exog_side_by_side(spark, folder):
    return _rounded(series.side_by_side(_monthly(spark, folder), _exog(spark, folder)), 6, "discount")


@register(
    "exog_rows",
    f"""WITH {EXOG}, t AS (SELECT bucket FROM m ORDER BY bucket DESC LIMIT 12)
    SELECT bucket, {_r("discount")} AS discount FROM x WHERE bucket IN (SELECT bucket FROM t)""",
)
def _exog_rows(spark, folder):
    _, test = series.split_tail(_monthly(spark, folder), 12)
    return _rounded(series.rows_of(_exog(spark, folder), test), 6, "discount")


@register(
    "prepare_series",
    f"""WITH {SALES} SELECT CAST(date_trunc('month', InvoiceDate) AS DATE) AS bucket, SUM(Quantity) AS value,
    {_r("AVG(UnitPrice)")} AS UnitPrice FROM sales GROUP BY 1""",
)
def _prepare_series(spark, folder):
    sales = _sales(spark, folder)
    return _rounded(series.prepare_series(sales, "InvoiceDate", "Quantity", "sum", "MS", {"UnitPrice": "mean"}), 6, "UnitPrice")


@register(
    "difference",
    f"""WITH {MONTHLY} SELECT bucket, {_r('''value - LAG(value, 1) OVER w - LAG(value, 12) OVER w + LAG(value, 13) OVER w''', 2)} AS w
    FROM m WINDOW w AS (ORDER BY bucket)""",
)
def _difference(spark, folder):
    found = series.difference(_monthly(spark, folder), "value", "w", d=1, seasonal_d=1, period=12)
    return _rounded(found, 2, "w").drop("value")


def _decompose_sql(model: str, source: str, key: str | None) -> str:
    minus, digits, period = ("-", 2, 12) if model == "additive" else ("/", 6, 12)
    part = f"PARTITION BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    phase = f"PARTITION BY {lead}pos % {period}"
    return f"""WITH {source},
    p AS (SELECT *, row_number() OVER ({part} ORDER BY bucket) - 1 AS pos, COUNT(*) OVER ({part}) AS n FROM m),
    b AS (SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN (SUM(value) OVER ({part} ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
      + 0.5 * (LAG(value, 6) OVER ({part} ORDER BY bucket) + LEAD(value, 6) OVER ({part} ORDER BY bucket))) / 12 END AS ma FROM p),
    c AS (SELECT *, CASE WHEN pos >= 6 AND pos < LEAST(18, n - 7) THEN ma END AS hy,
      CASE WHEN pos >= GREATEST(6, n - 7 - 12) AND pos < n - 7 THEN ma END AS ty FROM b),
    d AS (SELECT *, CASE WHEN pos < 6 THEN regr_slope(hy, pos) OVER ({part}) * pos + regr_intercept(hy, pos) OVER ({part})
      WHEN pos > n - 7 THEN regr_slope(ty, pos) OVER ({part}) * pos + regr_intercept(ty, pos) OVER ({part}) ELSE ma END AS trend FROM c),
    e AS (SELECT *, value {minus} trend AS free FROM d),
    f AS (SELECT *, AVG(free) OVER ({phase}) AS idx FROM e),
    h AS (SELECT *, idx {minus} (AVG(CASE WHEN pos < {period} THEN idx END) OVER ({part})) AS seasonal FROM f)
    SELECT {lead}bucket, {_r("value", 2)} AS value, {_r("trend", 2)} AS trend, {_r("seasonal", digits)} AS seasonal,
    {_r(f"free {minus} seasonal", digits)} AS resid, 'ok' AS status FROM h"""


def _decomposed(model: str, *by: str) -> Run:
    def run(spark, folder):
        parts = decompose(_monthly(spark, folder, *by), "value", 12, model, by)
        digits = 2 if model == "additive" else 6
        return _rounded(_rounded(parts, 2, "value", "trend"), digits, "seasonal", "resid")

    return run


register("decompose_additive", _decompose_sql("additive", MONTHLY, None))(_decomposed("additive"))
register("decompose_mult", _decompose_sql("multiplicative", MONTHLY, None))(_decomposed("multiplicative"))
register("decompose_panel", _decompose_sql("additive", PANEL, "o_orderpriority"))(_decomposed("additive", "o_orderpriority"))


# ---------------------------------------------------------------- models and their quality


def _metrics_sql(source: str, key: str | None) -> str:
    part, lead = (f"PARTITION BY {key}", f"{key}, ") if key else ("", "")
    return f"""WITH {source}, f AS (SELECT *, LAG(value, 12) OVER ({part} ORDER BY bucket) AS forecast FROM m),
    e AS (SELECT {lead}value AS y, value - forecast AS err FROM f WHERE forecast IS NOT NULL)
    SELECT {lead}COUNT(*) AS n, {_r("AVG(err * err)", 0)} AS mse, {_r("sqrt(AVG(err * err))", 4)} AS rmse,
    {_r("AVG(abs(err))", 4)} AS mae, {_r("1 - AVG(err * err) / VAR_POP(y)")} AS r2, {_r("AVG(abs(err / CASE WHEN y = 0 THEN 1e-8 ELSE y END)) * 100")} AS mape
    FROM e {f"GROUP BY {key}" if key else ""}"""


def _naive(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    months = _monthly(spark, folder, *by)
    return months.withColumn("forecast", F.lag("value", 12).over(series.series_window(by, "bucket")))


def _metric_rounding(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(_rounded(df, 0, "mse"), 4, "rmse", "mae"), 6, "r2", "mape")


@register("metrics", _metrics_sql(MONTHLY, None))
def _metrics(spark, folder):
    return _metric_rounding(regression_metrics(_naive(spark, folder), "value", "forecast"))


@register("metrics_by_series", _metrics_sql(PANEL, "o_orderpriority"))
def _metrics_by_series(spark, folder):
    naive = _naive(spark, folder, "o_orderpriority")
    return _metric_rounding(regression_metrics(naive, "value", "forecast", ["o_orderpriority"]))


@register(
    "residual_acf",
    f"""WITH {MONTHLY}, d AS (SELECT bucket, value - LAG(value) OVER (ORDER BY bucket) AS r FROM m),
    c AS (SELECT bucket, r - AVG(r) OVER () AS c FROM d WHERE r IS NOT NULL),
    p AS ({" UNION ALL ".join(f"SELECT {k} AS lag, bucket, c * LAG(c, {k}) OVER (ORDER BY bucket) AS p FROM c" for k in range(11))})
    SELECT CAST(lag AS INT) AS lag, {_r("SUM(p) / (SELECT SUM(c * c) FROM c)")} AS acf FROM p GROUP BY lag""",
)
def _residual_acf(spark, folder):
    changes = series.difference(_monthly(spark, folder), "value", "r")
    return _rounded(diagnostics.autocorrelation(changes, "r"), 6, "acf")


@register(
    "qq_points",
    f"""WITH {PANEL}, d AS (SELECT *, value - LAG(value) OVER (PARTITION BY o_orderpriority ORDER BY bucket) AS r FROM m),
    z AS (SELECT o_orderpriority, (r - AVG(r) OVER w) / STDDEV_POP(r) OVER w AS z FROM d WHERE r IS NOT NULL
      WINDOW w AS (PARTITION BY o_orderpriority))
    SELECT o_orderpriority, {_r("z")} AS sample, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY z) AS INT) AS rank,
    {_r("row_number() OVER (PARTITION BY o_orderpriority ORDER BY z) / (COUNT(*) OVER (PARTITION BY o_orderpriority) + 1)", 8)} AS share
    FROM z""",
)
def _qq_points(spark, folder):
    by = ["o_orderpriority"]
    changes = series.difference(_monthly(spark, folder, *by), "value", "resid", by=by)
    points = diagnostics.qq_points(diagnostics.standardized(changes, by=by), by=by)
    return _rounded(_rounded(points, 6, "sample"), 8, "share").drop("theoretical")


def _normal_sql(share: str) -> str:
    """The rational approximation as SQL."""
    def polynomial(x: str, coefficients) -> str:
        out = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out

    near, centred = f"LEAST({share}, 1 - {share})", f"({share} - 0.5)"
    root, squared = f"sqrt(-2 * ln({near}))", f"({centred} * {centred})"
    tail = f"{polynomial(root, diagnostics.TAIL_TOP)} / {polynomial(root, diagnostics.TAIL_BOTTOM)}"
    middle = f"{polynomial(squared, diagnostics.MIDDLE_TOP)} * {centred} / {polynomial(squared, diagnostics.MIDDLE_BOTTOM)}"
    return f"CASE WHEN {near} >= {diagnostics.TAIL} THEN {middle} WHEN {share} < 0.5 THEN {tail} ELSE -({tail}) END"


@register(
    "qq_theoretical",
    f"""WITH {MONTHLY}, d AS (SELECT value - LAG(value) OVER (ORDER BY bucket) AS r FROM m),
    s AS (SELECT CAST(row_number() OVER (ORDER BY r) AS INT) AS rank, row_number() OVER (ORDER BY r) / (COUNT(*) OVER () + 1) AS share
      FROM d WHERE r IS NOT NULL)
    SELECT rank, {_r("share", 8)} AS share, {_r(_normal_sql("share"), 7)} AS theoretical FROM s""",
)
def _qq_theoretical(spark, folder):
    changes = series.difference(_monthly(spark, folder), "value", "resid")
    points = diagnostics.qq_points(diagnostics.standardized(changes)).select("rank", "share", "theoretical")
    return _rounded(_rounded(points, 8, "share"), 7, "theoretical")


PRIORITY = "o_orderpriority"


def _diagnostics_sql() -> str:
    by = PRIORITY
    return f"""WITH {PANEL}, ch AS (SELECT {by}, bucket, value - LAG(value) OVER (PARTITION BY {by} ORDER BY bucket) AS r FROM m),
    z AS (SELECT {by}, bucket, (r - AVG(r) OVER w) / STDDEV_POP(r) OVER w AS z FROM ch WHERE r IS NOT NULL WINDOW w AS (PARTITION BY {by})),
    f AS (SELECT {by}, MIN(z) AS lo, (MAX(z) - MIN(z)) / 10 AS w, COUNT(*) AS n, STDDEV_SAMP(z) * pow(COUNT(*), -0.2) AS h, AVG(z) AS mean FROM z GROUP BY 1),
    b AS (SELECT {by}, CAST(least(floor((z - lo) / w), 9) AS INT) AS bin, COUNT(*) AS k FROM z JOIN f USING ({by}) GROUP BY 1, 2),
    xs AS (SELECT j, -3.92 + j * CAST({2 * 3.92 / 49!r} AS DOUBLE) AS x FROM range(50) t(j)),
    q AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY z, bucket) AS rank, z,
      row_number() OVER (PARTITION BY {by} ORDER BY z, bucket) / (COUNT(*) OVER (PARTITION BY {by}) + 1) AS share FROM z),
    o AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY bucket) AS i, z - mean AS c FROM z JOIN f USING ({by})),
    ac AS (SELECT o.{by} AS {by}, o.i - p.i AS lag, SUM(o.c * p.c) AS s FROM o JOIN o p ON o.{by} = p.{by} AND o.i - p.i BETWEEN 0 AND 10 GROUP BY 1, 2),
    l AS (
      SELECT {by}, 'residuals' AS chart, row_number() OVER (PARTITION BY {by} ORDER BY bucket) AS place, NULL::DOUBLE AS x, z AS y FROM z
      UNION ALL SELECT f.{by}, 'histogram', j, lo + j * w, coalesce(k, 0) / (n * w) FROM f CROSS JOIN range(10) t(j) LEFT JOIN b ON b.{by} = f.{by} AND b.bin = j
      UNION ALL SELECT {by}, 'density', j, x, SUM(exp(-((x - z) / h) * ((x - z) / h) / 2) / (n * h)) / sqrt(2 * pi()) FROM z JOIN f USING ({by}), xs GROUP BY {by}, j, x
      UNION ALL SELECT {by}, 'qq', rank, {_normal_sql("share")}, z FROM q
      UNION ALL SELECT {by}, 'acf', lag, lag::DOUBLE, s / MAX(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY {by}) FROM ac)
    SELECT {by}, chart, CAST(place AS INT) AS place, {_r("x", 5)} AS x, {_r("y", 5)} AS y FROM l"""


@register("panel_diagnostics", _diagnostics_sql())
def _panel_diagnostics(spark, folder):
    changes = series.difference(_monthly(spark, folder, PRIORITY), "value", "resid", by=[PRIORITY])
    return _rounded(diagnostics.as_one_table(diagnostics.diagnose(changes, by=[PRIORITY]), [PRIORITY]), 5, "x", "y")


@register(
    "ordered_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM orders)
    SELECT o_orderkey, rn > n - CAST(ceil(n * 0.2) AS BIGINT) AS is_test FROM r""",
)
def _ordered_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    train, test = splits.ordered_split(orders, ["o_orderdate", "o_orderkey"], 0.2)
    marked = [part.select("o_orderkey", F.lit(flag).alias("is_test")) for part, flag in ((train, False), (test, True))]
    return marked[0].unionByName(marked[1])


@register(
    "random_split",
    "SELECT o_orderkey, CAST('0x' || md5('42|' || o_orderkey)[1:8] AS BIGINT) / 4294967296 < 0.2 AS is_test FROM orders",
)
def _random_split(spark, folder):
    train, test = splits.random_split(table(spark, folder, "orders").select("o_orderkey"), 0.2)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


def _forest(spark: SparkSession, folder: str):
    sales = _sales(spark, folder, "InvoiceNo", "StockCode", "Country").drop("TotalPrice")
    features = [*forest.default_features(sales, "Quantity"), "UnitPrice", "Country"]
    order = ["InvoiceDate", "InvoiceNo", "StockCode"]
    # the split and the forest pass over the rows several times
    train, test = splits.ordered_split(stored(sales.select(*order, "Quantity", *features)), order, 0.2)
    return forest.fit_forest(train, "Quantity", features), test


@register("rf_forecast")
def _rf_forecast(spark, folder):
    model, test = _forest(spark, folder)
    return forest.predict_forest(model, test).select("InvoiceNo", "StockCode", "Quantity", "prediction")


@register("rf_metrics")
def _rf_metrics(spark, folder):
    model, test = _forest(spark, folder)
    return regression_metrics(forest.predict_forest(model, test), "Quantity", "prediction")


@register("rf_importance")
def _rf_importance(spark, folder):
    model, test = _forest(spark, folder)
    return forest.feature_importances(model, test)


def _country_months(spark: SparkSession, folder: str) -> DataFrame:
    sales = _sales(spark, folder, "Country")
    return series.prepare_series(sales, "InvoiceDate", "Quantity", "sum", "MS", {"UnitPrice": "mean"}, ["Country"])


SEASONAL = Orders(1, 1, 1, 1, 0, 1, 12)


@register("panel_forecast")
def _panel_forecast(spark, folder):
    model = panel.fit_panel(_country_months(spark, folder), orders=SEASONAL, by=["Country"])
    return panel.forecast_panel(model, 12, "MS", SEASONAL)


# Without lags, a forecast is last year's value plus the last yearly change, and a fitted value the same one step back.
NAIVE = Orders(0, 1, 0, 0, 1, 0, 12)
SERIES_OF = f"""{PANEL}, s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY bucket) AS i,
    COUNT(*) OVER (PARTITION BY o_orderpriority) AS n, MAX(bucket) OVER (PARTITION BY o_orderpriority) AS last FROM m)"""


@register(
    "panel_naive_forecast",
    f"""WITH {SERIES_OF}, e AS (SELECT {PRIORITY}, MAX(value) FILTER (i = n) - MAX(value) FILTER (i = n - 12) AS change FROM s GROUP BY 1)
    SELECT {PRIORITY}, CAST(i - n + 12 AS INT) AS step, CAST(last + to_months(CAST(i - n + 12 AS INT)) AS DATE) AS bucket,
    {_r("value + change", 2)} AS forecast, 'ok' AS status FROM s JOIN e USING ({PRIORITY}) WHERE i > n - 12""",
)
def _panel_naive_forecast(spark, folder):
    model = panel.fit_panel(_monthly(spark, folder, PRIORITY), orders=NAIVE, by=[PRIORITY])
    return _rounded(panel.forecast_panel(model, 12, "MS", NAIVE), 2, "forecast")


@register(
    "panel_naive_in_sample",
    f"""WITH {SERIES_OF}, f AS (SELECT *, CASE WHEN i > 13 THEN LAG(value) OVER w + LAG(value, 12) OVER w - LAG(value, 13) OVER w END AS fitted
      FROM s WINDOW w AS (PARTITION BY {PRIORITY} ORDER BY bucket))
    SELECT {PRIORITY}, bucket, {_r("value", 2)} AS actual, {_r("fitted", 2)} AS fitted, {_r("value - fitted", 2)} AS resid FROM f""",
)
def _panel_naive_in_sample(spark, folder):
    model = panel.fit_panel(_monthly(spark, folder, PRIORITY), orders=NAIVE, by=[PRIORITY])
    return _rounded(panel.in_sample(model, "MS"), 2, "actual", "fitted", "resid")


@register(
    "panel_naive_metrics",
    f"""WITH {SERIES_OF}, e AS (SELECT {PRIORITY}, MAX(value) FILTER (i = n - 12) - MAX(value) FILTER (i = n - 24) AS change FROM s GROUP BY 1),
    p AS (SELECT {PRIORITY}, value AS y, value - (LAG(value, 12) OVER (PARTITION BY {PRIORITY} ORDER BY bucket) + change) AS err, i, n
      FROM s JOIN e USING ({PRIORITY}))
    SELECT {PRIORITY}, COUNT(*) AS n, {_r("AVG(err * err)", 0)} AS mse, {_r("sqrt(AVG(err * err))", 4)} AS rmse,
    {_r("AVG(abs(err))", 4)} AS mae, {_r("1 - AVG(err * err) / VAR_POP(y)")} AS r2,
    {_r("AVG(abs(err / CASE WHEN y = 0 THEN 1e-8 ELSE y END)) * 100")} AS mape FROM p WHERE i > n - 12 GROUP BY 1""",
)
def _panel_naive_metrics(spark, folder):
    train, test = series.split_tail(_monthly(spark, folder, PRIORITY), 12, [PRIORITY])
    path = panel.forecast_panel(panel.fit_panel(train, orders=NAIVE, by=[PRIORITY]), 12, "MS", NAIVE)
    return _metric_rounding(regression_metrics(test.join(path, [PRIORITY, "bucket"]), "value", "forecast", [PRIORITY]))


@register(
    "panel_status",
    f"""WITH {SERIES_OF} SELECT DISTINCT {PRIORITY}, CASE {PRIORITY} WHEN '1-URGENT' THEN 'has_nulls' WHEN '2-HIGH' THEN 'has_nulls'
    WHEN '3-MEDIUM' THEN 'no_future' WHEN '4-NOT SPECIFIED' THEN 'short' ELSE 'ok' END AS status,
    CAST(CASE WHEN {PRIORITY} IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 0 ELSE 6 END AS BIGINT) AS n_forecasts FROM s""",
)
def _panel_status(spark, folder):
    """A missing value, an infinite one, a missing future value, and a short series, made from the whole table."""
    months = _monthly(spark, folder, PRIORITY)
    last = F.max("bucket").over(series.series_window([PRIORITY]))
    at_end = F.col("bucket") == last
    value = F.when(at_end & (F.col(PRIORITY) == "1-URGENT"), None).when(at_end & (F.col(PRIORITY) == "2-HIGH"), float("inf"))
    months = months.withColumn("_last", last).withColumn("value", value.otherwise(F.col("value"))).withColumn("x", F.month("bucket").cast("double"))
    months = months.where((F.col(PRIORITY) != "4-NOT SPECIFIED") | (F.months_between("_last", "bucket") < 3))
    orders = Orders(1, 0, 0, 0, 0, 0, 12)
    future = months.select(PRIORITY, "_last").distinct().withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    future = future.withColumn("bucket", F.add_months("_last", F.col("_k"))).withColumn("x", F.month("bucket").cast("double"))
    future = future.where((F.col(PRIORITY) != "3-MEDIUM") | (F.col("_k") != 3))
    model = panel.fit_panel(months.drop("_last"), orders=orders, exog=["x"], by=[PRIORITY])
    path = panel.forecast_panel(model, 6, "MS", orders, future, ["x"])
    return path.groupBy(PRIORITY).agg(F.max("status").alias("status"), F.count("forecast").alias("n_forecasts"))


@register(
    "panel_phi",
    f"""WITH {SERIES_OF}, z AS (SELECT {PRIORITY}, bucket, value - LAG(value) OVER (PARTITION BY {PRIORITY} ORDER BY bucket) AS z FROM s),
    p AS (SELECT {PRIORITY}, z, LAG(z) OVER (PARTITION BY {PRIORITY} ORDER BY bucket) AS z1 FROM z)
    SELECT {PRIORITY}, {_r("SUM(z * z1) / SUM(z1 * z1)", 3)} AS phi FROM p WHERE z1 IS NOT NULL AND z IS NOT NULL GROUP BY 1""",
)
def _panel_phi(spark, folder):
    orders = Orders(1, 1, 0, 0, 0, 0, 12)
    model = panel.fit_panel(_monthly(spark, folder, PRIORITY), orders=orders, by=[PRIORITY])
    return _rounded(panel.coefficients(model).where("part = 'phi'").select(PRIORITY, F.col("value").alias("phi")), 3, "phi")


@register(
    "panel_seasonal_phi",
    f"""WITH {SERIES_OF}, z AS (SELECT {PRIORITY}, bucket, value - LAG(value) OVER (PARTITION BY {PRIORITY} ORDER BY bucket) AS z FROM s),
    p AS (SELECT {PRIORITY}, z, LAG(z, 12) OVER (PARTITION BY {PRIORITY} ORDER BY bucket) AS z12 FROM z)
    SELECT {PRIORITY}, {_r("SUM(z * z12) / SUM(z12 * z12)", 3)} AS seasonal_phi FROM p WHERE z12 IS NOT NULL AND z IS NOT NULL GROUP BY 1""",
)
def _panel_seasonal_phi(spark, folder):
    """One seasonal autoregressive term, stored as a model and loaded again."""
    orders, path = Orders(0, 1, 0, 1, 0, 0, 12), f"{staging_dir(spark)}/{model_store.model_name('SARIMA', 'value')}"
    model_store.save_panel(spark, panel.fit_panel(_monthly(spark, folder, PRIORITY), orders=orders, by=[PRIORITY]), path, orders, "MS", "value")
    model, loaded, freq, _ = model_store.load_panel(spark, path)
    if (loaded, freq) != (orders, "MS"):
        raise ValueError("the stored model is not the one that was saved")
    found = panel.coefficients(model).where("part = 'seasonal_phi'")
    return _rounded(found.select(PRIORITY, F.col("value").alias("seasonal_phi")), 3, "seasonal_phi")


@register(
    "stored_or_read",
    f"""WITH {SALES} SELECT 'sales_processed.parquet' AS name, 'parquet' AS kind, COUNT(*) AS n, CAST(SUM(TotalPrice) AS DOUBLE) AS total,
    TRUE AS stored FROM sales UNION ALL SELECT 'other_processed.parquet', 'parquet', COUNT(*), CAST(SUM(TotalPrice) AS DOUBLE), FALSE FROM sales""",
)
def _stored_or_read(spark, folder):
    """The processed copy of one file is stored and read, that of another is missing and made anew."""
    root, out = staging_dir(spark), None
    first = paths.processed_path(f"{root}/sales.csv")
    write_table(_sales(spark, folder).withColumn("stored", F.lit(True)), first)
    for path in (first, paths.processed_path(f"{root}/other.xlsx")):
        found = paths.stored_or(spark, path, spark.read.parquet, lambda: _sales(spark, folder).withColumn("stored", F.lit(False)))
        one = found.agg(F.count(F.lit(1)).alias("n"), F.sum("TotalPrice").cast("double").alias("total"), F.first("stored").alias("stored"))
        one = one.select(F.lit(path.rsplit("/", 1)[-1]).alias("name"), F.lit(paths.extension(path)).alias("kind"), "n", "total", "stored")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "default_features",
    f"""WITH {SALES} SELECT year(InvoiceDate) AS OrderYear, month(InvoiceDate) AS OrderMonth, day(InvoiceDate) AS OrderDay,
    isodow(InvoiceDate) - 1 AS OrderDayOfWeek, hour(InvoiceDate) AS OrderHour, weekofyear(InvoiceDate) AS OrderWeekOfYear,
    quarter(InvoiceDate) AS OrderQuarter, COUNT(*) AS n FROM sales GROUP BY ALL""",
)
def _default_features(spark, folder):
    sales = _sales(spark, folder, "InvoiceNo", "StockCode")
    chosen = forest.default_features(sales, "Quantity")
    counted = sales.groupBy(*chosen).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*[F.col(c).cast("long").alias(c) for c in chosen], "n")


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """A target that follows a feature of two values, which any grown forest returns exactly."""
    part = table(spark, folder, "part")
    large = F.col("p_size") > 25
    return part.select("p_partkey", F.when(large, 40.0).otherwise(10.0).alias("target"), large.cast("int").alias("large"), F.lit(1).alias("same"))


STEP_FOREST = {"target": "target", "features": ["large", "same"], "trees": 10, "max_depth": 3}


@register("rf_steps_forecast", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 40.0 ELSE 10.0 END::DOUBLE AS prediction FROM part")
def _rf_steps_forecast(spark, folder):
    rows = _steps(spark, folder)
    return forest.predict_forest(forest.fit_forest(rows, **STEP_FOREST), rows).select("p_partkey", "prediction")


@register("rf_steps_metrics", "SELECT COUNT(*) AS n, 0.0::DOUBLE AS mse, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS r2, 0.0::DOUBLE AS mape FROM part")
def _rf_steps_metrics(spark, folder):
    rows = _steps(spark, folder)
    return regression_metrics(forest.predict_forest(forest.fit_forest(rows, **STEP_FOREST), rows), "target", "prediction")


@register(
    "rf_steps_importance",
    """SELECT 'large' AS Feature, 1.0::DOUBLE AS Importance FROM part HAVING COUNT(DISTINCT p_size > 25) = 2
    UNION ALL SELECT 'same', 0.0::DOUBLE""",
)
def _rf_steps_importance(spark, folder):
    rows = _steps(spark, folder)
    return forest.feature_importances(forest.fit_forest(rows, **STEP_FOREST), rows)


def _labelled_steps(spark: SparkSession, folder: str) -> DataFrame:
    """A target that follows a text feature with more values than lines in most tables: how often the value occurs."""
    lines = table(spark, folder, "lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("label"), "l_linenumber")
    often = lines.groupBy("label").agg(F.count(F.lit(1)).alias("often"))
    return lines.join(often, "label").select("label", "l_linenumber", (F.col("often") * 10.0).alias("target"), F.lit(1).alias("same"))


@register(
    "rf_all_but_target",
    """SELECT 'large' AS Feature, 1.0::DOUBLE AS Importance FROM part HAVING COUNT(DISTINCT p_size > 25) = 2
    UNION ALL SELECT 'same', 0.0::DOUBLE""",
)
def _rf_all_but_target(spark, folder):
    """Without named features every column but the target is one."""
    rows = _steps(spark, folder).drop("p_partkey")
    return forest.feature_importances(forest.fit_forest(rows, "target", trees=10, max_depth=3), rows)


@register(
    "text_feature_codes",
    """SELECT 'label' AS feature, 'order ' || l_orderkey AS label, CAST(row_number() OVER (ORDER BY COUNT(*) DESC, 'order ' || l_orderkey) - 1 AS DOUBLE) AS code,
    COUNT(*) OVER () AS "values" FROM lineitem GROUP BY l_orderkey""",
)
def _text_feature_codes(spark, folder):
    return forest.frequency_codes(_labelled_steps(spark, folder), ["label"])


@register(
    "rf_text_forecast",
    """SELECT label, l_linenumber, n >= 4 AS predicted_often FROM (SELECT 'order ' || l_orderkey AS label, l_linenumber,
      COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n NOT IN (3, 4)""",
)
def _rf_text_forecast(spark, folder):
    """Codes follow the frequency, so one threshold on them tells frequent values apart, however many values there are.

    Trained on and asked for all rows; where the two classes meet (values that occur three or four times) a bin
    of the forest holds codes of both, so these are not compared.
    """
    rows = _labelled_steps(spark, folder).withColumn("often", (F.col("target") >= 40).cast("double"))
    found = forest.predict_forest(forest.fit_forest(rows, "often", ["label", "same"], trees=5, max_depth=3), rows)
    found = found.where(~F.col("target").isin(30.0, 40.0))
    return found.select("label", "l_linenumber", (F.col("prediction") >= 0.5).alias("predicted_often"))


@register("model_round_trip", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 40.0 ELSE 10.0 END::DOUBLE AS prediction FROM part")
def _model_round_trip(spark, folder):
    """The newest of two stored models, loaded, predicts what the trained one did."""
    rows, root = _steps(spark, folder), staging_dir(spark)
    model = forest.fit_forest(rows, **STEP_FOREST)
    for second in (1, 2):
        name = model_store.model_name("RandomForest", "target", dt.datetime(2025, 5, 28, 9, 32, second))
        model_store.save_forest(spark, model, f"{root}/{name}", "target", STEP_FOREST["features"])
    loaded = model_store.load_forest(spark, model_store.newest_model(spark, root))
    return forest.predict_forest(loaded, rows).select("p_partkey", "prediction")


@register(
    "decompose_status",
    f"""WITH {PANEL} SELECT DISTINCT {PRIORITY}, CASE {PRIORITY} WHEN '1-URGENT' THEN 'has_nulls' WHEN '2-HIGH' THEN 'non_positive'
    WHEN '3-MEDIUM' THEN 'short' ELSE 'ok' END AS status FROM m""",
)
def _decompose_status(spark, folder):
    months = _monthly(spark, folder, PRIORITY)
    last = F.max("bucket").over(series.series_window([PRIORITY]))
    at_end = F.col("bucket") == last
    value = F.when(at_end & (F.col(PRIORITY) == "1-URGENT"), None).when(at_end & (F.col(PRIORITY) == "2-HIGH"), 0.0)
    # a month without orders counts as 1
    months = months.withColumn("_last", last).withColumn("value", value.otherwise(F.greatest(F.col("value"), F.lit(1.0))))
    months = months.where((F.col(PRIORITY) != "3-MEDIUM") | (F.months_between("_last", "bucket") < 23)).drop("_last")
    return decompose(months, "value", 12, "multiplicative", [PRIORITY]).select(PRIORITY, "status").distinct()


NAMED = {"D": ("day", "D", 7), "W": ("week", "W-SUN", 52), "MS": ("month", "MS", 12), "QS": ("quarter", "QS", 4), "AS": ("year", "AS", None)}


@register(
    "infer_frequency_names",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS made, datediff('{unit}', date_trunc('{unit}', MIN(o_orderdate)), date_trunc('{unit}', MAX(o_orderdate))) + 1 AS n, '{name}' AS freq,
        CAST({period or 'NULL'} AS INT) AS period FROM orders""" for f, (unit, name, period) in NAMED.items()
    ),
)
def _infer_frequency_names(spark, folder):
    orders, found = table(spark, folder, "orders"), None
    for f in NAMED:
        one = series.resample(orders, "o_orderdate", {"n": ("o_totalprice", "count")}, f).withColumn("made", F.lit(f))
        found = one if found is None else found.unionByName(one)
    return series.infer_frequency(found, ["made"])


# every kind of calendar that `resample` makes; the clock ones are laid over the events
CALENDARS = {**{f: "orders" for f in (*SQL_BUCKETS, *SQL_MULTIPLES, "B")}, **{f: "events" for f in ("3h", "15min", "7min", "90s")}}


def _calendar_sql(freq: str) -> str:
    """The labels of the buckets between the first and the last one, as times."""
    if CALENDARS[freq] == "events":
        seconds = {"3h": 10_800, "15min": 900, "7min": 420, "90s": 90}[freq]
        return (f"SELECT '{freq}' AS made, first + to_seconds(unnest(range(a, b + 1)) * {seconds}) AS t FROM (SELECT date_trunc('day', MIN(ts)) AS first, "
                f"CAST(floor(date_diff('second', date_trunc('day', MIN(ts)), MIN(ts)) / {seconds}.0) AS BIGINT) AS a, "
                f"CAST(floor(date_diff('second', date_trunc('day', MIN(ts)), MAX(ts)) / {seconds}.0) AS BIGINT) AS b FROM events)")
    if freq == "B":
        return """SELECT 'B' AS made, s AS t FROM (SELECT unnest(generate_series(MIN(d), MAX(d), INTERVAL 1 DAY)) AS s
          FROM (SELECT CAST(o_orderdate AS DATE) - greatest(isodow(o_orderdate) - 5, 0)::INT AS d FROM orders)) WHERE isodow(s) < 6"""
    if freq in SQL_BUCKETS:
        start, label, step = SQL_BUCKETS[freq]
        starts = f"SELECT {start.format(t='o_orderdate')} AS s FROM orders"
        label = label.format(s="s")
    else:
        unit, start, label, step = SQL_MULTIPLES[freq]
        starts = f"SELECT {start} AS s FROM (SELECT {unit} AS u FROM orders), (SELECT MIN({unit}) AS first FROM orders)"
    spread = f"SELECT CAST(unnest(generate_series(MIN(s), MAX(s), INTERVAL {step})) AS DATE) AS s FROM ({starts})"
    return f"SELECT '{freq}' AS made, CAST({label} AS TIMESTAMP) AS t FROM ({spread})"


@register(
    "infer_frequency_all",
    f"""WITH c AS ({" UNION ALL ".join(f"({_calendar_sql(f)})" for f in CALENDARS)}),
    g AS (SELECT *, LEAD(t) OVER (PARTITION BY made ORDER BY t) AS nxt FROM c),
    f AS (SELECT made, COUNT(*) AS n, MIN(t) AS first, MIN(epoch_us(nxt) - epoch_us(t)) AS g0, MAX(epoch_us(nxt) - epoch_us(t)) AS g1,
      MIN(datediff('month', t, nxt)) AS m0, MAX(datediff('month', t, nxt)) AS m1,
      bool_and(day(t) = 1) AS cs, bool_and(day(t) = day(last_day(t))) AS ce, bool_and(isodow(t) < 6) AS work FROM g GROUP BY made),
    u AS (SELECT *, CASE WHEN g0 < 86400000000 THEN NULL WHEN (cs OR ce) AND m0 = m1 AND m0 > 0 THEN CASE WHEN m0 % 12 = 0 THEN 'A' WHEN m0 % 3 = 0 THEN 'Q' ELSE 'M' END
        WHEN g0 = g1 AND g0 % (7 * 86400000000) = 0 THEN 'W' WHEN g0 = g1 THEN 'D' WHEN work AND g0 = 86400000000 AND g1 = 3 * g0 THEN 'B' END AS unit FROM f),
    k AS (SELECT *, CASE unit WHEN 'A' THEN m0 // 12 WHEN 'Q' THEN m0 // 3 WHEN 'M' THEN m0 WHEN 'W' THEN g0 // (7 * 86400000000) WHEN 'D' THEN g0 // 86400000000
        WHEN 'B' THEN 1 ELSE CASE WHEN g0 % 3600000000 = 0 THEN g0 // 3600000000 WHEN g0 % 60000000 = 0 THEN g0 // 60000000 ELSE g0 // 1000000 END END AS times FROM u)
    SELECT made, n, CASE WHEN times > 1 THEN CAST(CAST(times AS BIGINT) AS VARCHAR) ELSE '' END ||
      CASE WHEN unit = 'W' THEN 'W-' || upper(strftime(first, '%a'))
           WHEN unit = 'Q' AND month(first) % 3 = 2 THEN CASE WHEN ce THEN 'Q' ELSE 'QS' END || '-NOV'
           WHEN unit = 'Q' AND ce THEN CASE month(first) % 3 WHEN 0 THEN 'Q' ELSE 'Q-OCT' END
           WHEN unit = 'Q' THEN CASE month(first) % 3 WHEN 1 THEN 'QS' ELSE 'QS-DEC' END
           WHEN unit IN ('A', 'M') AND NOT ce THEN unit || 'S'
           WHEN unit IS NULL THEN CASE WHEN g0 % 3600000000 = 0 THEN 'h' WHEN g0 % 60000000 = 0 THEN 'min' ELSE 's' END
           ELSE unit END AS freq,
      CAST(CASE unit WHEN 'D' THEN 7 WHEN 'W' THEN 52 WHEN 'M' THEN 12 WHEN 'Q' THEN 4 END AS INT) AS period FROM k""",
)
def _infer_frequency_all(spark, folder):
    source = {"orders": ("o_orderdate", "o_orderkey"), "events": ("ts", "event_id")}
    found = None
    for freq, name in CALENDARS.items():
        ts, counted = source[name]
        one = series.resample(table(spark, folder, name), ts, {"n": (counted, "count")}, freq)
        one = one.select(F.lit(freq).alias("made"), F.col("bucket").cast("timestamp_ntz").alias("bucket"))
        found = one if found is None else found.unionByName(one)
    return series.infer_frequency(found, ["made"])


@register(
    "stock_chosen_columns",
    """SELECT l_returnflag, CAST(SUM(l_orderkey) AS BIGINT) AS TotalSold, 1000 - CAST(SUM(l_orderkey) AS BIGINT) AS EstimatedCurrentStock
    FROM lineitem GROUP BY 1""",
)
def _stock_chosen_columns(spark, folder):
    lines = table(spark, folder, "lineitem")
    return inventory.stock_estimate(lines, *inventory.choose_columns(lines))


@register("csv_payload", "SELECT event_id, event_type FROM events")
def _csv_payload(spark, folder):
    path = f"{staging_dir(spark)}/payload.csv"
    write_table(table(spark, folder, "events").select("event_id", "event_type"), path)
    return read_payload(spark, path, "CSV")[0].select(F.col("event_id").cast("long").alias("event_id"), "event_type")


@register(
    "csv_mixed_headers",
    "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value FROM events",
)
def _csv_mixed_headers(spark, folder):
    """The events as two folders of files, one with another column order, one without a column."""
    events, root = table(spark, folder, "events"), staging_dir(spark)
    write_table(events.where("event_id % 2 = 0").select("event_id", "value", "event_type"), f"{root}/even.csv")
    write_table(events.where("event_id % 2 = 1").select(F.col("event_type").alias(" event_type "), "event_id"), f"{root}/odd.csv")
    found = read_csv(spark, [f"{root}/even.csv", f"{root}/odd.csv"], by_name=True)
    return found.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("value").cast("double").alias("value"))


@register(
    "csv_rejects",
    "SELECT event_id || ',' || event_type || ',extra' AS line FROM events WHERE event_type = 'error'",
)
def _csv_rejects(spark, folder):
    events, path = table(spark, folder, "events"), f"{staging_dir(spark)}/lines.csv"
    cells = F.concat_ws(",", "event_id", "event_type", F.when(F.col("event_type") == "error", "extra"))
    # whole lines as the one cell of a writer that separates by another character: every file begins with the header
    events.select(cells.alias("event_id,event_type")).write.options(header=True, sep="\u0001").csv(path)
    return read_csv_with_rejects(spark, path)[1].select(F.col(CORRUPT).alias("line"))


@register(
    "json_payload_list",
    "SELECT event_id, event_type FROM events",
)
def _json_payload_list(spark, folder):
    path = f"{staging_dir(spark)}/list.json"
    events = table(spark, folder, "events").select("event_id", "event_type")
    # a file holds one list, here of a thousand events
    lists = events.groupBy(F.floor(F.col("event_id") / 1000).alias("file")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("l"))
    lists.select("file", F.to_json("l").alias("value")).write.partitionBy("file").text(path)
    return read_payload(spark, f"{path}/*", "json", T.StructType.fromDDL("event_id bigint, event_type string"))[0]


@register("raw_copy", "SELECT event_id || ',' || event_type AS value FROM events")
def _raw_copy(spark, folder):
    root = staging_dir(spark)
    table(spark, folder, "events").select(F.concat_ws(",", "event_id", "event_type").alias("value")).write.text(f"{root}/in")
    keep_raw(spark, f"{root}/in", f"{root}/raw")
    return spark.read.text(f"{root}/raw")


DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy H:mm", "M/d/yy h:mm a", "d MMM yyyy", "MMMM d, yyyy h:mm:ss a", "dd-MMM-yyyy HH:mm")


@register("dates_in_layouts", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _dates_in_layouts(spark, folder):
    date, place = F.col("o_orderdate"), F.col("o_orderkey") % len(DATE_LAYOUTS)
    text = F.coalesce(*[F.when(place == i, F.date_format(date, f)) for i, f in enumerate(DATE_LAYOUTS)])
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", parse_timestamp(F.col("t"), rows.schema["t"].dataType).cast("date").alias("day"))


@register("dates_with_formats", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 3 < 2")
def _dates_with_formats(spark, folder):
    date, place = F.col("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(place == 0, F.date_format(date, "dd.MM.yyyy")).when(place == 1, F.date_format(date, "yyyy|MM|dd")).otherwise("neither")
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("t"))
    day = parse_timestamp(F.col("t"), rows.schema["t"].dataType, ("dd.MM.yyyy", "yyyy|MM|dd")).cast("date")
    return rows.select("o_orderkey", day.alias("day")).where("day IS NOT NULL")


@register("panel_coefficients")
def _panel_coefficients(spark, folder):
    model = panel.fit_panel(_country_months(spark, folder), orders=SEASONAL, exog=["UnitPrice"], by=["Country"])
    return panel.coefficients(model)


@register("panel_in_sample")
def _panel_in_sample(spark, folder):
    model = panel.fit_panel(_country_months(spark, folder), orders=SEASONAL, by=["Country"])
    return panel.in_sample(model, "MS")


@register("panel_holdout_metrics")
def _panel_holdout_metrics(spark, folder):
    """Twelve held-out months per country, forecast with known future prices."""
    train, test = series.split_tail(_country_months(spark, folder), 12, ["Country"])
    model = panel.fit_panel(train, orders=SEASONAL, exog=["UnitPrice"], by=["Country"])
    path = panel.forecast_panel(model, 12, "MS", SEASONAL, test, ["UnitPrice"])
    return regression_metrics(test.join(path, ["Country", "bucket"]), "value", "forecast", ["Country"])


# ---------------------------------------------------------------- streams, rewritten months, stored sketches

CUT = "1995-01-01"
LANDED = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]


def _land(spark: SparkSession, folder: str, path: str, second: bool) -> None:
    """The lines before the cut, or those after it and once more the last weeks before it, as CSV files."""
    lines = retail_lines(spark, folder, LANDED)
    day = F.col("InvoiceDate").cast("date")
    again = day.between(F.date_sub(F.lit(CUT).cast("date"), 20), F.date_sub(F.lit(CUT).cast("date"), 1))
    part = (day >= CUT) | again if second else day < CUT
    text = lines.where(part).withColumn("InvoiceDate", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))
    text.write.mode("append").option("header", True).option("escape", '"').csv(path)


@register(
    "stream_clean_lines",
    f"""WITH {SALES} SELECT DISTINCT InvoiceNo, StockCode, Quantity, CAST(InvoiceDate AS DATE) AS day, CustomerID, Country,
    CAST(TotalPrice AS DOUBLE) AS TotalPrice, CAST(quarter(InvoiceDate) AS INT) AS OrderQuarter FROM sales""",
)
def _stream_clean_lines(spark, folder):
    """Files land twice, some lines in both; the job is stopped between and restarted from its checkpoint."""
    root = staging_dir(spark)
    for second in (False, True):
        _land(spark, folder, f"{root}/landing", second)
        lines = line_stream.processed_stream(line_stream.landing_stream(spark, f"{root}/landing"))
        line_stream.write_stream(line_stream.without_copies(lines, by=LANDED), f"{root}/lines", f"{root}/marks").awaitTermination()
    lines = _cents(spark.read.parquet(f"{root}/lines"), "TotalPrice")
    return lines.select(
        "InvoiceNo", "StockCode", F.col("Quantity").cast("double").alias("Quantity"), F.col("InvoiceDate").cast("date").alias("day"),
        "CustomerID", "Country", F.col("TotalPrice").cast("double").alias("TotalPrice"), "OrderQuarter")


@register(
    "stream_stock",
    f"""WITH {LINES}, twice AS (SELECT * FROM lines UNION ALL SELECT * FROM lines
      WHERE CAST(InvoiceDate AS DATE) BETWEEN DATE '{CUT}' - 20 AND DATE '{CUT}' - 1),
    {STOCK.replace("FROM lines", "FROM twice")} SELECT * FROM stock""",
)
def _stream_stock(spark, folder):
    """Stock per product after two landings, each brought in by a run of its own; every landed line counts."""
    root = staging_dir(spark)
    for second in (False, True):
        _land(spark, folder, f"{root}/landing", second)
        landed = line_stream.landing_stream(spark, f"{root}/landing")
        total_stream.keep_totals(inventory.stock_estimate(landed), f"{root}/stock", f"{root}/marks").awaitTermination()
    return total_stream.current_totals(spark, f"{root}/stock", ["StockCode"])


@register(
    "month_rewritten",
    f"""WITH {SALES} SELECT year(InvoiceDate) AS OrderYear, month(InvoiceDate) AS OrderMonth, COUNT(*) AS n,
    CAST(SUM(CASE WHEN year(InvoiceDate) = 1996 AND month(InvoiceDate) = 3 THEN 2 ELSE 1 END * TotalPrice) AS DOUBLE) AS total
    FROM sales GROUP BY 1, 2""",
)
def _month_rewritten(spark, folder):
    """A table by month of which March 1996 is written again, twice, at double prices; all other months stay."""
    path = f"{staging_dir(spark)}/sales.parquet"
    sales = _sales(spark, folder, "InvoiceNo")
    write_table(sales, path)
    march = sales.where("OrderYear = 1996 AND OrderMonth = 3").withColumn("TotalPrice", (F.col("TotalPrice") * 2).cast("decimal(18,2)"))
    for _ in range(2):
        write_table(march, path, only_these_months=True)
    found = spark.read.parquet(path).groupBy(F.col("OrderYear").cast("long").alias("OrderYear"), F.col("OrderMonth").cast("long").alias("OrderMonth"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("TotalPrice").cast("double").alias("total"))


@register(
    "json_variants",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
    CASE WHEN event_type = 'click' THEN user_id END AS user_id, event_type = 'error' AS rejected FROM events""",
)
def _json_variants(spark, folder):
    """Two shapes of records, flat and nested, and broken ones that come back apart."""
    nested = F.concat(F.lit('{"v": 2, "data": '), F.col("props"), F.lit(', "by": {"user": '), F.col("user_id").cast("string"), F.lit("}}"))
    broken = F.replace("props", F.lit("}"), F.lit(""))
    text = F.when(F.col("event_type") == "error", broken).when(F.col("event_type") == "click", nested).otherwise(F.col("props"))
    records = table(spark, folder, "events").select("event_id", text.alias("payload"))
    good, bad = parse_variants(records, "payload", {"k": ("$.k|$.data.k", "bigint"), "user_id": ("$.by.user", "bigint")})
    columns = ["event_id", "k", "user_id", "rejected"]
    missing = F.lit(None).cast("bigint")
    return good.withColumn("rejected", F.lit(False)).select(columns).unionByName(
        bad.select("event_id", missing.alias("k"), missing.alias("user_id"), F.lit(True).alias("rejected")))


@register(
    "merged_figures",
    f"""WITH {SALES} SELECT COUNT(*) AS records, CAST(SUM(TotalPrice) AS DOUBLE) AS revenue, CAST(MIN(InvoiceDate) AS DATE) AS first_date,
    CAST(MAX(InvoiceDate) AS DATE) AS last_date, COUNT(DISTINCT InvoiceNo) > 0 AS as_other_parts,
    COUNT(DISTINCT StockCode) > 0 AS close FROM sales WHERE year(InvoiceDate) BETWEEN 1994 AND 1995""",
)
def _merged_figures(spark, folder):
    """Two years of stored monthly sketches merged, beside the same lines sketched in other parts and the exact counts."""
    sales = _sales(spark, folder, "InvoiceNo", "StockCode", "CustomerID")
    path = f"{staging_dir(spark)}/sketches.parquet"
    totals.figure_sketches(sales).write.parquet(path)
    some = F.year("month").between(1994, 1995)
    merged = totals.merged_figures(spark.read.parquet(path).where(some))
    period = sales.where(F.year("InvoiceDate").between(1994, 1995))
    exact = totals.headline_figures(period)
    quarters = period.withColumn("InvoiceDate", F.date_trunc("quarter", "InvoiceDate"))
    other = totals.merged_figures(totals.figure_sketches(quarters))
    names = ["invoices", "known_customers", "products"]
    both = merged.crossJoin(F.broadcast(other.select(*[F.col(n).alias(f"{n}_other") for n in names]))).crossJoin(
        F.broadcast(exact.select(*[F.col(n).alias(f"{n}_exact") for n in names])))
    same, close = F.lit(True), F.lit(True)
    for n in names:
        # five standard errors of the sketch; other parts give the same registers, but the order may pick another estimator
        bound = 5 * 0.0082 * F.col(f"{n}_exact")
        same = same & (F.abs(F.col(n) - F.col(f"{n}_other")) <= bound)
        close = close & (F.abs(F.col(n) - F.col(f"{n}_exact")) <= bound)
    return both.select("records", F.col("revenue").cast("double").alias("revenue"), "first_date", "last_date",
                       same.alias("as_other_parts"), close.alias("close"))
