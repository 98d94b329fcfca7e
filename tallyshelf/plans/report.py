"""The sales report over one cleaned and transformed table: every table the report shows, lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.scalar import day_text, money_text
from tallyshelf.operators.charts import density_curve, histogram
from tallyshelf.operators.cleaning import CleaningRules, at_most_quantile, clean
from tallyshelf.operators.features import add_features
from tallyshelf.operators.totals import correlation_matrix, headline_figures, monthly_sales, top_by_sum
from tallyshelf.schema import kind_of

CORRELATED = ["Quantity", "UnitPrice", "TotalPrice", "OrderYear", "OrderMonth", "OrderDay", "OrderHour"]


def processed_lines(raw: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    return add_features(clean(raw, rules))


def headline_texts(df: DataFrame) -> DataFrame:
    """The headline figures as the texts the report prints."""
    best = top_by_sum(df, "Country", "TotalPrice", 1)
    country = best.select(F.struct("Country", money_text(F.col("TotalPrice")).alias("sales"))).scalar()
    return headline_figures(df).select(
        "records", "features", money_text(F.col("revenue")).alias("revenue"),
        "invoices", "known_customers", "products",
        day_text(F.col("first_date")).alias("first_date"), day_text(F.col("last_date")).alias("last_date"),
        country["Country"].alias("best_country"), country["sales"].alias("best_country_sales"),
    )


def sales_report(df: DataFrame) -> dict[str, DataFrame]:
    """Tables of the report, by name; each appears only when its columns do.

    ``df`` is read once per table: pass a stored (parquet) table, not a long plan.
    """
    have = set(df.columns)
    tables: dict[str, DataFrame] = {}
    for column in ("Quantity", "UnitPrice", "TotalPrice"):
        if column in have:
            inner = at_most_quantile(df, column, 0.99)
            tables[f"{column}_histogram"] = histogram(inner, column)
            tables[f"{column}_density"] = density_curve(inner, column)
    if {"InvoiceDate", "TotalPrice"} <= have:
        tables["monthly_sales"] = monthly_sales(df)
    if {"Country", "TotalPrice"} <= have:
        tables["top_countries"] = top_by_sum(df, "Country", "TotalPrice", 10)
    if {"Description", "Quantity"} <= have:
        tables["top_products"] = top_by_sum(df, "Description", "Quantity", 10)
    numeric = [c for c in CORRELATED if c in have and kind_of(df.schema[c].dataType) == "numeric"]
    if len(numeric) > 1:
        tables["correlations"] = correlation_matrix(df, numeric)
    tables["headline"] = headline_figures(df)
    return tables
