"""Estimated stock per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.operators.cleaning import search
from tallyshelf.operators.totals import top, valid_key
from tallyshelf.schema import columns_of_kind, require_columns, require_kind

STOCK = "EstimatedCurrentStock"


def choose_columns(df: DataFrame) -> tuple[str, str]:
    """Product key (StockCode, else Description, else the first text column) and quantity column."""
    texts, numbers = columns_of_kind(df, "string"), columns_of_kind(df, "numeric")
    if not texts or not numbers:
        raise ValueError("the table needs a text column for the product and a numeric one for the quantity")
    product = next((c for c in ("StockCode", "Description") if c in texts), texts[0])
    return product, "Quantity" if "Quantity" in numbers else numbers[0]


def stock_estimate(
    df: DataFrame,
    product: str = "StockCode",
    quantity: str = "Quantity",
    initial_stock: int = 1000,
    opening: DataFrame | None = None,
) -> DataFrame:
    """Opening stock minus units sold, for every product that occurs, sold or not.

    One aggregate does it: products without a positive quantity sum to nothing and get 0, so
    no join of the product list with the sales is needed. ``opening`` (product, OpeningStock)
    replaces the common opening stock for the products it lists.
    """
    if initial_stock < 0:
        raise ValueError("initial_stock must not be negative")
    require_columns(df, product)
    require_kind(df, quantity, "numeric")
    sold = F.sum(F.when(F.col(quantity) > 0, F.col(quantity)))
    stock = (
        df.where(valid_key(df, product))
        .groupBy(product)
        .agg(F.coalesce(sold.cast("long"), F.lit(0).cast("long")).alias("TotalSold"))
    )
    start = F.lit(initial_stock).cast("long")
    if opening is not None:
        # several rows of one product add up
        opening = opening.groupBy(product).agg(F.sum("OpeningStock").alias("OpeningStock"))
        stock = stock.join(opening, product, "left")
        start = F.coalesce(F.col("OpeningStock").cast("long"), start)
    return stock.select(product, "TotalSold", (start - F.col("TotalSold")).alias(STOCK))


def all_stock(stock: DataFrame, product: str = "StockCode") -> DataFrame:
    return stock.orderBy(STOCK, product)


def lowest_stock(stock: DataFrame, n: int = 10, product: str = "StockCode") -> DataFrame:
    return top(stock, STOCK, n, product, smallest=True)


def highest_stock(stock: DataFrame, n: int = 10, product: str = "StockCode") -> DataFrame:
    return top(stock, STOCK, n, product)


def lowest_stock_chart(stock: DataFrame, n: int = 10, product: str = "StockCode") -> DataFrame:
    """The same products as :func:`lowest_stock`, fullest first."""
    return lowest_stock(stock, n, product).orderBy(F.desc(STOCK), product)


def find_stock(stock: DataFrame, term: str, product: str = "StockCode", *, literal: bool = False) -> DataFrame:
    return search(stock, product, term, literal=literal)
