"""Invoice lines assembled from an order star schema (lineitem, orders, part, customer, nation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.schema import RETAIL_COLUMNS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_lines(spark: SparkSession, folder: str, columns: Sequence[str] = RETAIL_COLUMNS) -> DataFrame:
    """The asked-for retail columns; only the tables they live in are joined.

    Dimensions are left-joined, so a line is never lost to a missing dimension row, and the
    optimizer broadcasts a dimension only when its measured size allows it.
    """
    wanted = set(columns)
    lines = table(spark, folder, "lineitem")
    returned = F.col("l_returnflag") == "R"
    source = {
        "InvoiceNo": F.concat(F.when(returned, "C").otherwise(""), F.col("l_orderkey").cast("string")),
        "StockCode": F.col("l_partkey").cast("string"),
        "Quantity": F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")),
        "Description": F.col("p_name"),
        "UnitPrice": F.col("p_retailprice"),
        "InvoiceDate": F.col("o_orderdate"),
        "CustomerID": F.col("o_custkey").cast("string"),
        "Country": F.col("n_name"),
    }
    if wanted & {"InvoiceDate", "CustomerID", "Country"}:
        orders = table(spark, folder, "orders")
        if "Country" in wanted:
            customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
            nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
            homes = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            orders = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"), "left")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if wanted & {"Description", "UnitPrice"}:
        lines = lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.select(*[source[c].alias(c) for c in columns])
