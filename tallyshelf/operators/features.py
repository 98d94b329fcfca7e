"""Derived columns of cleaned lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions.scalar import date_parts, starts_cancelled
from tallyshelf.schema import kind_of


def add_features(df: DataFrame) -> DataFrame:
    """TotalPrice, the seven date parts and IsCancelled, each only where its inputs exist."""
    have = set(df.columns)
    added: dict[str, Column] = {}
    if {"Quantity", "UnitPrice"} <= have:
        added["TotalPrice"] = F.col("Quantity") * F.col("UnitPrice")
    if "InvoiceDate" in have and kind_of(df.schema["InvoiceDate"].dataType) == "datetime":
        added |= date_parts(F.col("InvoiceDate"))
    if "InvoiceNo" in have:
        added["InvoiceNo"] = F.col("InvoiceNo").cast("string")
        added["IsCancelled"] = starts_cancelled(F.col("InvoiceNo"))
    if "CustomerID" in have:
        added["CustomerID"] = F.col("CustomerID").cast("string")
    return df.withColumns(added) if added else df
