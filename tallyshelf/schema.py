"""Column names, types and type discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
ROW_ID = "_row_id"
UNKNOWN_CUSTOMER = "UNKNOWN"

# Types after ingest. Quantity is a double because capping puts fractions in it and
# text files write whole numbers as 6 or 6.0 alike; whole numbers stay exact to 2^53.
RETAIL_TYPES: dict[str, T.DataType] = {
    "InvoiceNo": T.StringType(),
    "StockCode": T.StringType(),
    "Description": T.StringType(),
    "Quantity": T.DoubleType(),
    "InvoiceDate": T.TimestampNTZType(),
    "UnitPrice": T.DoubleType(),
    "CustomerID": T.StringType(),
    "Country": T.StringType(),
}
RETAIL_COLUMNS = list(RETAIL_TYPES)
RAW_RETAIL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RETAIL_COLUMNS])


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def require_kind(df: DataFrame, name: str, kind: str) -> None:
    require_columns(df, name)
    found = kind_of(df.schema[name].dataType)
    if found != kind:
        raise ValueError(f"column {name!r} must be {kind}, found {found}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing marker only: NaN compares as the largest number in Spark."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats})
