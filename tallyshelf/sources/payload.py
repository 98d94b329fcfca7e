"""JSON payloads landed by a fetch job: lists of records, or one object per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.schema import CORRUPT
from tallyshelf.sources.files import read_csv_with_rejects, split_rejects


def read_records(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Records and rejects: a list gives one row per element, an object one row, anything else a reject.

    Pass the schema when it is known; without it Spark reads the files once more to infer it.
    """
    reader = spark.read.option("multiLine", multiline).option("columnNameOfCorruptRecord", CORRUPT)
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    df = reader.json(path)
    if df.columns == [CORRUPT]:
        # nothing parsed: Spark will not scan a file for the corrupt column alone
        return df.limit(0).drop(CORRUPT), spark.read.text(path, wholetext=True).toDF(CORRUPT)
    return split_rejects(df)


def read_payload(
    spark: SparkSession, path: str, file_format: str = "csv", schema: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """Table and rejects from a landed payload of the given format."""
    name = file_format.lower()
    if name == "csv":
        return read_csv_with_rejects(spark, path)
    if name == "json":
        return read_records(spark, path, schema)
    raise ValueError(f"unsupported payload format {file_format!r}: use csv or json")


def parse_variants(
    df: DataFrame, column: str, fields: dict[str, tuple[str, str]], extra: str = "_record"
) -> tuple[DataFrame, DataFrame]:
    """Records of drifting shapes in a text column, without a pass that infers a schema.

    ``fields`` maps a column name to (path in the record, type): what a record lacks, or holds as something that does not
    convert, is null. Fields of different shapes are found by separate paths, the first that gives a value wins (``"$.a|$.b.a"``).
    ``extra`` is the whole record as VARIANT, so nothing of it is lost. Rows that are no JSON come back apart; null stays a
    row without fields.
    """
    parsed = df.withColumn(extra, F.try_parse_json(column))

    def field(paths: str, kind: str) -> Column:
        return F.coalesce(*[F.try_variant_get(extra, path, kind) for path in paths.split("|")])

    bad = F.col(column).isNotNull() & F.col(extra).isNull()
    good = parsed.where(~bad).select(*df.columns, *[field(*f).alias(name) for name, f in fields.items()], extra)
    return good, parsed.where(bad).select(*df.columns)


def parse_objects(df: DataFrame, column: str | Column, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parse a text column that holds one JSON object per row; unparsable rows come back apart."""
    text = F.col(column) if isinstance(column, str) else column
    full = f"{schema}, {CORRUPT} string"
    parsed = df.withColumn("_json", F.from_json(text, full, {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("_json").isNull() | F.col(f"_json.{CORRUPT}").isNotNull()
    good = parsed.where(~bad).select(*df.columns, "_json.*").drop(CORRUPT)
    return good, parsed.where(bad).select(*df.columns)
