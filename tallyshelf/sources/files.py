"""Invoice-line files: CSV folders and parquet into typed retail lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.functions.scalar import parse_timestamp
from tallyshelf.schema import CORRUPT, RETAIL_TYPES, nan_to_null
from tallyshelf.sources.paths import extension

# Cell texts that mean "missing" in a CSV file.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _reader(spark: SparkSession, multiline: bool) -> DataFrameReader:
    # enforceSchema off: a file whose header is not the expected one fails instead of being read by position
    return spark.read.options(header=True, mode="PERMISSIVE", escape='"', multiLine=multiline, enforceSchema=False)


def _headers(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files of a path in groups that share their first line; a pass over the raw lines finds these."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = lines.where("at = 0").withColumn("id", F.monotonically_increasing_id())
    headers = first.groupBy("file").agg(F.min_by("value", "id").alias("header"))
    # the driver lists the files of every scan anyway
    return [r["files"] for r in headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()]


def read_csv(
    spark: SparkSession, path: str | list[str], *, multiline: bool = False, keep_corrupt: bool = False, infer: bool = False,
    by_name: bool = False,
) -> DataFrame:
    """CSV with a header; every column is text unless ``infer`` asks for a type-inference pass.

    All files must have the same header, else the read fails. ``by_name`` takes files with different headers: columns
    are matched by their trimmed names, and a column that a file lacks is missing in its rows; it costs one more pass
    over the lines. ``multiline`` allows line breaks inside quotes at the price of unsplittable files.
    ``keep_corrupt`` adds a column with the raw text of lines of the wrong width (see ``split_rejects``).
    """
    if by_name:
        tables = [trim_headers(read_csv(spark, files, multiline=multiline, keep_corrupt=keep_corrupt, infer=infer)) for files in _headers(spark, path)]
        found = tables[0]
        for more in tables[1:]:
            found = found.unionByName(more, allowMissingColumns=True)
        return found
    reader = _reader(spark, multiline)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    # without inference only the header line is looked at
    header = reader.csv(path).schema
    if keep_corrupt:
        schema = T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())])
        df = reader.schema(schema).option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    else:
        df = reader.schema(header).csv(path)
    return df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(*MISSING_TEXTS), F.col(f"`{c}`")) for c in header.names}
    )


def read_csv_with_rejects(spark: SparkSession, path: str | list[str], *, multiline: bool = False, by_name: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows, and the raw text of the lines of the wrong width."""
    return split_rejects(read_csv(spark, path, multiline=multiline, by_name=by_name, keep_corrupt=True))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and rows that did not (those keep their raw text)."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    # A line is only known to be broken when all its columns are parsed: without this always-true
    # look at them, a count would prune them and see no broken lines (or be refused)
    present = F.hash(*[F.col(f"`{c}`") for c in df.columns if c != CORRUPT]) >= -(2**31)
    bad = F.col(CORRUPT).isNotNull()
    return df.where(~bad & present).drop(CORRUPT), df.where(bad & present)


def trim_headers(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns {twice} appear more than once after trimming")
    return df.toDF(*names)


def type_columns(df: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """Cast the known retail columns that arrived as text; cells that do not fit become null.

    CustomerID keeps its type: the cleaning step turns doubles and text into the same key.
    """
    df = trim_headers(df)
    casts = {}
    for name, wanted in RETAIL_TYPES.items():
        if name not in df.columns or name == "CustomerID":
            continue
        found = df.schema[name].dataType
        if isinstance(wanted, T.TimestampNTZType):
            casts[name] = parse_timestamp(F.col(name), found, date_formats)
        elif isinstance(wanted, T.DoubleType):
            casts[name] = F.col(name).try_cast(wanted)
    return nan_to_null(df.withColumns(casts) if casts else df)


def read_lines(
    spark: SparkSession, path: str, *, file_format: str | None = None, date_formats: Sequence[str] = (), **options
) -> DataFrame:
    """Invoice lines from ``.csv`` or ``.parquet`` paths, folders and globs.

    The format follows the extension; a folder without one needs ``file_format``. CSV lines with more or fewer cells
    than the header lose or lack the rest here; ``read_lines_with_rejects`` returns them apart.
    """
    file_format = file_format or extension(path)
    if file_format == "csv":
        return type_columns(read_csv(spark, path, **options), date_formats)
    if file_format == "parquet":
        return type_columns(spark.read.parquet(path), date_formats)
    raise ValueError(f"unsupported input format {file_format!r}: use csv or parquet")


def read_lines_with_rejects(spark: SparkSession, path: str, *, date_formats: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """Typed invoice lines of CSV files, columns matched by name, and the raw text of the lines of the wrong width."""
    good, rejects = read_csv_with_rejects(spark, path, **options)
    return type_columns(good, date_formats), rejects.select(CORRUPT)


def keep_raw(spark: SparkSession, path: str, raw_path: str) -> None:
    """Store the payload as it came, line by line, next to the parsed table."""
    spark.read.text(path).write.mode("overwrite").text(raw_path)
