"""Cleaning of invoice lines, with the reason of every dropped row.

The order of the rules is part of the result: date, description, stock code, quantity, price,
then capping on what is left, then removal of exact copies of the capped rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyshelf.functions.quantiles import approximate_quantiles, quantiles
from tallyshelf.functions.scalar import as_text, customer_text, matches_term, parse_timestamp, strip_text
from tallyshelf.schema import ROW_ID, UNKNOWN_CUSTOMER, kind_of, nan_to_null, require_columns
from tallyshelf.sources.files import trim_headers

REASON = "_dropped_by"
REASONS = ("bad_date", "no_description", "no_stock_code", "quantity_not_positive", "price_not_positive")


@dataclass(frozen=True)
class CleaningRules:
    remove_cancelled_orders: bool = True
    remove_zero_unit_price: bool = True
    cap_quantity: bool = False
    cap_unit_price: bool = False
    # fences from exact quartiles, or from one mergeable sketch
    exact_caps: bool = True
    # "drop" removes lines without description or stock code; "nan" keeps them under that text
    missing_text: str = "drop"
    # patterns for dates held as text, tried in order; none: the layouts of parse_timestamp
    date_formats: tuple[str, ...] = ()


def _typed(df: DataFrame, rules: CleaningRules) -> DataFrame:
    """Parsed dates, numbers as numbers, one missing marker."""
    types = {f.name: f.dataType for f in df.schema.fields}
    steps: dict[str, Column] = {}
    if "InvoiceDate" in types:
        steps["InvoiceDate"] = parse_timestamp(F.col("InvoiceDate"), types["InvoiceDate"], rules.date_formats)
    steps |= {c: _number(c, types) for c in ("Quantity", "UnitPrice") if c in types and kind_of(types[c]) == "string"}
    return nan_to_null(df.withColumns(steps) if steps else df)


def _number(name: str, types: dict) -> Column:
    return F.col(name).try_cast("double") if kind_of(types[name]) == "string" else F.col(name)


def _keep_rules(df: DataFrame, rules: CleaningRules) -> list[tuple[str, Column]]:
    """(reason for dropping, condition for keeping) in rule order, on columns as they were read.

    Conditions on raw columns can be pushed to the scan, each to the table its column comes from.
    """
    if rules.missing_text not in ("drop", "nan"):
        raise ValueError("missing_text must be 'drop' or 'nan'")
    types = {f.name: f.dataType for f in df.schema.fields}
    keep: list[tuple[str, Column]] = []
    if "InvoiceDate" in types:
        keep.append(("bad_date", parse_timestamp(F.col("InvoiceDate"), types["InvoiceDate"], rules.date_formats).isNotNull()))
    if rules.missing_text == "drop":
        for reason, name in (("no_description", "Description"), ("no_stock_code", "StockCode")):
            if name in types:
                keep.append((reason, F.col(name).isNotNull()))
    if {"Quantity", "UnitPrice"} <= set(types):
        switches = (
            ("quantity_not_positive", "Quantity", rules.remove_cancelled_orders),
            ("price_not_positive", "UnitPrice", rules.remove_zero_unit_price),
        )
        for reason, name, on in switches:
            if on:
                number = _number(name, types)
                # NaN counts as larger than any number
                keep.append((reason, (number > 0) & ~F.isnan(number)))
    return keep


def _tidy_texts(df: DataFrame, rules: CleaningRules) -> DataFrame:
    """Customer keys and stripped texts."""
    types = {f.name: f.dataType for f in df.schema.fields}
    steps: dict[str, Column] = {}
    if "CustomerID" in types:
        steps["CustomerID"] = customer_text(F.col("CustomerID"), types["CustomerID"])
    for name in ("Description", "StockCode"):
        if name in types:
            text = strip_text(as_text(F.col(name), types[name]))
            steps[name] = F.coalesce(text, F.lit("nan")) if rules.missing_text == "nan" else text
    return df.withColumns(steps) if steps else df


def mark_drops(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Typed rows with the name of the first rule they break (null: the row stays)."""
    df = trim_headers(df)
    reason = F.lit(None).cast("string")
    for name, keep in reversed(_keep_rules(df, rules)):
        reason = F.when(F.coalesce(keep, F.lit(False)), reason).otherwise(name)
    return _typed(df.withColumn(REASON, reason), rules)


def apply_row_rules(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Everything that looks at one row at a time; also valid on a streaming DataFrame."""
    df = trim_headers(df)
    for _, keep in _keep_rules(df, rules):
        df = df.where(keep)
    return _tidy_texts(_typed(df, rules), rules)


def rejected_rows(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """The dropped rows with the reason why."""
    return _tidy_texts(mark_drops(df, rules).where(F.col(REASON).isNotNull()), rules)


def iqr_bounds(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, *, exact: bool = True) -> DataFrame:
    """One row: a struct(lo, hi) per column, from the quartiles of the non-missing values."""
    quartiles = (quantiles if exact else approximate_quantiles)(df, columns, (0.25, 0.75))
    q1, q3 = (lambda c: F.col(c)[0]), (lambda c: F.col(c)[1])
    return quartiles.select(
        *[
            F.struct(
                (q1(c) - multiplier * (q3(c) - q1(c))).alias("lo"), (q3(c) + multiplier * (q3(c) - q1(c))).alias("hi")
            ).alias(c)
            for c in columns
        ]
    )


def winsorize(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, *, exact: bool = True) -> DataFrame:
    """Pull values outside the quartile fences back to the fence; missing values stay missing.

    Absent and non-numeric columns are left alone. The fences are a scalar subquery: one row,
    computed once and shared by all references.
    """
    columns = [c for c in columns if c in df.columns and kind_of(df.schema[c].dataType) == "numeric"]
    if not columns:
        return df
    met = df.withColumn("_fence", _fences(df, columns, multiplier, exact).scalar())

    def capped(c: str) -> Column:
        value = F.col(c).cast("double")
        # least and greatest skip nulls, a missing value must not
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.col(f"_fence.{c}.lo")), F.col(f"_fence.{c}.hi")))

    return met.withColumns({c: capped(c) for c in columns}).drop("_fence")


def _fences(df: DataFrame, columns: Sequence[str], multiplier: float, exact: bool) -> DataFrame:
    return iqr_bounds(df, columns, multiplier, exact=exact).select(F.struct(*columns).alias("_fence"))


def outlier_counts(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, *, exact: bool = True) -> DataFrame:
    """Per column: the fences and how many values lie below and above them."""
    fences = _fences(df, columns, multiplier, exact)
    beyond = df.withColumn("_fence", fences.scalar()).select(
        *[(F.col(c) < F.col(f"_fence.{c}.lo")).alias(f"{c}_below") for c in columns],
        *[(F.col(c) > F.col(f"_fence.{c}.hi")).alias(f"{c}_above") for c in columns],
    )
    counted = beyond.agg(*[F.count_if(F.col(flag)).alias(flag) for flag in beyond.columns]).withColumn("_fence", fences.scalar())
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"_fence.{c}.lo").alias("lower"), F.col(f"_fence.{c}.hi").alias("upper"),
            F.col(f"{c}_below").alias("n_below"), F.col(f"{c}_above").alias("n_above"),
        )
        for c in columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def at_most_quantile(df: DataFrame, column: str, prob: float = 0.99, *, exact: bool = True) -> DataFrame:
    """Rows whose value does not exceed the given quantile of the column."""
    require_columns(df, column)
    limit = (quantiles if exact else approximate_quantiles)(df, [column], [prob]).select(F.col(column)[0])
    return df.where(F.col(column) <= limit.scalar())


def drop_copies(df: DataFrame) -> DataFrame:
    """Exact copies removed; when rows carry an id the smallest id of each copy is kept."""
    if ROW_ID not in df.columns:
        return df.dropDuplicates()
    rest = [c for c in df.columns if c != ROW_ID]
    return df.groupBy(*rest).agg(F.min(ROW_ID).alias(ROW_ID))


@dataclass
class CleaningAudit:
    """Counters filled while a cleaned table is computed; no scan of their own."""

    rows: Observation
    final: Observation

    @classmethod
    def new(cls) -> CleaningAudit:
        return cls(Observation(), Observation())

    def counts(self) -> dict[str, int]:
        """Available after the first action on the cleaned table."""
        first, last = self.rows.get, self.final.get
        return {**first, "rows_out": last["rows_out"], "copies": first["rows_kept"] - last["rows_out"]}


def clean(df: DataFrame, rules: CleaningRules = CleaningRules(), audit: CleaningAudit | None = None) -> DataFrame:
    """The whole cleaning: row rules, capping, removal of copies."""
    if audit:
        marked = mark_drops(df, rules)
        marked = marked.observe(audit.rows, *audit_counters(marked))
        kept = _tidy_texts(marked.where(F.col(REASON).isNull()).drop(REASON), rules)
    else:
        kept = apply_row_rules(df, rules)
    capped = [
        c for c, on in (("Quantity", rules.cap_quantity), ("UnitPrice", rules.cap_unit_price)) if on
    ]
    if capped and {"Quantity", "UnitPrice"} <= set(kept.columns):
        kept = winsorize(kept, capped, exact=rules.exact_caps)
    cleaned = drop_copies(kept)
    return cleaned.observe(audit.final, F.count(F.lit(1)).alias("rows_out")) if audit else cleaned


def audit_counters(marked: DataFrame) -> list[Column]:
    counters = [F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col(REASON).isNull()).alias("rows_kept")]
    counters += [F.count_if(F.col(REASON) == r).alias(r) for r in REASONS]
    if "CustomerID" in marked.columns:
        key = customer_text(F.col("CustomerID"), marked.schema["CustomerID"].dataType)
        counters.append(F.count_if(key == UNKNOWN_CUSTOMER).alias("unknown_customers"))
    return counters


def cleaning_report(df: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """The row-rule counters as a one-row table, from one aggregate over the raw rows."""
    marked = mark_drops(df, rules)
    return marked.agg(*audit_counters(marked))


def search(df: DataFrame, column: str, term: str, *, literal: bool = False) -> DataFrame:
    """Rows whose text matches; an empty term lists nothing."""
    require_columns(df, column)
    if not term:
        return df.limit(0)
    return df.where(matches_term(F.col(column), term, literal))
