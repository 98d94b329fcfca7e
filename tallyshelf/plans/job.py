"""The batch report as a job: files in, processed table and report tables out.

    spark-submit --py-files tallyshelf.zip -m tallyshelf.plans.job <input> <output folder>
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyshelf.operators.cleaning import CleaningAudit, CleaningRules, clean
from tallyshelf.operators.features import add_features
from tallyshelf.plans.report import headline_texts, sales_report
from tallyshelf.session import build_session, ship_package
from tallyshelf.sources.files import read_lines
from tallyshelf.sources.paths import processed_path
from tallyshelf.sources.sinks import write_table


@dataclass
class ReportRun:
    processed_path: str
    audit: dict[str, int]
    table_paths: dict[str, str]
    headline: DataFrame


def run_report(
    spark: SparkSession, source: str, out: str, rules: CleaningRules = CleaningRules(), *, file_format: str | None = None
) -> ReportRun:
    """Clean and transform once, store the result, and build every report table from the stored copy."""
    ship_package(spark)
    audit = CleaningAudit.new()
    path = f"{out.rstrip('/')}/{processed_path(source).rsplit('/', 1)[-1]}"
    write_table(add_features(clean(read_lines(spark, source, file_format=file_format), rules, audit)), path)
    processed = spark.read.parquet(path)
    tables = {}
    for name, df in sales_report(processed).items():
        tables[name] = f"{out.rstrip('/')}/tables/{name}"
        df.write.mode("overwrite").parquet(tables[name])
    return ReportRun(path, audit.counts(), tables, headline_texts(processed))


def main() -> None:
    run = run_report(build_session("sales report"), *sys.argv[1:3])
    print(run.processed_path)
    print(run.audit)
    run.headline.show(truncate=False, vertical=True)


if __name__ == "__main__":
    main()
