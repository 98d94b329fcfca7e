"""Every registered query with an SQL equivalent agrees with it on the small tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare
from tallyshelf.plans.catalog import CATALOG

SLOW = {"rf_forecast", "rf_metrics"}


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [n for n in CATALOG if n not in SLOW])
def test_query(spark, con, data, name):
    verdict, n, _ = compare(spark, con, name, data)
    assert verdict in ("match", "rows only")
    assert n > 0 or name in oracle_sql()


def test_entry(spark, data):
    assert entry(spark).columns == ["StockCode", "TotalSold", "EstimatedCurrentStock"]
    assert set(oracle_sql()) <= set(queries())
