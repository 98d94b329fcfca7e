"""What the plans must look like to hold up on large tables."""

import pytest

from tallyshelf.operators import cleaning, inventory, totals
from tallyshelf.operators.decomposition import decompose
from tallyshelf.operators.series import resample
from tallyshelf.plans.catalog import CATALOG
from tallyshelf.sources.star import retail_lines, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    lines = table(spark, data, "lineitem").selectExpr("cast(l_partkey as string) AS StockCode", "l_quantity AS Quantity")
    text = plan(totals.total_sold(lines))
    assert "GreaterThan(l_quantity,0.0)" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in text
    full = plan(cleaning.clean(retail_lines(spark, data)))
    assert "GreaterThan(p_retailprice,0.0)" in full and "l_extendedprice" not in full


def test_stock_needs_one_shuffle_and_no_sort(spark, data):
    text = plan(inventory.lowest_stock(inventory.stock_estimate(retail_lines(spark, data, ["StockCode", "Quantity"]))))
    assert text.count("Exchange") == 1 and "TakeOrderedAndProject" in text and "Join" not in text


def test_decomposition_shuffles_once_per_series(spark, data):
    months = resample(table(spark, data, "orders"), "o_orderdate", {"value": ("o_totalprice", "sum")}, "MS", ["o_orderpriority"])
    before = plan(months).count("Exchange")
    assert plan(decompose(months, "value", 12, by=["o_orderpriority"])).count("Exchange") == before


def test_quantiles_move_only_counts(spark, data):
    text = plan(cleaning.winsorize(table(spark, data, "events"), ["value"]))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text and "rangepartitioning" not in text
    # the values themselves are only exchanged once they lie in a fine bin
    assert all("_cell" in line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_v#" in line)


@pytest.mark.parametrize("name", ["resample_ms", "aggregates_by_name"])
def test_first_and_last_need_no_sort_of_the_rows(spark, data, name):
    assert "SortAggregate" not in plan(CATALOG[name].run(spark, data))


def test_figures_and_correlations_copy_no_row(spark, data):
    assert "Expand" not in plan(CATALOG["kpis"].run(spark, data))
    assert "Generate" not in plan(CATALOG["corr_matrix"].run(spark, data)).split("HashAggregate")[-1]


@pytest.mark.parametrize("name", ["total_sold", "kpis", "resample_ms", "decompose_panel", "corr_matrix", "histogram", "winsorize_value", "pie_other"])
def test_hot_path_stays_in_the_jvm(spark, data, name):
    text = plan(CATALOG[name].run(spark, data))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text
