"""What the physical plans must and must not contain, for every registered query."""

import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from checks.registry import ORACLES, QUERIES
from orderlens.operators.frames import between_years
from orderlens.sources import star

SF = "/root/testdata/sf0.001"
FORBIDDEN = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
    "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [word for word in FORBIDDEN if word in text]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_only_needed_columns_and_tables_are_read(spark):
    text = plan(star.sales(spark, SF, ["quantity", "product_id"]))
    assert "orders.parquet" not in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in text


def test_year_filter_reaches_the_scan(spark):
    lines = star.sales(spark, SF, ["order_year", "final_amount"], years=(1996, 1997))
    pushed = [p.split("]")[0] for p in plan(lines).split("PushedFilters: [")[1:]]
    assert any(
        "GreaterThanOrEqual(o_orderdate,1996-01-01" in p and "LessThan(o_orderdate,1998-01-01" in p
        for p in pushed
    )
    wanted = between_years(star.sales(spark, SF, ["order_year", "final_amount"]), 1996, 1997)
    assert lines.count() == wanted.count() > 0


def test_festival_lift_joins_on_the_day(spark):
    text = plan(QUERIES["festival_lift"](spark, SF))
    assert "BroadcastHashJoin [order_date" in text or "SortMergeJoin [order_date" in text


def test_rank_scores_do_not_sort_all_customers_in_one_task(spark):
    """Windows without a partition may only see the few rows left after counting buckets."""
    text = plan(QUERIES["rfm_dashboard_table"](spark, SF))
    main = text.split("Subquery")[0]
    assert "Window" not in main and "SinglePartition" not in main
