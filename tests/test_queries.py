"""Registered queries against their SQL on the smallest tables.

By default a representative part; ``ORDERLENS_ALL=1`` runs every query (as does
``python -m checks.compare``).
"""

import os

import pytest

from __spark_entry__ import entry
from checks.compare import compare, connect
from checks.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PART = """yearly_revenue category_peak_month payment_focus_share category_share_top6_others
category_tree category_growth age_order_frequency_box city_revenue_modal_tier festival_lift
price_correlation discount_by_year brand_price_histogram brand_position on_time_by_city
return_box_final_amount cohort_retention_yearly lifetime_value_density rating_by_price
days_between_orders category_transitions customer_journeys months_since_launch lifecycle_summary
customer_health rfm_report_table rfm_rules_table rfm_dashboard_table trend_with_empty_months
slowest_deliveries duplicate_classes consolidated_bulk_orders price_outlier_counts
clean_sales_summary bulk_order_totals bulk_order_members transition_matrix
yearly_csv_union sales_by_year_parquet table_replaced kpis_by_amounts""".split()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ORDERLENS_ALL") else PART)
def test_query_matches_sql(spark, duck, name):
    same, note = compare(spark, duck, QUERIES[name], ORACLES[name], SF)
    assert same, note


def test_entry(spark):
    assert entry(spark).count() == 7
