"""The report run: every table of the batch report, written to one folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from orderlens.plans import (
    brands,
    categories,
    customers,
    festivals,
    geography,
    health,
    journeys,
    lifecycle,
    operations,
    payments,
    pricing,
    ratings,
    revenue,
    segments,
)
from orderlens.sources.files import write_report

PLANS = (
    revenue.yearly_revenue, revenue.revenue_trend, revenue.monthly_revenue, revenue.revenue_heatmap,
    revenue.category_month_share, revenue.category_peak_month, segments.rfm_report,
    payments.dominant_method, payments.wallet_share, categories.category_share,
    categories.category_tree, categories.category_growth, customers.member_order_value,
    customers.member_order_frequency, customers.member_category_share, geography.state_revenue,
    geography.city_revenue, geography.tier_revenue_by_year, festivals.festival_lift,
    customers.age_category_share, customers.age_order_value, customers.age_order_frequency,
    pricing.price_demand, pricing.price_correlation, operations.delivery_days_by_tier,
    operations.on_time_by_city, operations.satisfaction_by_tier, operations.return_rate,
    operations.return_correlation, brands.brand_performance, brands.brand_by_month,
    brands.brand_by_category, customers.yearly_cohorts, customers.lifetime_value_by_year,
    pricing.discount_by_year, pricing.discount_over_time, pricing.discount_quantity,
    ratings.rating_histogram, ratings.product_ratings, ratings.rating_by_price,
    journeys.days_between_orders, journeys.transition_matrix, journeys.journey_matrix,
    lifecycle.quantity_by_year, lifecycle.launch_success, lifecycle.lifecycle_summary,
    pricing.brand_position, health.customer_health, health.operations_health,
)
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {plan.__name__: plan for plan in PLANS}


def write_all_reports(
    sales: DataFrame, folder: str, names: Iterable[str] | None = None, fmt: str = "csv"
) -> dict[str, str]:
    """Write every report table (or the named ones) below ``folder``; name -> where it went."""
    wanted = REPORTS if names is None else {name: REPORTS[name] for name in names}
    return {name: write_report(plan(sales), folder, name, fmt) for name, plan in wanted.items()}
