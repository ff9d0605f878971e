"""Recency/frequency/monetary segmentation: one engine, four rule sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.numeric import half_even, mean, total
from orderlens.operators.frames import top_rows, value_counts, with_keys
from orderlens.operators.qcut import Cut, qcut
from orderlens.operators.settle import settle

# ---- Fixed values: lowest score sum of each segment, best first ----------------------
REPORT_SEGMENTS = (
    (13, "Champions"),
    (10, "Loyal Customers"),
    (7, "Potential Loyalists"),
    (5, "Needs Attention"),
    (None, "At Risk"),
)
EXPLORATION_SEGMENTS = (
    (12, "Champions"),
    (9, "Loyal"),
    (6, "Potential Loyalist"),
    (4, "At Risk"),
    (None, "Lost"),
)
DASHBOARD_SEGMENTS = (
    (13, "Champions"),
    (10, "Loyal"),
    (7, "Promising"),
    (4, "At Risk"),
    (None, "Lost"),
)
NEUTRAL_SCORE = 3
# ------------------------------------------------------------------------------------------


def segment_of(score: Column, segments: Sequence[tuple[int | None, str]]) -> Column:
    chain = F.lit(segments[-1][1])
    for floor, label in reversed(segments[:-1]):
        chain = F.when(score >= floor, label).otherwise(chain)
    return F.when(score.isNotNull(), chain)


def rule_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment from the three scores themselves; the first rule that holds decides."""
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champion")
        .when(f >= 4, "Loyal")
        .when((r <= 2) & (m >= 4), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Need Attention")
    )


def rfm(sales: DataFrame, distinct_orders: bool = True) -> DataFrame:
    """Per customer: days since the last order, number of orders (or rows), revenue.

    Days count from the day after the newest order in the data.
    """
    frequency = (
        F.count_distinct("transaction_id") if distinct_orders else F.count("transaction_id")
    )
    newest = sales.agg(F.max("order_date").alias("d")).scalar()
    per_customer = (
        with_keys(sales, "customer_id")
        .groupBy("customer_id")
        .agg(
            F.max("order_date").alias("_last"),
            frequency.alias("frequency"),
            total("final_amount").alias("monetary"),
        )
    )
    recency = F.datediff("_newest", "_last") + 1
    return per_customer.withColumn("_newest", newest).select(
        "customer_id", recency.alias("recency"), "frequency", "monetary"
    )


def _finish(scored: DataFrame, segment: Column | None, rules=None) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    code = F.concat(*[score.cast("string") for score in (r, f, m)])
    summed = scored.withColumn("rfm_code", code).withColumn("rfm_score", r + f + m)
    decided = segment if segment is not None else segment_of(F.col("rfm_score"), rules)
    return summed.withColumn("segment", decided)


def rfm_report(sales: DataFrame) -> DataFrame:
    """All three scores by value; distinct orders; five report segments."""
    scored = qcut(
        settle(rfm(sales)),
        r_score=Cut("recency", descending=True, few_values=True),
        f_score=Cut("frequency"),
        m_score=Cut("monetary"),
    )
    return _finish(scored, None, REPORT_SEGMENTS)


def _exploration_scores(sales: DataFrame) -> DataFrame:
    return qcut(
        settle(rfm(sales, distinct_orders=False)),
        r_score=Cut("recency", descending=True, few_values=True),
        f_score=Cut("frequency", tie="customer_id"),
        m_score=Cut("monetary"),
    )


def rfm_exploration(sales: DataFrame) -> DataFrame:
    """Frequency counts rows and is scored by rank, the others by value."""
    return _finish(_exploration_scores(sales), None, EXPLORATION_SEGMENTS)


def rfm_rules(sales: DataFrame) -> DataFrame:
    """Same scores, missing ones neutral, segments by ordered rules."""
    scored = _exploration_scores(sales).fillna(
        {name: NEUTRAL_SCORE for name in ("r_score", "f_score", "m_score")}
    )
    rules = rule_segment(F.col("r_score"), F.col("f_score"), F.col("m_score"))
    return _finish(scored, rules)


def rfm_dashboard(sales: DataFrame) -> DataFrame:
    """All three scores by rank."""
    scored = qcut(
        settle(rfm(sales)),
        r_score=Cut("recency", tie="customer_id", descending=True),
        f_score=Cut("frequency", tie="customer_id"),
        m_score=Cut("monetary", tie="customer_id"),
    )
    return _finish(scored, None, DASHBOARD_SEGMENTS)


def segment_summary(segments: DataFrame) -> DataFrame:
    """Mean recency, frequency and revenue per segment (one decimal, half-even) and its size."""
    return (
        with_keys(segments, "segment")
        .groupBy("segment")
        .agg(
            half_even(mean("recency"), 1).alias("recency_mean"),
            half_even(mean("frequency"), 1).alias("frequency_mean"),
            half_even(mean("monetary"), 1).alias("monetary_mean"),
            F.count("monetary").alias("customers"),
        )
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return value_counts(segments, "segment")


def best_customers(segments: DataFrame, n: int = 20) -> DataFrame:
    return top_rows(segments, n, "monetary", "customer_id")
