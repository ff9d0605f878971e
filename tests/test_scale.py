"""What is shuffled and kept: no more rows and joins than a result needs."""

import random

import pytest
from pyspark.sql import functions as F

from checks import cleaning_queries
from orderlens.operators import duplicates
from orderlens.plans import cleaning, lifecycle
from orderlens.sources import star

SF = "/root/testdata/sf0.001"
KEYS = ["order_date", "k", "final_amount"]
SCHEMA = "id string, d string, k string, quantity int, final_amount double"


def plan(df, which="executedPlan") -> str:
    return getattr(df._jdf.queryExecution(), which)().toString()


def rows(spark, n, seed=1):
    rng = random.Random(seed)
    made = [
        (f"t{i}", rng.choice(["2020-01-01", "2020-02-01", None]), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), float(rng.randint(1, n)))
        for i in range(n)
    ]
    return spark.createDataFrame(made, SCHEMA).withColumn("order_date", F.to_date("d")).drop("d")


def grouped(df, path):
    duplicates.write_summary(df, path, KEYS, row_id="id")


WORK = {
    "write_summary": grouped,
    "consolidate_bulk_orders": lambda df, path: duplicates.consolidate_bulk_orders(df, KEYS, row_id="id"),
    "bulk_order_members": lambda df, path: duplicates.bulk_order_members(df, KEYS, row_id="id"),
    "classify_duplicates": lambda df, path: duplicates.classify_duplicates(df, KEYS, row_id="id"),
    "duplicate_groups": lambda df, path: duplicates.duplicate_groups(df, KEYS, row_id="id"),
}


@pytest.mark.parametrize("name", WORK)
def test_rows_that_occur_once_are_not_grouped(spark, tmp_path, monkeypatch, name):
    single = spark.range(4000).selectExpr(
        "cast(id AS string) AS id", "date'2020-01-01' AS order_date", "cast(id AS string) AS k",
        "1 AS quantity", "2.0D AS final_amount",
    )
    df, sizes, summary = single.unionAll(single.limit(10)), [], duplicates.duplicate_summary

    def noted(rows, *args, **names):
        sizes.append(rows.count())
        return summary(rows, *args, **names)

    monkeypatch.setattr(duplicates, "duplicate_summary", noted)
    WORK[name](df, str(tmp_path / "summary"))
    assert len(sizes) == 1 and 20 <= sizes[0] <= 100


@pytest.mark.parametrize("bits", [64, 512, 1 << 28])
def test_parted_rows_miss_no_copy_in_a_crowded_table(spark, bits):
    df = rows(spark, 2000)
    single, several = duplicates.parted(df, duplicates.repeated_hashes(df, KEYS, bits), KEYS)
    assert sorted(r.id for r in single.unionAll(several).collect()) == sorted(r.id for r in df.collect())
    count = {}
    for r in df.collect():
        count[(r.order_date, r.k, r.final_amount)] = count.get((r.order_date, r.k, r.final_amount), 0) + 1
    assert all(count[(r.order_date, r.k, r.final_amount)] == 1 for r in single.collect())
    if bits > 512:
        assert single.count() > 0


def test_the_summary_holds_single_rows_as_grouping_gives_them(spark, tmp_path):
    df, path = rows(spark, 500), str(tmp_path / "summary")
    grouped(df, path)
    kept, wanted = duplicates.read_summary(spark, path), duplicates.duplicate_summary(df, KEYS, row_id="id")
    assert kept.select(*wanted.columns).dtypes == wanted.dtypes
    assert sorted(map(str, kept.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_lines_meet_orders_and_customers_at_once(spark):
    text = plan(star.sales(spark, SF, ["quantity", "customer_tier"]), "optimizedPlan")
    assert text.index("= o_orderkey") < text.index("= c_custkey")


def test_copies_are_made_in_one_read(spark):
    sales = star.sales(spark, SF, cleaning_queries.DUPLICATE_COLUMNS.split())
    assert plan(cleaning_queries.with_copies(sales)).count("lineitem.parquet") == 1


def test_typed_rows_are_kept_without_a_shuffle(spark, monkeypatch):
    sales = star.sales(spark, SF, cleaning_queries.RAW_SOURCE.split())
    kept, stage = [], cleaning.stage
    monkeypatch.setattr(cleaning, "stage", lambda df, path: kept.append(plan(df, "optimizedPlan")) or stage(df, path))
    cleaning.clean_sales(cleaning_queries.dirty_text(sales))
    assert len(kept) == 1 and "Rebalance" not in kept[0]


def test_early_months_are_added_up_before_the_products_rows_meet(spark):
    made = [
        (1, "s", "2020-01-31", 2), (1, "t", "2020-03-01", 3), (1, "u", "2021-01-01", 9), (1, None, "2020-02-01", 4),
        (2, "s", "2020-05-01", None), (3, "s", "2020-05-01", 7), (3, "s", None, 8), (None, "s", "2020-05-01", 8),
    ]
    sales = spark.createDataFrame(made, "product_id int, subcategory string, d string, quantity int").withColumn("order_date", F.to_date("d"))
    found, again = lifecycle.early_quantity(sales), lifecycle.early_quantity(sales)
    assert {r.subcategory: r.average_early_quantity for r in found.collect()} == {"s": pytest.approx(16 / 3), "t": 9.0, "u": 9.0}
    between = plan(again).split("Window [")
    assert len(between) == 3 and "HashAggregate" in between[1]
