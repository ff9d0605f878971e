"""How often a result reads its table: a source that notes every read of a part."""

import datetime
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orderlens.operators import outliers, quantiles, sequences
from orderlens.plans import categories, pricing, ratings

PARTS = 2
SCHEMA = (
    "customer_id int, order_date date, transaction_id int, subcategory string, brand string, original_price double, "
    "final_amount double, product_rating double, quantity int, order_year int"
)


def row(rng, i):
    day = datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(700))
    return (
        rng.randrange(300), day, i, rng.choice("abcd"), rng.choice("xyz"), rng.lognormvariate(5, 1),
        rng.lognormvariate(5, 1), float(rng.randint(1, 5)), rng.randint(1, 9), 2020 + rng.randrange(2),
    )


@pytest.fixture(scope="module")
def sales(spark):
    # Defined here, so that workers get it by value.
    class Reader(DataSourceReader):
        def __init__(self, notes):
            self.notes = notes

        def partitions(self):
            return [InputPartition(i) for i in range(PARTS)]

        def read(self, partition):
            open(f"{self.notes}/{uuid.uuid4().hex}", "w").close()
            rng = random.Random(partition.value)
            return iter([row(rng, 10_000 * partition.value + i) for i in range(3000)])

    class Noted(DataSource):
        @classmethod
        def name(cls):
            return "noted"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options["notes"])

    spark.dataSource.register(Noted)
    return lambda notes: spark.read.format("noted").option("notes", str(notes)).load()


def reads(sales, notes, build) -> float:
    """How often building and running a result reads the whole table."""
    build(sales(notes)).write.format("noop").mode("overwrite").save()
    return len(os.listdir(notes)) / PARTS


CASES = {
    "quantiles": (2, lambda s: quantiles.exact_quantiles(s, "final_amount", [0.5], ["subcategory"])),
    "describe": (2, lambda s: quantiles.describe(s, "final_amount", ["brand"])),
    "box": (2, lambda s: quantiles.box_stats(s, "final_amount", ["brand"])),
    "box of few values": (1, lambda s: quantiles.box_stats(s, "product_rating", ["brand"], few_values=True)),
    "outliers": (3, lambda s: outliers.flag_price_outliers(s).agg(F.count_if("price_outlier_iqr"), F.count_if("price_outlier_3_sigma"))),
    "brand_position": (3, pricing.brand_position),
    "brand_price_histogram": (4, pricing.brand_price_histogram),
    "category_growth": (1, categories.category_growth),
    "rating_by_price": (2, ratings.rating_by_price),
}


@pytest.mark.parametrize("name", CASES)
def test_reads(sales, tmp_path, name):
    most, build = CASES[name]
    assert 1 <= reads(sales, tmp_path, build) <= most


def test_transitions_read_once(sales, tmp_path):
    names = ("customer_id", "order_date", ["transaction_id"], "subcategory")
    for budget in (10, 500_000):
        folder = tmp_path / str(budget)
        folder.mkdir()
        assert reads(sales, folder, lambda s, b=budget: sequences.transitions(s, *names, b)) == 1
