"""Operators against brute force in pandas/numpy, with hot keys and missing values."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import (
    duplicates, frames, histogram, outliers, periods, qcut, quantiles, sequences, skew, statistics,
)
from orderlens.plans import journeys, lifecycle, payments, segments


@pytest.fixture(scope="module")
def numbers():
    """A third of the rows in one group, many equal values, both signs, some missing."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.4 else rng.choice("abcdefgh")
        value = rng.choice([0.0, 5.0, rng.uniform(-50, 50), rng.lognormvariate(6, 2)])
        rows.append((i, group, None if i % 37 == 0 else round(value, 2)))
    rows.append((5000, "single", 4.0))
    return rows


@pytest.fixture(scope="module")
def frame(spark, numbers):
    return spark.createDataFrame(numbers, "id int, k string, v double").repartition(4).cache()


def test_exact_quantiles(frame, numbers):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    data = pd.DataFrame(numbers, columns=["id", "k", "v"]).dropna()
    for few in (False, True):
        found = quantiles.exact_quantiles(frame, "v", probs, ["k"], few).collect()
        assert len(found) == data.k.nunique()
        for row in found:
            values = data[data.k == row.k].v
            assert row.rows == len(values)
            expected = np.quantile(values, probs)
            assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(expected)
    overall = quantiles.exact_quantiles(frame, "v", probs).first()
    assert [overall[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(data.v, probs))


@pytest.mark.parametrize("spread", ["narrow", "seconds", "ties"])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_of_crowded_bins(spark, monkeypatch, spread, keys):
    """All values in one bin of the first level: cut again until no task holds more than the budget."""
    rng = random.Random(11)
    make = {
        "narrow": lambda: rng.random() / 1000,
        "seconds": lambda: 1_700_000_000 + rng.randrange(10**6) / 8,
        "ties": lambda: rng.choice([0.0005, 0.0005000000001, 0.0009]),
    }[spread]
    rows = [("hot" if rng.random() < 0.6 else rng.choice("ab"), make()) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(4)
    data = pd.DataFrame(rows, columns=["k", "v"])
    assert frame.select(quantiles.value_bin(F.col("v"))).distinct().count() <= 2
    levels, cut = [], quantiles._cut

    def counted(values, cells, own):
        found = cut(values, cells, own)
        levels.append(found.agg(F.max("_load")).first()[0])
        return found

    monkeypatch.setattr(quantiles, "_cut", counted)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    found = quantiles.exact_quantiles(frame, "v", probs, keys, budget=6).collect()
    assert len(found) == (3 if keys else 1) and levels and levels[-1] <= 6
    for row in found:
        values = data[data.k == row.k].v if keys else data.v
        assert row.rows == len(values)
        assert [row[f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(values, probs), rel=1e-15)


def test_describe_merges_moments(frame, numbers):
    data = pd.DataFrame(numbers, columns=["id", "k", "v"])
    for row in quantiles.describe(frame, "v", ["k"]).collect():
        expected = data[data.k == row.k].v.describe()
        got = [row[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
        if expected["count"] == 1:
            assert got[2] is None and got[1] == expected["mean"]
        else:
            assert got == pytest.approx(expected.tolist())


def test_approximate_quantiles_stay_within_rank_error(frame, numbers):
    data = pd.DataFrame(numbers, columns=["id", "k", "v"]).dropna()
    row = quantiles.approximate_quantiles(frame, "v", [0.5]).first()
    place = (data.v <= row.q0).mean()
    assert row.rows == len(data) and place >= 0.5 - 1e-3


def test_box_stats(frame, numbers):
    data = pd.DataFrame(numbers, columns=["id", "k", "v"]).dropna()
    found = quantiles.box_stats(frame, "v", ["k"]).collect()
    for row in found:
        values = data[data.k == row.k].v
        q1, q3 = values.quantile(0.25), values.quantile(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = values[(values >= low) & (values <= high)]
        expected = [len(values), values.min(), inside.min(), q1, values.median(), q3, inside.max(),
                    values.max(), len(values) - len(inside)]
        names = "rows minimum whisker_low q1 median q3 whisker_high maximum outliers".split()
        assert [row[name] for name in names] == pytest.approx(expected)


def test_histogram(frame, numbers):
    data = pd.DataFrame(numbers, columns=["id", "k", "v"]).dropna()
    found = histogram.histogram(frame, "v", 13).orderBy("bin").collect()
    counts, edges = np.histogram(data.v, 13)
    assert [r["count"] for r in found] == counts.tolist()
    assert [r.bin_start for r in found] == pytest.approx(edges[:-1])
    by_group = histogram.histogram(frame, "v", 5, ["k"])
    sizes = {r.k: r.n for r in by_group.groupBy("k").agg(F.sum("count").alias("n")).collect()}
    assert sizes == data.groupby("k").size().to_dict()
    single = by_group.where("k = 'single'").orderBy("bin").collect()
    assert [r["count"] for r in single] == [1, 0, 0, 0, 0]


def test_density_follows_the_direct_kernel_sum(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(10, 3, 2000)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = histogram.density(rows, "v", points=50).orderBy("point").collect()
    band = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min(), values.max(), 50)
    direct = np.exp(-0.5 * ((x[:, None] - values) / band) ** 2).sum(1)
    direct /= len(values) * band * np.sqrt(2 * np.pi)
    assert [r.x for r in found] == pytest.approx(x)
    assert [r.density for r in found] == pytest.approx(direct, rel=0.01, abs=1e-5)


def test_density_of_a_constant_is_empty(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert histogram.density(rows, "v").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 250, 1999])
def test_qcut_by_rank(spark, size):
    rng = random.Random(size)
    rows = [(i, rng.choice([1, 1, 1, 2, rng.randint(3, 40)])) for i in range(size)]
    frame = spark.createDataFrame(rows, "id int, v int").repartition(3)
    found = {r.id: (r.up, r.down) for r in qcut.qcut(
        frame, up=qcut.Cut("v", tie="id"), down=qcut.Cut("v", tie="id", descending=True)
    ).collect()}
    ordered = sorted(rows, key=lambda row: (row[1], row[0]))
    for place, (i, _) in enumerate(ordered):
        label = max(1, -(-place * 5 // (size - 1))) if size > 1 else 1
        assert found[i] == (label, 6 - label)


@pytest.mark.parametrize("budget,splitters", [(10, 4), (25, 64), (1, 2)])
def test_rank_bins_within_a_budget(spark, monkeypatch, budget, splitters):
    """Equal values, narrow values and text ids: pieces are cut until one task can sort them."""
    monkeypatch.setattr(qcut, "BUDGET", budget)
    monkeypatch.setattr(qcut, "SPLITTERS", splitters)
    rng = random.Random(budget)
    rows = [(f"c{i:04d}", rng.choice([0.0, 0.0, 0.0001, rng.random() / 1000, -5.0])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id string, v double").repartition(3)
    sorted_in_one_task, plain = [], qcut._holding

    def holding(piece, parts):
        found = plain(piece, parts)
        sorted_in_one_task[:] = [p.count for p in found]
        return found

    monkeypatch.setattr(qcut, "_holding", holding)
    found = {r.id: r.q for r in qcut.qcut(frame, q=qcut.Cut("v", tie="id")).collect()}
    assert max(sorted_in_one_task) <= budget
    for place, (i, _) in enumerate(sorted(rows, key=lambda row: (row[1], row[0]))):
        assert found[i] == max(1, -(-place * 5 // 399))


def test_qcut_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, v double")
    found = qcut.qcut(empty, a=qcut.Cut("v", tie="id"), b=qcut.Cut("v"))
    assert found.columns == ["id", "v", "a", "b"] and found.count() == 0
    missing = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    assert {r.a for r in qcut.qcut(missing, a=qcut.Cut("v", tie="id")).collect()} == {None}


def test_qcut_by_rank_of_seven(spark):
    frame = spark.createDataFrame([(i, 0) for i in range(7)], "id int, v int")
    found = qcut.qcut(frame, q=qcut.Cut("v", tie="id")).orderBy("id").collect()
    assert [r.q for r in found] == [1, 1, 2, 3, 4, 5, 5]


def test_qcut_by_value_matches_pandas(spark, numbers):
    data = pd.DataFrame(numbers, columns=["id", "k", "v"])
    frame = spark.createDataFrame(numbers, "id int, k string, v double")
    codes = pd.qcut(data.v, 5, labels=False, duplicates="drop")
    top = codes.max() + 1
    cut = qcut.qcut(frame, up=qcut.Cut("v"), down=qcut.Cut("v", descending=True)).collect()
    for row in cut:
        code = codes[row.id if row.id < 5000 else 3000]
        expected = (None, None) if pd.isna(code) else (code + 1, top - code)
        assert (row.up, row.down) == expected


def test_qcut_by_value_collapses_equal_edges(spark):
    frame = spark.createDataFrame([(1,), (1,), (1,), (1,), (5,)], "v int")
    assert sorted(r.q for r in qcut.qcut(frame, q=qcut.Cut("v")).collect()) == [1, 1, 1, 1, 2]
    constant = spark.createDataFrame([(1,), (1,)], "v int")
    assert {r.q for r in qcut.qcut(constant, q=qcut.Cut("v")).collect()} == {None}


@pytest.mark.parametrize("limit", [100_000, 0])
@pytest.mark.parametrize("null_safe", [False, True])
def test_attach_is_a_left_join(spark, limit, null_safe):
    """The same result by full broadcast and by the hot/cold split."""
    rng = random.Random(1)
    keys = ["hot"] * 4000 + [f"k{rng.randint(0, 900)}" for _ in range(2000)] + [None] * 300
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    summary = facts.where("k is null or k not like '%7'").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("last")
    )
    found = skew.attach(facts, summary, ["k"], "n", null_safe, broadcast_rows=limit)
    last = {}
    for i, k in enumerate(keys):
        if k is None or not k.endswith("7"):
            last[k] = i
    if not null_safe:
        last.pop(None)
    expected = sorted((i, str(k), str(last.get(k))) for i, k in enumerate(keys))
    assert sorted((r.id, str(r.k), str(r.last)) for r in found.collect()) == expected


def journeys_data():
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        customer = 0 if rng.random() < 0.4 else rng.randint(1, 60)
        day = f"2020-01-{rng.randint(1, 28):02d}"
        rows.append((customer, day, i, rng.choice(["x", "y", "z", None])))
    rows.append((None, "2020-01-01", 9999, "x"))
    return rows


def test_transitions_gaps_and_ends(spark):
    rows = journeys_data()
    frame = spark.createDataFrame(rows, "c int, d string, t int, s string").withColumn(
        "d", F.to_date("d")
    )
    data = pd.DataFrame(rows, columns=["c", "d", "t", "s"]).dropna(subset=["c"])
    data = data.sort_values(["c", "d", "t"])
    data["before"] = data.groupby("c").s.shift(1)
    expected = data.dropna(subset=["before", "s"]).groupby(["before", "s"]).size().to_dict()
    found = sequences.transitions(frame, "c", "d", ["t"], "s").collect()
    assert {(r.previous, r.following): r["count"] for r in found} == expected

    day = pd.to_datetime(data.d)
    gaps = (day - day.groupby(data.c).shift(1)).dt.days.dropna().astype(int).value_counts().to_dict()
    assert {r.days: r.n for r in sequences.day_gaps(frame, "c", "d").collect()} == gaps

    ends = sequences.first_and_last(frame, "c", ["d", "t"], "s").collect()
    first, last = data.groupby("c").s.first(), data.groupby("c").s.last()
    size = data.groupby("c").size()
    assert len(ends) == len(first)
    for r in ends:
        wanted = [None if pd.isna(v) else v for v in (first[r.c], last[r.c])]
        assert [r.first_s, r.last_s, r.rows] == [*wanted, size[r.c]]


def test_transitions_of_one_crowded_day(spark, monkeypatch, tmp_path):
    """All rows in one customer-day: cut into ranges, no task with more than the budget, one read."""
    rng = random.Random(8)
    rows = [(1, "2020-01-01", i, rng.choice(["x", "y", None])) for i in range(3000)]
    rows += [(1, "2020-01-02", i, "z") for i in range(3)] + [(2, "2020-01-01", 0, "x"), (2, "2020-01-05", 1, "y")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "c int, d string, t int, s string").withColumn("d", F.to_date("d"))
    frame.write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    kept, plain = [], sequences._segments

    def segments(*arguments):
        kept.append(plain(*arguments))
        return kept[-1]

    monkeypatch.setattr(sequences, "_segments", segments)
    found = sequences.transitions(frame, "c", "d", ["t"], "s", budget=200)
    sizes = [r["count"] for r in kept[0].groupBy("c", "d", "_range").count().collect()]
    assert max(sizes) <= 200 and len(sizes) > 15
    assert str(tmp_path) not in found._jdf.queryExecution().executedPlan().toString()
    data = pd.DataFrame(rows, columns=["c", "d", "t", "s"]).sort_values(["c", "d", "t"])
    data["before"] = data.groupby("c").s.shift(1)
    expected = data.dropna(subset=["before", "s"]).groupby(["before", "s"]).size().to_dict()
    assert {(r.previous, r.following): r["count"] for r in found.collect()} == expected


def test_results_do_not_depend_on_row_order(spark):
    rows = journeys_data()
    once = None
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame(rows, "customer_id int, d string, transaction_id int, subcategory string")
        frame = frame.withColumn("order_date", F.to_date("d")).repartition(2 + seed)
        order = ["order_date", "transaction_id"]
        found = sorted(journeys.customer_journeys(frame, order).collect())
        shares = journeys.category_transitions(frame, order).groupBy("previous").agg(
            F.sum("probability").alias("p")
        )
        assert all(r.p == pytest.approx(1.0) for r in shares.collect())
        assert once is None or found == once
        once = found


@pytest.mark.parametrize(
    "values, periods_seen, declining",
    [([3], 1, True), ([5, 4, 3], 3, True), ([5, 5, 4], 3, False), ([1, 9, 8, 7, 6, 5], 5, True),
     ([9, 8, 7, 8, 6, 5], 5, False)],
)
def test_is_declining(spark, values, periods_seen, declining):
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "k string, t int, v int")
    row = sequences.is_declining(rows, ["k"], "t", "v").first()
    assert (row.periods, row.is_declining) == (periods_seen, declining)


def test_rolling_mean_is_shorter_at_the_start(spark):
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate([3, 5, 10, 0])], "k string, t int, v int")
    rolled = sequences.rolling_mean(rows, ["k"], "t", "v", 3).orderBy("t").collect()
    assert [r.rolling for r in rolled] == [3.0, 4.0, 6.0, 5.0]


DUPLICATE_ROWS = "id string, k string, quantity int, final_amount double"


def test_duplicate_classes(spark):
    rows = spark.createDataFrame(
        [("1", "a", 1, 10.0), ("2", "a", 1, 10.0),   # equal quantities: bulk
         ("3", "b", 1, 10.0), ("4", "b", 2, 10.0),   # amounts do not grow with quantity: error
         ("5", "c", 0, 10.0), ("6", "c", 0, 10.0),   # no unit price: error
         ("7", None, 1, 10.0), ("8", None, 1, 10.0), # missing key: a copy, but not judged
         ("9", "d", 1, 10.0)],
        DUPLICATE_ROWS,
    )
    found = duplicates.classify_duplicates(rows, ["k", "final_amount"], row_id="id")
    assert {r.id: (r.is_duplicate, r.duplicate_type) for r in found.collect()} == {
        "1": (True, "bulk_order"), "2": (True, "bulk_order"),
        "3": (True, "error_duplicate"), "4": (True, "error_duplicate"),
        "5": (True, "error_duplicate"), "6": (True, "error_duplicate"),
        "7": (True, "normal"), "8": (True, "normal"), "9": (False, "normal"),
    }


def test_a_summary_grows_with_a_new_file(spark, tmp_path):
    """What was kept and what is added give the groups of all rows; other months are not touched."""
    rng = random.Random(9)

    def rows(n, months, start):
        return [
            (f"t{start + i}", f"2020-{rng.choice(months):02d}-{rng.randint(1, 3):02d}" if rng.random() < 0.95 else None,
             rng.choice("ab") if rng.random() < 0.9 else None, rng.randint(1, 2), float(rng.randint(1, 3)))
            for i in range(n)
        ]

    schema = "id string, d string, k string, quantity int, final_amount double"
    old, new = (
        spark.createDataFrame(r, schema).withColumn("order_date", F.to_date("d")).drop("d")
        for r in (rows(300, [1, 2, 3], 0), rows(80, [3, 4], 1000))
    )
    keys, path = ["order_date", "k", "final_amount"], str(tmp_path / "summary")
    duplicates.write_summary(old, path, keys, row_id="id")

    def written():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "summary").rglob("*.parquet")}

    before = written()
    touched = duplicates.add_to_summary(new, path, keys, row_id="id")
    after = written()
    months = {p.split("month=")[1].split("/")[0] for p in set(before) ^ set(after)}
    assert months == {"2020-03", "2020-04", "none"}
    every = {str(tuple(r[:3])): tuple(r) for r in duplicates.duplicate_groups(old.union(new), keys, row_id="id").collect()}
    grown = duplicates.judged(duplicates.read_summary(spark, path), keys).collect()
    assert {str(tuple(r[:3])): tuple(r) for r in grown} == every and len(grown) == len(every)
    own = {str(tuple(r)) for r in new.select(*keys).distinct().collect()}
    assert {str(tuple(r[:3])): tuple(r) for r in touched.collect()} == {k: v for k, v in every.items() if k in own}


def test_a_huge_bulk_order_is_one_row_of_totals_and_a_member_row_per_id(spark):
    ids = [f"t{i:05d}" for i in range(25_000)] + ["t00000"]
    rows = spark.createDataFrame(
        [(i, "hot", 1, 2.0) for i in ids] + [("x", "a", 1, 1.0), ("y", "a", 1, 1.0)], DUPLICATE_ROWS
    )
    keys = ["k", "final_amount"]
    totals = {r.k: r for r in duplicates.bulk_order_totals(rows, keys, row_id="id").collect()}
    assert len(totals) == 2 and totals["hot"].total_quantity == totals["hot"].copies == 25_001
    members = duplicates.bulk_order_members(rows, keys, row_id="id").where("k = 'hot'").collect()
    assert sorted(r.id for r in members) == sorted(ids)
    joined = {r.k: r.transaction_ids for r in duplicates.consolidate_bulk_orders(rows, keys, row_id="id").collect()}
    assert joined["a"] == "x,y" and joined["hot"].count(",") == 25_000


def test_a_matrix_has_every_value_as_a_column(spark):
    cells = spark.createDataFrame([(f"r{i % 3}", f"c{i}", i) for i in range(9)], "k string, y string, v int")
    wide = frames.to_wide(cells, "k", "y", "v", fill=0)
    assert wide.columns == ["k", *[f"c{i}" for i in range(9)]]
    long = frames.matrix_cells(cells, "k", "y", "v", 0)
    assert long.count() == 27 and long.agg({"v": "sum"}).first()[0] == 36



def test_price_outliers(spark):
    prices = [10.0, 11.0, 12.0, 13.0, 100.0]
    rows = [("s", "b", p) for p in prices] + [("s", "one", 5.0), ("s", "same", 7.0), ("s", "same", 7.0),
            ("s", None, 1e9), ("s", "b", None)]
    rows += [("s", "many", 1.0)] * 30 + [("s", "many", 1.5), ("s", "many", 900.0)]
    frame = spark.createDataFrame(rows, "subcategory string, brand string, original_price double")
    found = outliers.flag_price_outliers(frame).collect()
    assert len(found) == len(rows)
    assert {r.original_price for r in found if r.price_outlier_iqr} == {100.0, 1.5, 900.0}
    assert {r.original_price for r in found if r.price_outlier_3_sigma} == {900.0}


def test_empty_periods_count_zero(spark):
    rows = spark.createDataFrame([("2020-01-31", 5), ("2020-03-01", 7)], "d string, final_amount int")
    rows = rows.withColumn("order_date", F.to_date("d"))
    monthly = periods.resample(rows, "M").orderBy("period_end").collect()
    assert [(str(r.period_end), r.revenue, r.orders) for r in monthly] == [
        ("2020-01-31", 5, 1), ("2020-02-29", 0, 0), ("2020-03-31", 7, 1),
    ]
    yearly = periods.resample(rows, "Y").collect()
    assert [(str(r.period_end), r.revenue) for r in yearly] == [("2020-12-31", 12)]
    assert [str(r.period_end) for r in periods.resample(rows, "Q").collect()] == ["2020-03-31"]


def test_grid_and_wide_form_agree(spark):
    long = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 7.0)], "k string, y int, v double")
    grid = frames.complete_grid(long, "k", "y", F.sequence(F.lit(1), F.lit(3)), {"v": 0.0})
    assert sorted(grid.collect()) == [
        ("a", 1, 5.0), ("a", 2, 0.0), ("a", 3, 0.0), ("b", 1, 0.0), ("b", 2, 7.0), ("b", 3, 0.0),
    ]
    wide = frames.to_wide(long, "k", "y", "v", [1, 2, 3], "y", 0.0)
    assert sorted(map(tuple, wide.collect())) == [("a", 5.0, 0.0, 0.0), ("b", 0.0, 7.0, 0.0)]


def test_linear_trend(spark):
    rows = spark.createDataFrame([(x, 3.0 * x + 2) for x in range(5)], "x int, y double")
    assert statistics.linear_trend(rows, "x", "y").first() == pytest.approx((3.0, 2.0))
    one = spark.createDataFrame([(1, 1.0)], "x int, y double")
    assert statistics.linear_trend(one, "x", "y").first() == (None, None)


def test_median_fill_and_trim(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,), (9.0,), (-1.0,)], "v double")
    filled = sorted(r.v for r in quantiles.fill_with_median(rows, "v").collect())
    assert filled == [-1.0, 1.0, 1.5, 2.0, 9.0]
    assert sorted(r.v for r in quantiles.trim_above(rows, "v", 0.9).collect()) == [1.0, 2.0]


def test_segment_thresholds(spark):
    sums = [15, 13, 12, 10, 9, 7, 6, 5, 4, 3]
    rows = spark.createDataFrame([(s,) for s in sums], "s int")

    def labels(rules):
        return [r[0] for r in rows.select(segments.segment_of(F.col("s"), rules)).collect()]

    assert labels(segments.REPORT_SEGMENTS) == (
        ["Champions"] * 2 + ["Loyal Customers"] * 2 + ["Potential Loyalists"] * 2
        + ["Needs Attention"] * 2 + ["At Risk"] * 2
    )
    assert labels(segments.EXPLORATION_SEGMENTS) == (
        ["Champions"] * 3 + ["Loyal"] * 2 + ["Potential Loyalist"] * 2 + ["At Risk"] * 2 + ["Lost"]
    )
    assert labels(segments.DASHBOARD_SEGMENTS) == (
        ["Champions"] * 2 + ["Loyal"] * 2 + ["Promising"] * 2 + ["At Risk"] * 3 + ["Lost"]
    )


def test_rule_segments_keep_their_order(spark):
    cases = {
        (4, 4, 4): "Champion", (1, 4, 5): "Loyal", (2, 3, 4): "At Risk", (2, 2, 3): "Lost",
        (3, 3, 3): "Need Attention",
    }
    rows = spark.createDataFrame(list(cases), "r int, f int, m int")
    found = rows.select("*", segments.rule_segment(F.col("r"), F.col("f"), F.col("m")).alias("s"))
    assert {(r.r, r.f, r.m): r.s for r in found.collect()} == cases


def test_two_launch_windows(spark):
    rows = spark.createDataFrame(
        [("p", "s", f"2020-{m:02d}-15", 1, 4.0, None) for m in (1, 2, 3, 4, 5)]
        + [("p", "s", "2020-01-20", 10, None, "Returned")],
        "product_id string, subcategory string, d string, quantity int, customer_rating double, "
        "return_status string",
    ).withColumn("order_date", F.to_date("d"))
    success = lifecycle.launch_success(rows).first()
    assert (success.launch_quantity, success.average_rating, success.return_rate) == (14, 4.0, 0.2)
    assert lifecycle.early_quantity(rows).first().average_early_quantity == 13.0


def test_empty_year_has_no_share(spark):
    rows = spark.createDataFrame([(2015, "UPI"), (2017, "Cheque")], "order_year int, payment_method string")
    found = {(r.order_year, r.payment_method): r.share_percent for r in payments.focus_share(rows, 2015, 2017).collect()}
    assert found == {
        (2015, "UPI"): 100.0, (2015, "Other"): 0.0, (2016, "UPI"): None, (2016, "Other"): None,
        (2017, "UPI"): 0.0, (2017, "Other"): 100.0,
    }
