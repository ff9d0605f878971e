"""Sources, sinks, profiling and the whole cleaning job on files."""

import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orderlens.operators.frames import between_dates
from orderlens.plans import cleaning, customers, dashboard, revenue, rollup
from orderlens.sources import files, profile, schema, star

SF = "/root/testdata/sf0.001"


def test_yearly_files_of_different_width(spark, tmp_path):
    (tmp_path / "sales_2019.csv").write_text('id,amount\n1,5\n2,"1,000"\n')
    (tmp_path / "sales_2020.csv").write_text("id,amount,city\n3,7,Pune\n4,NA,\n")
    (tmp_path / "notes.csv").write_text("id,amount\n9,9\n")
    (tmp_path / "sales_2021.txt").write_text("id,amount\n8,8\n")
    found = files.read_yearly_csv(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [
        ("1", "5", None), ("2", "1,000", None), ("3", "7", "Pune"), ("4", None, None),
    ]


def bytes_read(spark):
    stats = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in stats)


def test_headers_cost_no_more_where_files_grow(spark, tmp_path):
    """Only the start of each file is read while the yearly folder is planned."""
    read = []
    for rows in (40_000, 400_000):
        folder = tmp_path / str(rows)
        folder.mkdir()
        for year in (2019, 2020):
            (folder / f"s_{year}.csv").write_text("id,amount\n" + "17,99.5\n" * rows)
        (folder / "s_2021.csv").write_text("")
        before = bytes_read(spark)
        found = files.headers(spark, str(folder))
        read.append(bytes_read(spark) - before)
        assert list(found.values()) == ["id,amount"] * 2
    assert read[0] == read[1] < 300_000


def test_yearly_files_are_named_by_year(spark, tmp_path):
    folder = str(tmp_path / "raw")
    rows = spark.createDataFrame([(2019, 'a "b", c'), (2019, "d"), (2021, None), (None, "x")], "year int, name string")
    names = files.write_yearly_csv(rows, folder, "year")
    assert {n.split("_")[1] for n in names} == {"2019", "2021"} and all(n.startswith("sales_20") for n in names)
    back = files.read_yearly_csv(spark, folder)
    assert sorted((r.year, r.name or "") for r in back.collect()) == [("2019", 'a "b", c'), ("2019", "d"), ("2021", "")]
    assert set(names) == {p.name for p in (tmp_path / "raw").iterdir() if not p.name.startswith((".", "_"))}


def test_yearly_files_with_a_schema_are_one_scan(spark, tmp_path):
    for year in (2019, 2020):
        (tmp_path / f"sales_{year}.csv").write_text(f"a,b\n{year},x\n")
    found = files.read_yearly_csv(spark, str(tmp_path), "a string, b string")
    assert sorted(r.a for r in found.collect()) == ["2019", "2020"]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1


def test_sales_are_written_by_year_and_pruned(spark, tmp_path):
    path = str(tmp_path / "sales")
    original = star.sales(spark, SF, ["transaction_id", "order_date", "order_year", "order_month", "final_amount"])
    files.write_sales(original, path)
    back = files.read_sales(spark, path)
    assert back.count() == original.count()
    recent = between_dates(back, "1996-03-01", "1996-04-30")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan
    assert recent.count() == original.where("order_date BETWEEN '1996-03-01' AND '1996-04-30'").count()


def test_reports_keep_their_keys(spark, tmp_path):
    table = revenue.yearly_revenue(star.sales(spark, SF, ["order_year", "final_amount"]))
    path = files.write_report(table, str(tmp_path), "yearly")
    assert spark.read.option("header", "true").csv(path).columns == ["order_year", "revenue", "yoy_percent"]


def test_table_is_replaced_listed_and_previewed(spark, tmp_path):
    files.save_table(spark.range(10), "transactions", str(tmp_path / "t"))
    files.save_table(spark.range(500).withColumnRenamed("id", "n"), "transactions", str(tmp_path / "t"))
    assert "transactions" in files.list_tables(spark)
    assert files.table_rows(spark).first().rows == 500
    assert files.preview(spark.table("transactions")).count() == 200


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    for name, path in (("kept_managed", None), ("kept_external", str(tmp_path / "t"))):
        files.save_table(spark.range(10), name, path)
        broken = spark.range(100).select(F.expr("if(id = 77, raise_error('stop'), id)").cast("bigint").alias("id"))
        with pytest.raises(PySparkException):
            files.save_table(broken, name, path)
        assert spark.table(name).count() == 10
        files.save_table(spark.range(3).withColumnRenamed("id", "n"), name, path)
        assert sorted(r.n for r in spark.table(name).collect()) == [0, 1, 2]
        assert [t for t in files.list_tables(spark) if t.startswith(name)] == [name]
    assert len(list((tmp_path / "t").iterdir())) == 1


def test_bucketed_table_groups_without_a_shuffle(spark):
    sales = star.sales(spark, SF, ["customer_id", "order_date", "order_year", "final_amount", "subcategory"])
    files.save_bucketed(sales, "bucketed_sales", buckets=4)
    table = spark.table("bucketed_sales")
    value = customers.lifetime_value(table)
    assert "Exchange" not in value._jdf.queryExecution().executedPlan().toString()
    assert sorted(value.collect()) == sorted(customers.lifetime_value(sales).collect())
    cohorts = customers.monthly_cohorts(table)
    assert "hashpartitioning(customer_id" not in cohorts._jdf.queryExecution().executedPlan().toString()


def test_table_counts(spark):
    files.save_table(spark.range(7), "seven")
    files.save_table(spark.range(0), "none")
    found = {tuple(r) for r in files.table_counts(spark, ["seven", "none"]).collect()}
    assert found == {("seven", 7), ("none", 0)} and files.table_counts(spark, []).count() == 0


def test_refresh_rewrites_one_month(spark, tmp_path):
    path = str(tmp_path / "rollup")
    sales = star.sales(spark, SF, ["order_date", "order_year", "final_amount", "quantity", "brand"])
    day = datetime.date(1996, 3, 5)
    rollup.write_rollup(sales.where(F.col("order_date") != F.lit(day)), path, ["brand"])

    def written():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "rollup").rglob("*.parquet")}

    before = written()
    assert rollup.refresh_rollup(sales, path, [day], ["brand"]) == ["1996-03"]
    after = written()
    assert {p for p in set(before) ^ set(after)} == {
        p for p in [*before, *after] if "month=1996-03" in p
    } and len(set(after) - set(before)) == 1
    found = rollup.read_rollup(spark, path)
    direct = rollup.daily_totals(sales, ["brand"])
    columns = sorted(direct.columns)
    assert sorted(found.select(columns).collect(), key=str) == sorted(direct.select(columns).collect(), key=str)
    for period in ("M", "Q", "Y"):
        assert sorted(rollup.range_trend(found, period).collect()) == sorted(dashboard.trend(sales, period).collect())
    ranged = rollup.range_kpis(found, "1996-02-10", "1996-04-20", "amounts")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert ranged.first() == dashboard.kpis(sales, "1996-02-10", "1996-04-20", "amounts").first()
    # A month whose sales are gone loses its rows; no days change nothing.
    rollup.refresh_rollup(sales.where("order_date < '1996-03-01'"), path, [day], ["brand"])
    assert rollup.read_rollup(spark, path).where("month = '1996-03'").count() == 0
    assert rollup.refresh_rollup(sales, path, []) == []


def test_preview_and_export_take_the_columns_there_are(spark, tmp_path):
    view = schema.dashboard_view(star.sales(spark, SF, ["transaction_id", "order_date", "final_amount"]))
    shown = files.preview(view, files.PREVIEW_COLUMNS)
    assert shown.columns == ["order_datetime", "transaction_id", "revenue"] and shown.count() == 200
    files.export_csv(view, str(tmp_path / "export"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "export")).count() == view.count()


def test_profile(spark):
    rows = spark.createDataFrame([("a", 1.0), (None, float("nan")), ("a", 2.0), ("b", None)], "k string, v double")
    found = {r.column: r for r in profile.profile(rows, "exact").collect()}
    assert (found["k"].missing, found["k"].missing_percent, found["k"].distinct_values) == (1, 25.0, 2)
    assert (found["v"].missing, found["v"].type) == (2, "double")


RAW = {
    "transaction_id": "t1", "order_date": "25/01/2015", "customer_id": "c", "product_id": "p",
    "category": "electronicss", "subcategory": "phones", "brand": "b",
    "original_price_inr": "₹1,000.00", "discounted_price_inr": "900", "quantity": "2",
    "subtotal_inr": "1800", "delivery_charges": None, "final_amount_inr": "1800.0",
    "customer_city": " bombay ", "customer_state": "s", "customer_tier": "Metro",
    "customer_age_group": None, "is_prime_member": "Yes", "is_festival_sale": "0",
    "festival_name": None, "payment_method": "PhonePe", "delivery_days": "1-2 days",
    "customer_rating": None, "product_rating": "4.5/5", "return_status": "Delivered",
}


def raw_rows(spark):
    rows = [RAW, {**RAW, "transaction_id": "t2"}, {**RAW, "transaction_id": "t3", "quantity": "5", "customer_id": "d"}]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{n} string" for n in RAW))


def test_cleaning_job(spark, tmp_path):
    cleaned = cleaning.clean_sales(raw_rows(spark), staging=str(tmp_path / "typed"))
    rows = {r.transaction_id: r for r in cleaned.collect()}
    first = rows["t1"]
    assert first.order_date == datetime.date(2015, 1, 25) and first.order_year == 2015
    assert (first.category, first.customer_city, first.payment_method) == ("Electronics", "Mumbai", "UPI")
    assert (first.original_price, first.final_amount) == (Decimal("1000.00"), Decimal("1800.00"))
    assert (first.is_prime_member, first.is_festival_sale) == (True, False)
    assert (first.delivery_days, first.product_rating, first.customer_rating) == (2.0, 4.5, None)
    assert (first.customer_age_group, first.delivery_charges) == ("26-35", Decimal("0.00"))
    assert first.duplicate_type == rows["t2"].duplicate_type == "bulk_order"
    assert rows["t3"].duplicate_type == "normal" and not rows["t3"].is_duplicate
    counts = cleaning.quality_counts(cleaned).first()
    assert (counts.rows, counts.duplicates, counts.bulk_orders) == (3, 2, 2)


def test_final_fills_are_an_option(spark):
    final = cleaning.clean_sales(raw_rows(spark).withColumn("payment_method", F.lit("Cheque")), final=True)
    row = final.first()
    assert (row.customer_rating, row.payment_method) == (-1.0, "Not define")


def test_cleaned_names_become_the_contract(spark):
    rows = spark.createDataFrame(
        [("2015-01-02", "2015-01-02", "12.5", "x")],
        "order_date string, clean_order_date string, clean_final_amount_inr string, cleaned_category string",
    )
    found = schema.from_cleaned_names(rows)
    assert found.columns == ["order_date", "final_amount", "category"]
    assert found.first() == (datetime.date(2015, 1, 2), Decimal("12.50"), "x")


def test_nan_is_missing_after_reading(spark, tmp_path):
    rows = spark.createDataFrame([("a", float("nan")), ("b", 2.0)], "product_id string, product_rating double")
    rows.write.parquet(str(tmp_path / "sales"))
    read = files.read_sales(spark, str(tmp_path / "sales"))
    assert read.agg({"product_rating": "max"}).first()[0] == 2.0


def test_staged_copies_can_be_released(spark):
    from orderlens.operators.settle import release, stage

    staged = stage(spark.range(5).toDF("x"))
    folder = staged.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    release(staged)
    assert not os.path.isdir(folder)


def test_report_run_writes_its_tables(spark, tmp_path):
    from orderlens.plans import reports

    sales = star.sales(spark, SF)
    wanted = ["yearly_revenue", "brand_by_month", "customer_health", "return_rate"]
    written = reports.write_all_reports(sales, str(tmp_path / "reports"), wanted)
    assert list(written) == wanted and len(reports.REPORTS) == len(reports.PLANS)
    for name, path in written.items():
        read = spark.read.option("header", "true").csv(path)
        assert read.columns == reports.REPORTS[name](sales).columns and read.count() > 0


def test_report_run_agrees_with_sql(spark, tmp_path):
    """Every report that has a registered query of its name, written, read back and compared with the SQL."""
    from checks.compare import compare, connect
    from checks.registry import ORACLES, plain
    from orderlens.plans import reports

    import __spark_entry__  # noqa: F401  (registers the queries)

    # Matrices are registered in their long form.
    wanted = sorted((set(reports.REPORTS) & set(ORACLES)) - {"journey_matrix", "transition_matrix", "revenue_heatmap"})
    assert len(wanted) > 33
    digits = {"brand_position": {"average_price": 8}}
    written = reports.write_all_reports(star.sales(spark, SF), str(tmp_path / "all"), wanted, "parquet")
    duck = connect(SF)
    wrong = {}
    for name, path in written.items():
        same, note = compare(spark, duck, lambda s, _, n=name, p=path: plain(s.read.parquet(p), digits.get(n)), ORACLES[name], SF)
        if not same:
            wrong[name] = note
    assert not wrong, wrong
