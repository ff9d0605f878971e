"""CSV, Parquet and catalogue tables in; cleaned data, reports and tables out."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.sources.schema import MISSING_TOKENS, without_nan

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
YEARLY_FILES = "*20*.csv"  # fixed value: file names that hold a year
PREVIEW_ROWS = 200  # fixed value
PREVIEW_COLUMNS = ("order_datetime", "transaction_id", "customer_id", "revenue")  # fixed value


def blank_to_null(df: DataFrame) -> DataFrame:
    """Texts that mean "no value" become NULL."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)).alias(c) if c in text else F.col(c)
            for c in df.columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """All-text read (no inference pass over the data); types come later, in cleaning."""
    reader = spark.read.options(**CSV_OPTIONS)
    if schema is not None:
        reader = reader.schema(schema)
    return blank_to_null(reader.csv(path))


def _file_system(spark: SparkSession, path: str):
    """The path and its file system, whichever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def headers(spark: SparkSession, folder: str, names: str = YEARLY_FILES) -> dict[str, str]:
    """Path and first line of every non-empty file in ``folder`` whose name fits.

    Files are listed and opened through Spark's own file systems and read up to their
    first line end: what is read depends on the number of files, not on their size.
    """
    place, system = _file_system(spark, folder)
    java = spark.sparkContext._jvm.java
    found = {}
    for status in sorted(system.listStatus(place), key=lambda s: s.getPath().toString()):
        path = status.getPath()
        if not status.isFile() or not fnmatch.fnmatchcase(path.getName(), names):
            continue
        stream = system.open(path)
        try:
            text = java.io.InputStreamReader(stream, java.nio.charset.StandardCharsets.UTF_8)
            line = java.io.BufferedReader(text, 1024).readLine()
        finally:
            stream.close()
        if line:
            found[path.toString()] = line.removeprefix("\ufeff")
    return found


def write_yearly_csv(df: DataFrame, folder: str, year: str, name: str = "sales") -> list[str]:
    """CSV files named by year, ``<name>_<year>_<number>.csv``, in one folder; returns their names.

    Rows without a year are left out. The files are written aside and moved into place.
    """
    aside = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    rows = df.where(F.col(year).isNotNull()).withColumn("_year", F.col(year)).hint("rebalance", F.col(year))
    writer = rows.write.partitionBy("_year").option("header", "true").option("escape", '"')
    writer.csv(aside)
    spark = df.sparkSession
    place, system = _file_system(spark, aside)
    names = []
    for part in sorted(system.listStatus(place), key=lambda s: s.getPath().getName()):
        _, _, value = part.getPath().getName().partition("=")
        if not value:
            continue
        written = sorted(f.getPath().toString() for f in system.listStatus(part.getPath()))
        for number, path in enumerate(written):
            names.append(f"{name}_{value}_{number}.csv")
            target, _ = _file_system(spark, f"{folder.rstrip('/')}/{names[-1]}")
            system.delete(target, False)
            if not system.rename(_file_system(spark, path)[0], target):
                raise OSError(f"{path} could not be moved to {target.toString()}")
    system.delete(place, True)
    return names


def read_yearly_csv(
    spark: SparkSession, folder: str, schema: T.StructType | None = None
) -> DataFrame:
    """Union of a folder's yearly CSV files.

    With a ``schema`` (all files alike) this is one scan. Without one, files are
    grouped by their header line and united by column name, so years with extra
    or missing columns fit together. Only file names and header lines (``headers``) are
    looked at while planning.
    """
    if schema is not None:
        reader = spark.read.options(**CSV_OPTIONS, pathGlobFilter=YEARLY_FILES).schema(schema)
        return blank_to_null(reader.csv(folder))
    by_header: dict[str, list[str]] = {}
    for path, header in headers(spark, folder).items():
        by_header.setdefault(header, []).append(path)
    if not by_header:
        raise FileNotFoundError(f"no file matching {YEARLY_FILES} in {folder}")
    parts = [read_csv(spark, paths) for paths in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return without_nan(spark.read.parquet(path))


def write_sales(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned data, one folder per order year so that date filters skip whole years.

    Rows are rebalanced by year before writing: a year's rows come together in as
    many files of the advisory size as they fill, however uneven the years are.
    """
    writer = df.hint("rebalance", F.col("order_year")).write.mode("overwrite")
    writer = writer.partitionBy("order_year")
    if fmt == "csv":
        writer = writer.option("header", "true").option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)


def write_report(df: DataFrame, folder: str, name: str, fmt: str = "csv") -> str:
    """One report table, keys included; returns where it went."""
    path = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return path


def save_table(df: DataFrame, name: str = "transactions", path: str | None = None) -> None:
    """Replace a catalogue table, all at once.

    The rows are written to a table aside first (with ``path``: to a folder of their own
    in it); only when all of them are there do the two tables swap names. A write that
    fails leaves the old table as it was.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    new, old = f"{name}__new_{mark}", f"{name}__old_{mark}"
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", f"{path.rstrip('/')}/{mark}")
    try:
        writer.saveAsTable(new)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        if path:
            _delete(spark, f"{path.rstrip('/')}/{mark}")
        raise
    replaced = spark.catalog.tableExists(name)
    if replaced:
        folder = _table_folder(spark, name)
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    except Exception:
        if replaced:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    if replaced:
        spark.sql(f"DROP TABLE {old}")
        # Dropping an external table keeps its files; only folders made here are deleted.
        if path and folder and _same_parent(spark, folder, path):
            _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    place, system = _file_system(spark, folder)
    system.delete(place, True)


def _same_parent(spark: SparkSession, folder: str, path: str) -> bool:
    place, system = _file_system(spark, path)
    return _file_system(spark, folder)[0].getParent().equals(system.makeQualified(place))


def _table_folder(spark: SparkSession, name: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0].data_type if rows else None


def save_bucketed(
    df: DataFrame, name: str, key: str = "customer_id", buckets: int = 200, path: str | None = None
) -> None:
    """Replace a catalogue table bucketed and sorted by ``key``.

    Grouping, joining and windows by that key then need no shuffle; choose ``buckets`` so that
    a bucket fits a task. Rows meet per bucket before writing, so a bucket is one file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_jdbc(df: DataFrame, url: str, table: str = "transactions", **properties: str) -> None:
    """Replace a table of an external database, 20,000 rows per statement batch."""
    df.write.jdbc(
        url, table, mode="overwrite", properties={"batchsize": "20000", **properties}
    )


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(table.name for table in spark.catalog.listTables())


def table_counts(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """``table, rows`` of the named tables (default: all), counted in one job."""
    counts = [
        spark.table(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name in (list_tables(spark) if names is None else names)
    ]
    if not counts:
        return spark.createDataFrame([], "table string, rows long")
    return reduce(DataFrame.unionAll, counts)


def table_rows(spark: SparkSession, name: str = "transactions") -> DataFrame:
    return spark.table(name).agg(F.count(F.lit(1)).alias("rows"))


def available(df: DataFrame, columns: Sequence[str] = PREVIEW_COLUMNS) -> DataFrame:
    """The wanted columns, as far as the data has them."""
    return df.select(*[c for c in columns if c in df.columns])


def preview(df: DataFrame, columns: Sequence[str] | None = None, rows: int = PREVIEW_ROWS) -> DataFrame:
    return (available(df, columns) if columns else df).limit(rows)


def export_csv(df: DataFrame, path: str, columns: Sequence[str] = PREVIEW_COLUMNS) -> None:
    """All rows of the wanted columns."""
    available(df, columns).write.mode("overwrite").option("header", "true").csv(path)
