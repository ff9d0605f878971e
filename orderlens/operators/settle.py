"""Keeping an intermediate result that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``: storage all executors reach.

    A session without that setting (tests, a caller's own session) gets a folder
    beside its tables, which every executor must reach anyway.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute a (small) ``df`` once and keep it in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a large ``df`` once as Parquet, in ``path`` or the shared folder, and read it back.

    Later steps then scan only the columns they need. ``release`` removes the
    copy once no result that reads it is needed any more.
    """
    spark = df.sparkSession
    target = path or f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def release(staged: DataFrame) -> None:
    """Delete the files of a staged copy, wherever the session's file system keeps them."""
    spark = staged.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
