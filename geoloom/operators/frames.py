"""Cutting a plan's lineage by reliable files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the folder that the cluster shares (spark.checkpoint.dir); where none is set, in one of our own if all runs on this machine."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as the cluster has cores or shuffles have partitions, however small it is."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as checkpoints use it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or os.path.join(os.getcwd(), "spark-warehouse", "checkpoints"))
    return context.getCheckpointDir()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df from a Parquet table in the shared folder, into which filters are pushed, as long as the block runs; the table is deleted after it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
