"""Batches of a stream as files, each exactly once: a folder by batch id, and a commit that makes it count.

A batch that is run again after a failure writes its folder anew if it wasn't committed, and nothing if it was. Readers see committed batches alone, so a folder that a lost
driver left half-written is never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    """The filesystem of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commit_path(path: str, epoch: int) -> str:
    return f"{path}/{COMMITS}/{epoch:019d}.json"


def is_committed(spark: SparkSession, path: str, epoch: int) -> bool:
    fs, where = _fs(spark, _commit_path(path, epoch))
    return fs.exists(where)


def committed(spark: SparkSession, path: str) -> list[int]:
    """The ids of the committed batches, in order. They are as many as the stream had batches; compact() makes one of them."""
    fs, where = _fs(spark, f"{path}/{COMMITS}")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")) if fs.exists(where) else []


def _commit(spark: SparkSession, path: str, epoch: int, told: dict) -> None:
    """Marks a batch as whole: the file is written beside its place and then renamed, which either happens or doesn't."""
    target = _commit_path(path, epoch)
    fs, draft = _fs(spark, f"{target}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    _, final = _fs(spark, target)
    if not fs.rename(draft, final) and not fs.exists(final):
        raise OSError(f"can't commit batch {epoch} of {path}")


def flush(df: DataFrame, epoch: int, path: str, *, split: str | None = None, rows: int = 4096, before_commit: Callable[[int], None] | None = None) -> bool:
    """Writes a batch as Parquet shards of so many rows at most (by split, if one is named) and commits it; False if it was committed before.

    before_commit is called between the two, for what must be done with a batch that is whole but doesn't count yet.
    """
    spark = df.sparkSession
    if is_committed(spark, path, epoch):
        return False
    folder = f"{path}/batch={epoch}"
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows)
    (writer.partitionBy(split) if split else writer).parquet(folder)
    if before_commit is not None:
        before_commit(epoch)
    _commit(spark, path, epoch, {"batch": epoch, "columns": df.columns})
    return True


def flusher(path: str, **how) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch."""

    def run(df: DataFrame, epoch: int) -> None:
        flush(df, epoch, path, **how)

    return run


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with their batch; none if there is no batch."""
    epochs = committed(spark, path)
    if not epochs:
        return spark.createDataFrame([], f"{schema}, batch long")
    found = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(*[f"{path}/batch={e}" for e in epochs])
    return found.withColumn("batch", F.col("batch").cast("long"))


def compact(spark: SparkSession, path: str, target: str, schema: str, *, split: str | None = None, rows: int = 4096) -> int:
    """Writes all committed batches to another folder as its batch 0, in shards that are full; returns how many batches these were."""
    epochs = committed(spark, path)
    flush(read_committed(spark, path, schema).drop("batch"), 0, target, split=split, rows=rows)
    return len(epochs)
