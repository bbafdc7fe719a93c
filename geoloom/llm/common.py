"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an output batch that a task hands back at a time.
OUT_ROWS = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is set, one of our own if all run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by reliable files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written to a Parquet table of its own in the shared folder and read again: compressed, pruned and pushed into."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a worker keeps between tasks: the last large thing that was asked for.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What make gives, kept by its name in a worker until another is asked for, so that workers that later stages use again hold no automaton or vocabulary of an earlier one."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, with value computed once however often body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def out_batches(rows: Iterable[tuple], schema: T.StructType, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most size rows each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over plain tuples: rows gets an iterator over a partition's rows and yields output rows."""
    made = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return out_batches(rows(t for b in batches for t in zip(*(c.to_pylist() for c in b.columns), strict=True)), made)

    return df.mapInArrow(run, made)
