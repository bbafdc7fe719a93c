"""Writers: the same rows as files that others read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_json_lines(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    """JSON lines, a folder for each split."""
    df.write.mode(mode).partitionBy(split).option("ignoreNullFields", "false").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def parquet_shards(df: DataFrame, path: str, rows: int = 4096) -> None:
    """Parquet files of so many rows at most."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def by_value(df: DataFrame, path: str, column: str) -> None:
    """A folder of JSON lines for each value of a column; rows are dealt by it and split where a value has many."""
    df.repartition(F.col(column), F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy(column).json(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """(document): each row as compact JSON with its columns in order of name."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("document"))


def text_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def maps_yaml(maps: DataFrame, path: str, version: str, *, flags: tuple[str, ...] = ("local_only", "ranked_pool")) -> None:
    """A YAML list of maps (map_id, title and flags) in order of their ids, under a version: one part file for each range of ids, the first with the head."""
    from ..functions import yaml
    from ..operators.ranking import placed

    flag = lambda c: F.concat(F.lit(f"\n  {c}: "), F.coalesce(F.col(c), F.lit(False)).cast("string"))
    entry = F.concat(F.lit("- map_id: "), yaml.quoted(F.col("map_id")), F.lit("\n  title: "), yaml.quoted(F.col("title")), *[flag(c) for c in flags if c in maps.columns])
    head = F.concat(F.lit("content_version: "), yaml.quoted(F.lit(version)), F.lit("\nmaps:\n"))
    rows = placed(maps, "map_id").select("place", F.when(F.col("place") == 0, F.concat(head, entry)).otherwise(entry).alias("value"))
    text_lines(rows.repartitionByRange("place").sortWithinPartitions("place"), "value", path)


def append_with_ids(stored: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """incoming with ids that go on from the greatest stored one, in an order."""
    from ..operators.ranking import placed

    start = stored.agg(F.coalesce(F.max(key), F.lit(0).cast("long")).alias("m")).first()["m"]
    return placed(incoming, *order).withColumn(key, F.col("place") + 1 + int(start)).drop("place")


def table_upsert(df: DataFrame, existing: DataFrame, keys: list[str], path: str) -> None:
    """existing with df's rows for the keys that df has, written to a path of its own (never the one that existing is read from)."""
    from ..operators.dedup import upsert

    upsert(existing, df, keys).write.mode("overwrite").parquet(path)
