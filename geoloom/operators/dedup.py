"""Which row of a key wins, set operations on keys, and idempotent writes.

Winners are chosen by aggregation (max_by and min_by of whole rows), which combines before it shuffles,
so a key that holds a third of all rows costs one partial row a task. Ties are settled by all orders given,
so give a unique one last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _winner(df: DataFrame, keys: list[str], order: list[Column], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(pick(row, by).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The least row of each key by these orders. Null keys are one key."""
    return _winner(df, keys, list(order), F.min_by)


def last_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The greatest row of each key by these orders. Null keys are one key."""
    return _winner(df, keys, list(order), F.max_by)


def conflicts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both sides define."""
    return a.select(*keys).intersect(b.select(*keys))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with the number of them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def must_be_empty(df: DataFrame, message: str) -> None:
    """An error that names one offending row, unless there is none."""
    found = df.first()
    if found is not None:
        raise ValueError(f"{message}: {found.asDict()}")


def append_once(stored: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """stored and the first incoming row of each key that it lacks: the effect of an insert that ignores conflicts."""
    return stored.unionByName(first_wins(incoming, keys, *order).join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def submissions(df: DataFrame, keys: list[str], order: list[Column], result: list[str]) -> DataFrame:
    """Each submission with the result that is stored for its key, and whether it was the one that stored it.

    The result is that of the first submission of the key; the hot key's rows aren't brought together, as the
    firsts are joined back and the large side of that join can be split.
    """
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    firsts = df.groupBy(*keys).agg(F.min(by).alias("__first"), F.min_by(F.struct(*[F.col(c) for c in result]), by).alias("__stored"))
    keep = [c for c in df.columns if c not in result]
    return df.join(firsts, keys).select(*keep, *[F.col(f"__stored.{c}").alias(c) for c in result], (by == F.col("__first")).alias("inserted"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming, and those of existing whose keys it lacks."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def overridden(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """base, with values of override where a row of it matches and has one; columns of override only are added."""
    renamed = override.select(*keys, *[F.col(c).alias(f"__{c}") for c in override.columns if c not in keys])
    joined = base.join(renamed, keys, "left")
    own = [c for c in base.columns if c not in keys]
    new = [c for c in override.columns if c not in keys and c not in own]
    return joined.select(*keys, *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in override.columns else F.col(c) for c in own], *[F.col(f"__{c}").alias(c) for c in new])


def replicated(df: DataFrame, times: int) -> DataFrame:
    """Every row so many times, made where it is: nothing is shuffled."""
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__copy") if times > 1 else df


def weighted_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Union by name of tables, each so many times."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [replicated(df, n) for df, n in parts])


def finalised(planned: DataFrame, failed: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """Each planned key with whether it is included, and why not: failed goes before missing."""
    marked = planned.select(key).distinct().join(failed.select(key).distinct().withColumn("__f", F.lit(True)), key, "left").join(missing.select(key).distinct().withColumn("__m", F.lit(True)), key, "left")
    reason = F.when(F.col("__f"), "failed").when(F.col("__m"), "missing")
    return marked.select(key, reason.isNull().alias("included"), reason.alias("reason"))
