"""Places within groups and within whole tables, shards, batches and progress.

Places over a whole table don't bring it into one task: rows are sorted by range, counted by partition, and
each partition adds the rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed


def placed(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with each row's place from 0 over the whole table, by columns that together are unique."""
    part, own = f"__part_{name}", f"__own_{name}"
    sorted_ = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    counts = {r[part]: r["count"] for r in sorted_.groupBy(part).count().collect()}  # one number a partition
    start, starts = 0, []
    for i in range(max(counts, default=-1) + 1):
        starts.append(start)
        start += counts.get(i, 0)
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return sorted_.withColumn(own, local).withColumn(name, (F.col(own) + F.get(F.array(*[F.lit(s) for s in starts]), F.col(part))).cast("long")).drop(part, own)


def second_half(maps: DataFrame, key: str = "map_id") -> DataFrame:
    """maps with ranked_pool: whether a map stands in the second half by its key."""
    n = maps.count()
    return placed(maps, key).withColumn("ranked_pool", F.col("place") >= n // 2).drop("place")


def sharded(files: DataFrame, name: str, per_shard: int) -> DataFrame:
    """files with shard_path: so many a shard, by name, as sNNNNN/name."""
    at = F.floor(F.col("place") / per_shard)
    return placed(files, name).withColumn("shard_path", F.concat(F.format_string("s%05d/", at), F.col(name))).drop("place")


def batched(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with batch_id and their place in it."""
    return placed(rows, order).withColumn("batch_id", F.floor(F.col("place") / size)).withColumn("in_batch", F.col("place") % size).drop("place")


def upload_batches(files: DataFrame, name: str, bytes_: str, per_batch: int, alone_bytes: int) -> DataFrame:
    """files with batch_id: so many together by name, then each large file on its own."""
    small = placed(files.where(F.col(bytes_) < alone_bytes), name)
    large = placed(files.where(F.col(bytes_) >= alone_bytes), name)
    n_small = small.count()
    first = -(-n_small // per_batch)
    a = small.withColumn("batch_id", F.floor(F.col("place") / per_batch))
    return a.unionByName(large.withColumn("batch_id", F.col("place") + first)).drop("place")


def reranked(packs: DataFrame, group: str, *order: str) -> DataFrame:
    """packs with rank from 1 within each group by these orders."""
    return packs.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("int"))


def within_bases(df: DataFrame, base: Column, most: int) -> DataFrame:
    """All rows of the first so many bases in order. The bases are found by a top-k over distinct values."""
    first = df.select(base.alias("__base")).distinct().orderBy("__base").limit(most)
    return df.withColumn("__base", base).join(F.broadcast(first), "__base", "left_semi").drop("__base") if most <= 100_000 else df.withColumn("__base", base).join(first, "__base", "left_semi").drop("__base")


def best_candidates(df: DataFrame, group: str, text: str, rank: Column) -> DataFrame:
    """The text of each group with the greatest rank; ties go to the lesser text."""
    r = df.withColumn("__r", rank)
    by = F.struct((-F.col("__r.opener_ok")).alias("a"), (-F.col("__r.fewer")).alias("b"), F.col(text).alias("c"))
    return r.groupBy(group).agg(F.min_by(text, by).alias(text))


def trimmed_queue(rows: DataFrame, group: str, keep: int = 120) -> DataFrame:
    """The newest rows of each group, so many at most."""
    newest = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("__n", newest).where(F.col("__n") <= keep).drop("__n")


def memory_stability(rounds: DataFrame, last: int = 10, enough: int = 3) -> DataFrame:
    """(user_id, stability, band): how a user's latest rounds stand in the user's own history.

    Each of the latest rounds gets the share of earlier or equal results that it beats on its map, or over all maps
    where the map has fewer than enough rounds; the median goes through a smooth step onto 0 to 100.
    Users' histories are bounded by play, and ranks are counted by distinct score first.
    """
    def ranks(keys: list[str]) -> DataFrame:
        counts = rounds.groupBy(*keys, "score_points").agg(F.count("*").alias("n"))
        w = Window.partitionBy(*keys)
        below = F.coalesce(F.sum("n").over(w.orderBy("score_points").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        total = F.sum("n").over(w)
        tag = "_".join(keys)
        return counts.select(*keys, "score_points", F.when(total > 1, below / (total - 1)).otherwise(F.lit(1.0)).alias(f"p_{tag}"), total.alias(f"n_{tag}"))

    latest = rounds.withColumn("__n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("saved_at"), F.desc("round_id")))).where(F.col("__n") <= last)
    both = latest.join(ranks(["user_id", "map_id"]), ["user_id", "map_id", "score_points"]).join(ranks(["user_id"]), ["user_id", "score_points"])
    share = F.when(F.col("n_user_id_map_id") >= enough, F.col("p_user_id_map_id")).otherwise(F.col("p_user_id"))
    mid = both.groupBy("user_id").agg(F.median(share).alias("m"))
    value = F.bround(F.col("m") * F.col("m") * (3 - 2 * F.col("m")) * 100, 2)
    return mid.select("user_id", value.alias("stability"), F.when(value >= 80, "stable").when(value >= 55, "steady").when(value >= 30, "variable").otherwise("volatile").alias("band"))


def tier_progress(users: DataFrame, tiers: list[tuple[str, int, int]]) -> DataFrame:
    """users (user_id, xp) with their tier and percent of the way through it; tiers are (name, floor, ceiling), the last one open."""
    tier, percent = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, low, high in tiers:
        here = (F.col("xp") >= low) & ((F.col("xp") < high) | F.lit((name, low, high) == tiers[-1]))
        share = F.bround((F.col("xp") - low) * 100.0 / max(1, high - low), 0).cast("int")
        tier = F.when(here, F.lit(name)).otherwise(tier)
        percent = F.when(here, F.greatest(F.lit(0), F.least(F.lit(100), share))).otherwise(percent)
    return users.withColumn("tier", tier).withColumn("percent", percent)
