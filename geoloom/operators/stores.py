"""Leaderboards, rounds and jobs: ordered reads, guarded changes of state and expiry, on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

# States of jobs and which may follow which.
TERMINAL = ["completed", "failed", "cancelled"]
NEXT_STATES = {"queued": ["running", "cancelled"], "running": ["completed", "failed", "cancelled"]}
# Ages in seconds at which open rounds and finished jobs go.
ROUND_AGE, JOB_AGE = 604_800, 86_400
# Seconds to wait before each further try, and tries at most.
BACKOFF = [5, 15, 60, 300, 900, 3600]
MOST_TRIES = 24


def scored_guesses(guesses: DataFrame) -> DataFrame:
    """guesses (guess_lat, guess_lon, truth_lat, truth_lon) with their distance and ranked score."""
    km = geo.haversine_km(F.col("guess_lat"), F.col("guess_lon"), F.col("truth_lat"), F.col("truth_lon"), geo.RADIUS_RANKED_KM)
    return guesses.withColumn("distance_km", km).withColumn("score_points", geo.score_ranked(F.col("distance_km")))


def ranked_board(rows: DataFrame) -> DataFrame:
    """(map_id, place, id, handle, score_points, distance_km): every row of every map by score, ties by id.

    Places are counted in two steps, so that one large map isn't one task: a row's place is the number of rows
    of its map with a greater score, from counts by score, and then its place within its score.
    """
    by_score = rows.groupBy("map_id", "score_points").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("map_id").orderBy(F.desc("score_points")).rowsBetween(Window.unboundedPreceding, -1))
    starts = by_score.select("map_id", "score_points", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("map_id", "score_points").orderBy("id"))
    handle = F.concat(F.lit("RNK-"), F.upper(F.substring(F.col("session_id").cast("string"), 1, 8)))
    return rows.withColumn("__in", within).join(starts, ["map_id", "score_points"]).select("map_id", (F.col("__start") + F.col("__in")).cast("long").alias("place"), "id", handle.alias("handle"), "score_points", "distance_km")


def top_of_board(rows: DataFrame, k: int) -> DataFrame:
    """The best k rows of each map. Spark cuts each task's rows to k a map before it shuffles them (window group limit)."""
    place = F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("score_points"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def recent_jobs(jobs: DataFrame, session: Column, statuses: list[str] | None, limit: int) -> DataFrame:
    """A session's latest jobs, at most 100."""
    mine = jobs.where(session)
    return (mine.where(F.col("status").isin(statuses)) if statuses else mine).orderBy(F.desc("created_at"), "job_id").limit(max(1, min(100, limit)))


def queue_head(jobs: DataFrame, limit: int) -> DataFrame:
    """The jobs that have waited longest, at most 500."""
    return jobs.where(F.col("status") == "queued").orderBy("created_at", "job_id").limit(max(1, min(500, limit)))


def due_head(rows: DataFrame, now: Column) -> DataFrame:
    """The oldest row whose next try is due."""
    return rows.where(F.col("next_attempt") <= now).orderBy("created_at", "id").limit(1)


def transitioned(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs after changes (job_id, expected, to_status, at): a job whose status isn't the expected one, or can't be followed so, stays; column changed tells.

    A job has one change at most: the earliest that was sent for it.
    """
    first = changes.groupBy("job_id").agg(F.min_by(F.struct("expected", "to_status"), F.struct("at", "to_status")).alias("__c"))
    joined = jobs.join(first, "job_id", "left")
    follows = F.lit(False)
    for state, nexts in NEXT_STATES.items():
        follows = follows | ((F.col("status") == state) & F.col("__c.to_status").isin(nexts))
    ok = F.coalesce((F.col("__c.expected") == F.col("status")) & follows, F.lit(False))
    return joined.withColumn("changed", ok).withColumn("status", F.when(ok, F.col("__c.to_status")).otherwise(F.col("status"))).drop("__c")


def without_stale_rounds(rounds: DataFrame, now_epoch: Column, most_age: int = ROUND_AGE) -> DataFrame:
    """rounds but for those open since longer than most_age seconds; all of them if the cutoff isn't after 0."""
    cutoff = now_epoch - most_age
    return rounds.where(~((F.col("status") == "open") & (F.col("opened_at_epoch") < cutoff) & (cutoff > 0)) | F.col("status").isNull() | F.col("opened_at_epoch").isNull())


def without_old_jobs(jobs: DataFrame, now: Column, ttl_seconds: int = JOB_AGE) -> DataFrame:
    """jobs but for finished ones of long ago, by time and not by text."""
    old = F.col("finished_at").cast("timestamp") < now - F.make_interval(secs=F.lit(ttl_seconds))
    return jobs.where(~(F.col("status").isin(TERMINAL) & F.coalesce(old, F.lit(False))))


def next_try(attempts: Column, last: Column, jitter: Column) -> Column:
    """When to try again, or null after the last try: the wait grows with the attempts, plus up to a tenth by a jitter in [0, 1)."""
    waits = F.array(*[F.lit(float(x)) for x in BACKOFF])
    wait = F.element_at(waits, F.greatest(F.lit(1), F.least(F.lit(len(BACKOFF)), attempts)))
    return F.when(attempts < MOST_TRIES, F.timestamp_micros((F.unix_micros(last.cast("timestamp")) + wait * (jitter * 0.1 + 1.0) * 1_000_000).cast("long")))


def career(rounds: DataFrame, recent: int = 200) -> DataFrame:
    """(user_id, rounds, points, last_round_id, n_recent_maps): counters of each user; the maps count among a user's latest `recent` different ones."""
    maps = rounds.select("user_id", "map_id").distinct().groupBy("user_id").agg(F.least(F.count("map_id"), F.lit(recent)).alias("n_recent_maps"))
    sums = rounds.groupBy("user_id").agg(F.count("*").alias("rounds"), F.sum(F.greatest(F.col("score_points"), F.lit(0))).alias("points"), F.max_by("round_id", F.struct("saved_at", "round_id")).alias("last_round_id"))
    return sums.join(maps, "user_id")


def job_groups(jobs: DataFrame, group: str) -> DataFrame:
    """One row for each group of jobs: first start, last finish, all artifacts, profiles joined, first error, worst status."""
    by = F.struct("created_at", "job_id")
    worst = F.max(F.when(F.col("status") == "failed", 3).when(F.col("status").isin("queued", "running"), 2).when(F.col("status") == "cancelled", 1).otherwise(0))
    out = jobs.groupBy(group).agg(
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.array_sort(F.collect_set("artifact")).alias("artifacts"),
        F.array_join(F.array_sort(F.collect_set("profile")), "+").alias("profiles"), F.min_by("error", F.when(F.col("error").isNotNull(), by)).alias("error"), worst.alias("__w"), F.count("*").alias("n_jobs"),
    )
    return out.withColumn("status", F.element_at(F.array(*[F.lit(s) for s in ("completed", "cancelled", "running", "failed")]), (F.col("__w") + 1).cast("int"))).drop("__w")


def visit_counts(visits: DataFrame, key: Column) -> DataFrame:
    """(screen, n): visits by their name in lower case without outer space; blank names don't count."""
    name = F.lower(F.trim(key))
    return visits.where(name != "").groupBy(name.alias("screen")).agg(F.count("*").alias("n"))
