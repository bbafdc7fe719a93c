"""Stores as streams: appends once per key, replay windows, jobs and rounds that expire.

Every stream takes and gives DataFrames with isStreaming; state is bounded by watermarks or timeouts, whose
horizon is a parameter: a key that comes again after it counts as new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo
from ..operators.stores import ROUND_AGE


def append_once(rows: DataFrame, keys: list[str], at: str, horizon: str = "7 days") -> DataFrame:
    """The first row of each key within a horizon."""
    return rows.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def fresh_nonces(requests: DataFrame, skew_seconds: int = 300) -> DataFrame:
    """Requests (nonce, sent_at, received_at) in time whose nonce wasn't seen within the skew."""
    gap = F.abs(F.unix_micros("received_at") - F.unix_micros("sent_at"))
    return requests.where(gap <= skew_seconds * 1_000_000).withWatermark("received_at", f"{2 * skew_seconds} seconds").dropDuplicatesWithinWatermark(["nonce"])


def scored_submissions(submits: DataFrame, rounds: DataFrame, at: str = "submitted_at", horizon: str = "7 days") -> DataFrame:
    """Submissions (round_id, key, guess_lat, guess_lon, at), each key once, with distance and score by a static table of rounds."""
    once = append_once(submits, ["round_id", "key"], at, horizon)
    joined = once.join(rounds.where("status = 'open'").select("round_id", "map_id", "truth_lat", "truth_lon"), "round_id")
    km = geo.haversine_km(F.col("guess_lat"), F.col("guess_lon"), F.col("truth_lat"), F.col("truth_lon"), geo.RADIUS_RANKED_KM)
    return joined.withColumn("distance_km", km).withColumn("score_points", geo.score_ranked(F.col("distance_km")))


def windowed_counts(rows: DataFrame, at: str, group: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, group, n, points) by tumbling windows."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum("score_points").alias("points")).select(F.col("w.start").alias("window_start"), group, "n", "points")


def expired_rounds(opened: DataFrame, max_age_seconds: int = ROUND_AGE) -> DataFrame:
    """(round_id, opened_at): rounds of a stream (round_id, status, at) that are still open when their age is reached, by event time."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], since)], columns=["round_id", "opened_at"])
            return
        closed, first = False, None
        for b in batches:  # one after the other, however many rows a round has
            closed = closed or bool((b["status"] != "open").any())
            first = b["at"].min() if first is None else min(first, b["at"].min())
        if closed:
            if state.exists:
                state.remove()
            return
        if not state.exists:
            state.update((first.to_pydatetime(),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(state.get[0].timestamp() * 1000) + max_age_seconds * 1000))

    marked = opened.withWatermark("at", "0 seconds")
    return marked.groupBy("round_id").applyInPandasWithState(step, "round_id string, opened_at timestamp", "opened_at timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def latest_by_key(df: DataFrame, epoch: int, path: str, keys: list[str], at: str) -> None:
    """For foreachBatch: the newest row of each key of a batch, appended with its epoch; readers take the last by epoch."""
    from ..operators.dedup import last_wins

    last_wins(df, keys, F.col(at), F.xxhash64(*[F.col(c) for c in df.columns])).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)
