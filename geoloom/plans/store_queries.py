"""Queries over leaderboards, rounds, jobs and progress, and over keys and orders in general."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as T
from ..operators import dedup, ranking, stores
from . import tables as t

NOW_SQL = "TIMESTAMP '2024-01-20 00:00:00'"
_SCORE = "CASE WHEN km <= 0 THEN 1000000 ELSE least(1000000, trunc(1000000 / (1.0::DOUBLE + km))::BIGINT) END"
#: Distances are rounded before they are scored, so that both engines' sines give the same points.
_SCORED = f"""(SELECT *, {_SCORE} AS score_points FROM (SELECT *, round({t.haversine_sql('guess_lat', 'guess_lon', 'truth_lat', 'truth_lon', 6371.0088)}, 6) AS km FROM ({t.GUESSES_SQL})))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return stores.scored_guesses(t.guesses(spark, d)).withColumn("distance_km", F.round("distance_km", 6)).withColumn("score_points", geo.score_ranked(F.col("distance_km")).cast("long"))


def ranked_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: one guess for each map and key, scored and placed."""
    once = dedup.first_wins(_scored(spark, d), ["map_id", "key"], F.col("ts"), F.col("id"))
    return stores.ranked_board(once)


def leaderboard_top10(spark: SparkSession, d: str) -> DataFrame:
    return stores.top_of_board(_scored(spark, d), 10).select("map_id", F.col("place").cast("long").alias("place"), "id", "score_points")


def community_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("map_id").agg(F.count("*").alias("n"), F.max("score_points").alias("best"), F.min("id").alias("first_id"))


def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    g = _scored(spark, d).select("id", "map_id", "key", "ts", "score_points")
    stored = dedup.first_wins(g.where("id % 3 = 0"), ["map_id", "key"], F.col("ts"), F.col("id"))
    return dedup.append_once(stored, g.where("id % 3 != 0"), ["map_id", "key"], F.col("ts"), F.col("id")).select("id", "map_id", "key", "score_points")


def idempotent_submissions(spark: SparkSession, d: str) -> DataFrame:
    g = _scored(spark, d).select("id", "map_id", "key", "ts", "score_points")
    return dedup.submissions(g, ["map_id", "key"], [F.col("ts"), F.col("id")], ["score_points"]).select("id", "map_id", "key", "score_points", "inserted")


def key_conflicts(spark: SparkSession, d: str) -> DataFrame:
    g = t.guesses(spark, d)
    return dedup.conflicts(g.where("id % 2 = 0"), g.where("id % 2 = 1"), ["map_id", "key"])


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicates(t.guesses(spark, d), ["map_id", "session_id", "key"])


def last_guess_wins(spark: SparkSession, d: str) -> DataFrame:
    return dedup.last_wins(t.guesses(spark, d), ["map_id", "session_id"], F.col("ts"), F.col("id")).select("map_id", "session_id", "id", "key")


def map_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("map_id"), F.col("c_name").alias("title"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("map_id"), F.upper("c_mktsegment").alias("title"))
    return dedup.upsert(old, new, ["map_id"])


def map_overrides(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("map_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    over = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("map_id"), F.when(F.col("c_custkey") % 8 == 0, F.lit("renamed")).alias("title"), F.lit("yes").alias("flag"))
    return dedup.overridden(base, over, ["map_id"])


def finalised_ids(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return dedup.finalised(c, c.where("id % 7 = 0"), c.where("id % 5 = 0"), "id")


def weighted_mix(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "documents")
    mix = dedup.weighted_union([(x.where("doc_id % 10 = 0").select("doc_id", F.lit("small").alias("part")), 8), (x.where("doc_id % 10 = 1").select("doc_id", F.lit("task").alias("part")), 3), (x.where("doc_id % 10 > 1").select("doc_id", F.lit("main").alias("part")), 1)])
    return mix.groupBy("part", "doc_id").agg(F.count("*").alias("n"))


def jobs_recent(spark: SparkSession, d: str) -> DataFrame:
    return stores.recent_jobs(t.jobs(spark, d), F.col("session") % 10 == 1, ["completed", "running"], 100).select("job_id", "status")


def jobs_queue_head(spark: SparkSession, d: str) -> DataFrame:
    return stores.queue_head(t.jobs(spark, d), 50).select("job_id", "created_at")


def jobs_transitions(spark: SparkSession, d: str) -> DataFrame:
    j = t.jobs(spark, d)
    ch = j.where("job_id % 3 = 0").select("job_id", F.when(F.col("job_id") % 2 == 0, "queued").otherwise("running").alias("expected"), F.when(F.col("job_id") % 2 == 0, "running").otherwise("completed").alias("to_status"), F.col("created_at").alias("at"))
    return stores.transitioned(j.select("job_id", "status"), ch)


def jobs_expired(spark: SparkSession, d: str) -> DataFrame:
    j = t.jobs(spark, d)
    return stores.without_old_jobs(j, F.lit("1998-01-01").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


def rounds_pruned(spark: SparkSession, d: str) -> DataFrame:
    r = t.guesses(spark, d).select("id", F.when(F.col("id") % 4 == 0, "closed").otherwise("open").alias("status"), F.unix_timestamp("ts").alias("opened_at_epoch"))
    return stores.without_stale_rounds(r, F.lit(1705708800)).groupBy("status").agg(F.count("*").alias("n"), F.min("opened_at_epoch").alias("oldest"))


def jobs_merged(spark: SparkSession, d: str) -> DataFrame:
    j = t.jobs(spark, d).select("session", "job_id", "status", "created_at", F.col("created_at").alias("started_at"), "finished_at", F.concat(F.lit("art_"), (F.col("job_id") % 3).cast("string")).alias("artifact"), F.lower(F.substring("priority", 1, 1)).alias("profile"), F.when(F.col("job_id") % 5 == 0, F.concat(F.lit("err"), F.col("job_id").cast("string"))).alias("error"))
    out = stores.job_groups(j, "session")
    return out.select("session", "started_at", "finished_at", F.array_join("artifacts", ",").alias("artifacts"), "profiles", "error", "status", "n_jobs")


def outbox_next_try(spark: SparkSession, d: str) -> DataFrame:
    g = t.guesses(spark, d)
    nxt = stores.next_try((F.col("id") % 30).cast("int"), F.col("ts"), (F.col("id") % 10) / F.lit(10.0))
    return g.select("id", F.unix_seconds(nxt).alias("next_epoch"))


def outbox_trimmed(spark: SparkSession, d: str) -> DataFrame:
    g = t.guesses(spark, d).withColumn("created_at", F.col("ts"))
    return ranking.trimmed_queue(g, "map_id", 120).select("map_id", "id")


def due_row(spark: SparkSession, d: str) -> DataFrame:
    g = t.guesses(spark, d).select("id", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 day")).alias("next_attempt"))
    return stores.due_head(g, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id")


def career_counters(spark: SparkSession, d: str) -> DataFrame:
    r = _scored(spark, d).select(F.col("session_id").alias("user_id"), "map_id", "score_points", F.col("id").alias("round_id"), F.col("ts").alias("saved_at"))
    return stores.career(r).select("user_id", "rounds", "points", "last_round_id", F.col("n_recent_maps").cast("long").alias("n_recent_maps"))


def screen_visits(spark: SparkSession, d: str) -> DataFrame:
    return stores.visit_counts(t.table(spark, d, "events"), F.concat(F.lit(" "), F.upper("event_type")))


def maps_second_half(spark: SparkSession, d: str) -> DataFrame:
    return ranking.second_half(t.table(spark, d, "customer").select(F.col("c_custkey").alias("map_id")))


def file_shards(spark: SparkSession, d: str) -> DataFrame:
    files = t.table(spark, d, "documents").select(F.format_string("doc_%08d.txt", "doc_id").alias("name"))
    return ranking.sharded(files, "name", 64)


def upload_batches(spark: SparkSession, d: str) -> DataFrame:
    files = t.table(spark, d, "documents").select(F.format_string("doc_%08d.txt", "doc_id").alias("name"), F.col("n_chars").alias("bytes"))
    return ranking.upload_batches(files, "name", "bytes", 50, 3000).select("name", F.col("batch_id").cast("long").alias("batch_id"))


def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    return ranking.batched(t.places(spark, d).select("id"), "id", 32).select("id", F.col("batch_id").cast("long").alias("batch_id"), F.col("in_batch").cast("long").alias("in_batch"))


def pack_rerank(spark: SparkSession, d: str) -> DataFrame:
    g = t.guesses(spark, d).select("map_id", "session_id", "id", F.coalesce(F.col("key").cast("int"), F.lit(0)).alias("k")).withColumn("pack", F.concat_ws("/", "map_id", "session_id"))
    return ranking.reranked(g, "pack", "k", "id").select("pack", "id", F.col("rank").cast("long").alias("rank"))


def base_cap(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "documents").select(F.concat(F.format_string("poi_%06d", F.col("doc_id") % 97), F.format_string("_g%03d", F.floor(F.col("doc_id") / 97))).alias("stem"))
    return ranking.within_bases(p, T.base_id(F.col("stem")), 20)


def memory_stability(spark: SparkSession, d: str) -> DataFrame:
    r = _scored(spark, d).select(F.col("session_id").alias("user_id"), "map_id", "score_points", F.col("id").alias("round_id"), F.col("ts").alias("saved_at"))
    return ranking.memory_stability(r)


TIERS = [("scout", 0, 1000), ("ranger", 1000, 5000), ("guide", 5000, 20000), ("legend", 20000, 50000)]


def tier_progress(spark: SparkSession, d: str) -> DataFrame:
    u = t.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 7919 % 30000).alias("xp"))
    return ranking.tier_progress(u, TIERS).select("user_id", "tier", F.col("percent").cast("long").alias("percent"))


QUERIES = {f.__name__: f for f in (
    ranked_leaderboard, leaderboard_top10, community_leaderboard, idempotent_append, idempotent_submissions, key_conflicts, duplicate_keys, last_guess_wins, map_upsert, map_overrides, finalised_ids, weighted_mix,
    jobs_recent, jobs_queue_head, jobs_transitions, jobs_expired, rounds_pruned, jobs_merged, outbox_next_try, outbox_trimmed, due_row, career_counters, screen_visits, maps_second_half, file_shards, upload_batches,
    batch_slices, pack_rerank, base_cap, memory_stability, tier_progress,
)}

_FIRST = "row_number() OVER (PARTITION BY map_id, key ORDER BY ts, id)"
SQL = {
    "ranked_leaderboard": f"SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY score_points DESC, id) AS place, id, 'RNK-' || upper(substr(session_id, 1, 8)) AS handle, score_points, km AS distance_km FROM (SELECT *, {_FIRST} AS r FROM {_SCORED}) WHERE r = 1",
    "leaderboard_top10": f"SELECT map_id, place, id, score_points FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY score_points DESC, id) AS place FROM {_SCORED}) WHERE place <= 10",
    "community_leaderboard": f"SELECT map_id, count(*) AS n, max(score_points) AS best, min(id) AS first_id FROM {_SCORED} GROUP BY map_id",
    "idempotent_append": f"SELECT id, map_id, key, score_points FROM (SELECT *, row_number() OVER (PARTITION BY map_id, key ORDER BY id % 3 != 0, ts, id) AS r FROM {_SCORED}) WHERE r = 1",
    "idempotent_submissions": f"SELECT id, map_id, key, first_value(score_points) OVER (PARTITION BY map_id, key ORDER BY ts, id) AS score_points, {_FIRST} = 1 AS inserted FROM {_SCORED}",
    "key_conflicts": f"SELECT map_id, key FROM ({t.GUESSES_SQL}) WHERE id % 2 = 0 INTERSECT SELECT map_id, key FROM ({t.GUESSES_SQL}) WHERE id % 2 = 1",
    "duplicate_keys": f"SELECT map_id, session_id, key, count(*) AS n_rows FROM ({t.GUESSES_SQL}) GROUP BY ALL HAVING count(*) > 1",
    "last_guess_wins": f"SELECT map_id, session_id, id, key FROM (SELECT *, row_number() OVER (PARTITION BY map_id, session_id ORDER BY ts DESC, id DESC) AS r FROM ({t.GUESSES_SQL})) WHERE r = 1",
    "map_upsert": "SELECT c_custkey AS map_id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE c_name END AS title FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "map_overrides": "SELECT c_custkey AS map_id, CASE WHEN c_custkey % 8 = 0 THEN 'renamed' ELSE c_name END AS title, c_mktsegment AS segment, CASE WHEN c_custkey % 4 = 0 THEN 'yes' END AS flag FROM customer",
    "finalised_ids": "SELECT c_custkey AS id, c_custkey % 7 != 0 AND c_custkey % 5 != 0 AS included, CASE WHEN c_custkey % 7 = 0 THEN 'failed' WHEN c_custkey % 5 = 0 THEN 'missing' END AS reason FROM customer",
    "weighted_mix": "SELECT CASE doc_id % 10 WHEN 0 THEN 'small' WHEN 1 THEN 'task' ELSE 'main' END AS part, doc_id, sum(CASE doc_id % 10 WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 1 END)::BIGINT AS n FROM documents GROUP BY ALL",
    "jobs_recent": f"SELECT job_id, status FROM ({t.JOBS_SQL}) WHERE session % 10 = 1 AND status IN ('completed', 'running') ORDER BY created_at DESC, job_id LIMIT 100",
    "jobs_queue_head": f"SELECT job_id, created_at FROM ({t.JOBS_SQL}) WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 50",
    "jobs_transitions": f"SELECT job_id, ok AS changed, CASE WHEN NOT ok THEN status WHEN job_id % 2 = 0 THEN 'running' ELSE 'completed' END AS status FROM (SELECT *, job_id % 3 = 0 AND ((job_id % 2 = 0 AND status = 'queued') OR (job_id % 2 = 1 AND status = 'running')) AS ok FROM ({t.JOBS_SQL}))",
    "jobs_expired": f"SELECT status, count(*) AS n FROM ({t.JOBS_SQL}) WHERE NOT (status = 'completed' AND finished_at < TIMESTAMP '1997-12-31 00:00:00') GROUP BY status",
    "rounds_pruned": f"SELECT status, count(*) AS n, min(e) AS oldest FROM (SELECT CASE WHEN id % 4 = 0 THEN 'closed' ELSE 'open' END AS status, floor(epoch(ts))::BIGINT AS e FROM ({t.GUESSES_SQL})) WHERE NOT (status = 'open' AND e < 1705708800 - 604800) GROUP BY status",
    "jobs_merged": f"""SELECT session, min(created_at) AS started_at, max(finished_at) AS finished_at, string_agg(DISTINCT 'art_' || job_id % 3, ',' ORDER BY 'art_' || job_id % 3) AS artifacts, string_agg(DISTINCT lower(substr(priority, 1, 1)), '+' ORDER BY lower(substr(priority, 1, 1))) AS profiles,
      arg_min('err' || job_id, (created_at, job_id)) FILTER (job_id % 5 = 0) AS error, CASE max(CASE status WHEN 'running' THEN 2 WHEN 'queued' THEN 2 ELSE 0 END) WHEN 2 THEN 'running' ELSE 'completed' END AS status, count(*) AS n_jobs FROM ({t.JOBS_SQL}) GROUP BY session""",
    "outbox_next_try": f"SELECT id, CASE WHEN id % 30 < 24 THEN floor((epoch_us(ts) + [5, 15, 60, 300, 900, 3600][greatest(1, least(6, id % 30))] * ((id % 10) / 10.0::DOUBLE * 0.1::DOUBLE + 1.0::DOUBLE) * 1000000) / 1000000)::BIGINT END AS next_epoch FROM ({t.GUESSES_SQL})",
    "outbox_trimmed": f"SELECT map_id, id FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY ts DESC, id DESC) AS r FROM ({t.GUESSES_SQL})) WHERE r <= 120",
    "due_row": f"SELECT id FROM ({t.GUESSES_SQL}) WHERE ts + INTERVAL 1 DAY <= {NOW_SQL} ORDER BY ts, id LIMIT 1",
    "career_counters": f"SELECT session_id AS user_id, count(*) AS rounds, sum(score_points)::BIGINT AS points, arg_max(id, (ts, id)) AS last_round_id, least(200, count(DISTINCT map_id)) AS n_recent_maps FROM {_SCORED} GROUP BY session_id",
    "screen_visits": "SELECT lower(trim(event_type)) AS screen, count(*) AS n FROM events GROUP BY 1",
    "maps_second_half": "SELECT c_custkey AS map_id, row_number() OVER (ORDER BY c_custkey) - 1 >= (count(*) OVER ()) // 2 AS ranked_pool FROM customer",
    "file_shards": "WITH f AS (SELECT printf('doc_%08d.txt', doc_id) AS name FROM documents) SELECT name, printf('s%05d/', (row_number() OVER (ORDER BY name) - 1) // 64) || name AS shard_path FROM f",
    "upload_batches": """WITH f AS (SELECT printf('doc_%08d.txt', doc_id) AS name, n_chars >= 3000 AS big FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY big ORDER BY name) - 1 AS i, count(*) FILTER (NOT big) OVER () AS n FROM f)
      SELECT name, CASE WHEN big THEN i + (n + 49) // 50 ELSE i // 50 END::BIGINT AS batch_id FROM p""",
    "batch_slices": "SELECT id, (p // 32)::BIGINT AS batch_id, p % 32 AS in_batch FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer)",
    "pack_rerank": f"SELECT map_id || '/' || session_id AS pack, id, row_number() OVER (PARTITION BY map_id, session_id ORDER BY coalesce(try_cast(key AS INT), 0), id) AS rank FROM ({t.GUESSES_SQL})",
    "base_cap": "WITH p AS (SELECT printf('poi_%06d', doc_id % 97) AS base, printf('_g%03d', doc_id // 97) AS tail FROM documents) SELECT base || tail AS stem FROM p WHERE base IN (SELECT DISTINCT base FROM p ORDER BY base LIMIT 20)",
    "memory_stability": f"""WITH r AS (SELECT session_id AS u, map_id AS m, score_points AS s, id, ts FROM {_SCORED}), x AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts DESC, id DESC) AS n, count(*) OVER (PARTITION BY u, m) AS nm, rank() OVER (PARTITION BY u, m ORDER BY s) - 1 AS bm, count(*) OVER (PARTITION BY u) AS nu, rank() OVER (PARTITION BY u ORDER BY s) - 1 AS bu FROM r),
      p AS (SELECT u, CASE WHEN nm >= 3 THEN CASE WHEN nm > 1 THEN bm / (nm - 1)::DOUBLE ELSE 1.0 END ELSE CASE WHEN nu > 1 THEN bu / (nu - 1)::DOUBLE ELSE 1.0 END END AS p FROM x WHERE n <= 10), v AS (SELECT u, round_even(median(p) * median(p) * (3 - 2 * median(p)) * 100, 2) AS s FROM p GROUP BY u)
      SELECT u AS user_id, s AS stability, CASE WHEN s >= 80 THEN 'stable' WHEN s >= 55 THEN 'steady' WHEN s >= 30 THEN 'variable' ELSE 'volatile' END AS band FROM v""",
    "tier_progress": """WITH u AS (SELECT c_custkey AS user_id, c_custkey * 7919 % 30000 AS xp FROM customer), x AS (SELECT *, CASE WHEN xp < 1000 THEN 'scout' WHEN xp < 5000 THEN 'ranger' WHEN xp < 20000 THEN 'guide' ELSE 'legend' END AS tier, CASE WHEN xp < 1000 THEN 0 WHEN xp < 5000 THEN 1000 WHEN xp < 20000 THEN 5000 ELSE 20000 END AS lo, CASE WHEN xp < 1000 THEN 1000 WHEN xp < 5000 THEN 5000 WHEN xp < 20000 THEN 20000 ELSE 50000 END AS hi FROM u)
      SELECT user_id, tier, least(100, greatest(0, round_even((xp - lo) * 100.0::DOUBLE / (hi - lo), 0)::BIGINT)) AS percent FROM x""",
}
