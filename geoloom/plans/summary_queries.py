"""Queries that summarise scored results, splits, paths and builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from ..operators import summaries as M
from . import tables as t

METRICS = ["lexical", "grounding", "composite"]


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.by_model(t.results(spark, d), METRICS)


def model_levels(spark: SparkSession, d: str) -> DataFrame:
    return M.by_levels(t.results(spark, d), ["category", "profile"], METRICS)


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return M.threshold_sweep(t.results(spark, d), M.parsed_thresholds("0.2, 0.4 0.6,0.8 2"))


def variant_deltas(spark: SparkSession, d: str) -> DataFrame:
    return M.variant_deltas(M.by_model(t.results(spark, d), METRICS), "_plain", ["mean_score", "mean_lexical", "mean_grounding"])


def pair_means(spark: SparkSession, d: str) -> DataFrame:
    return M.pair_means(t.results(spark, d), "profile", "composite")


def health_summary(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d)
    drift = (F.col("id") * 31 % 977).cast("double")
    status = S.row_health(F.when(F.col("id") % 13 != 0, drift), F.when(F.col("id") % 13 != 0, F.col("id") % 4 != 0), (F.col("id") % 5).cast("double"))
    return M.health(p.select(status.alias("status"), F.when(F.col("id") % 13 != 0, drift).alias("drift_km")))


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "documents").select(T.style_violations(F.col("text")).alias("flags"))
    return M.flag_counts(x, "flags")


def change_counts(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "lineitem").select(F.create_map(F.concat(F.lit("flag_"), "l_returnflag"), F.col("l_linenumber"), F.lit("all"), F.lit(1)).alias("m"))
    return M.change_counts(x, "m")


def build_stats(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("task"), F.when(F.col("l_orderkey") % 9 == 0, "too_long").alias("drop_reason"), F.col("l_partkey").alias("prompt_chars"), F.col("l_linenumber").alias("n_boxes"))
    return M.build_stats(x)


def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "orders").select(F.format_string("poi_%06d_t%04d", F.col("o_custkey"), F.col("o_orderkey") % 7).alias("stem")).withColumn("split", T.split_of(F.col("stem")))
    return M.split_leaks(x, T.base_id(F.col("stem")))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "documents").select("doc_id", T.split_of(F.col("doc_id")).alias("split"))
    return x


def missing_roots(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "lineitem").select(F.concat_ws("/", F.lit("images"), F.concat(F.lit("s"), F.col("l_suppkey") % 30), F.concat("l_orderkey", F.lit(".png"))).alias("path"))
    return M.missing_roots(x, "path")


def crowded_folders(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "lineitem").select(F.concat_ws("/", F.lit("images"), F.concat(F.lit("s"), F.col("l_suppkey") % 30), F.concat("l_orderkey", F.lit(".png"))).alias("path"))
    return M.crowded_folders(x, "path", 150)


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.markdown_table(M.by_model(t.results(spark, d), METRICS), ["model", "n", "errors", "n_passed"])


def iou_matches(spark: SparkSession, d: str) -> DataFrame:
    i = t.table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    box = lambda a, b: F.array(a / F.lit(100.0), b / F.lit(100.0), (a + 20) / F.lit(100.0), (b + 30) / F.lit(100.0))
    gold = i.where("l_linenumber = 1").select(k.alias("order_id"), F.col("l_partkey").alias("gold_id"), F.col("l_returnflag").alias("label"), box(F.col("l_partkey") % 60, F.col("l_suppkey") % 60).alias("box"))
    found = i.where("l_linenumber > 1").select(k.alias("order_id"), F.col("l_returnflag").alias("label"), box(F.col("l_partkey") % 60, F.col("l_suppkey") % 60).alias("box"))
    return S.iou_matches(gold, found, "order_id")


QUERIES = {f.__name__: f for f in (
    model_summary, model_levels, threshold_sweep, variant_deltas, pair_means, health_summary, flag_counts, change_counts, build_stats, split_leaks, hash_split, missing_roots, crowded_folders, report_lines, iou_matches,
)}

_R = f"({t.RESULTS_SQL})"
_OK, _N = "error IS NULL", "greatest(1, count(*) FILTER (error IS NULL))"
_AGG = f"""count(*) AS n, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER ({_OK} AND passed) AS n_passed, round_even(sum(CASE WHEN {_OK} THEN coalesce(score, 0) ELSE 0 END) / {_N}, 4) AS mean_score, round_even(count(*) FILTER ({_OK} AND passed) / {_N}, 4) AS pass_rate,
  {', '.join(f'round_even(avg({m}) FILTER ({_OK}), 4) AS mean_{m}' for m in METRICS)}"""
_PATH = "(SELECT 'images/s' || l_suppkey % 30 AS folder FROM lineitem)"
_SPLIT = lambda x: f"(CASE WHEN ('0x' || substr(sha256({x}), 1, 16))::UBIGINT % 10 <= 7 THEN 'train' WHEN ('0x' || substr(sha256({x}), 1, 16))::UBIGINT % 10 = 8 THEN 'validation' ELSE 'test' END)"
_BOX = lambda p: f"(SELECT l_orderkey AS o, l_partkey AS g, l_returnflag AS l, l_partkey % 60 / 100.0::DOUBLE AS x1, l_suppkey % 60 / 100.0::DOUBLE AS y1, (l_partkey % 60 + 20) / 100.0::DOUBLE AS x2, (l_suppkey % 60 + 30) / 100.0::DOUBLE AS y2 FROM lineitem WHERE {p})"
SQL = {
    "model_summary": f"SELECT model, {_AGG} FROM {_R} GROUP BY model",
    "model_levels": f"SELECT model, 'model' AS level, NULL::VARCHAR AS member, {_AGG} FROM {_R} GROUP BY model UNION ALL SELECT model, 'category', lower(category) AS m, {_AGG} FROM {_R} GROUP BY model, m UNION ALL SELECT model, 'profile', profile, {_AGG} FROM {_R} GROUP BY model, profile",
    "threshold_sweep": f"SELECT model, t AS threshold, count(*) AS n, count(*) FILTER ({_OK} AND pass_value >= t) AS n_passed, round_even(count(*) FILTER ({_OK} AND pass_value >= t) / {_N}, 4) AS pass_rate FROM {_R}, (SELECT unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS t) GROUP BY model, t",
    "variant_deltas": f"WITH s AS (SELECT model, {_AGG} FROM {_R} GROUP BY model) SELECT a.model, {', '.join(f'round_even(a.{m} - b.{m}, 4) AS delta_{m}' for m in ('mean_score', 'mean_lexical', 'mean_grounding'))} FROM s a JOIN s b ON b.model = a.model || '_plain'",
    "pair_means": f"SELECT profile, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS errors, round_even(avg(composite) FILTER ({_OK}), 4) AS mean_composite FROM {_R} GROUP BY profile",
    "health_summary": f"""WITH p AS (SELECT id, CASE WHEN id % 13 != 0 THEN (id * 31 % 977)::DOUBLE END AS d, id % 4 != 0 AS body, id % 5 AS s FROM ({t.PLACES_SQL})), x AS (SELECT d, CASE WHEN d IS NULL THEN 'missing' WHEN d > 300 OR NOT body THEN 'degenerate' WHEN d > 150 OR s <= 0 THEN 'borderline' ELSE 'good' END AS st FROM p)
      SELECT count(*) AS n, count(*) FILTER (st = 'good') AS n_good, count(*) FILTER (st = 'borderline') AS n_borderline, count(*) FILTER (st = 'degenerate') AS n_degenerate, count(*) FILTER (st = 'missing') AS n_missing, round_even((count(*) FILTER (st IN ('degenerate', 'missing'))) / count(*) * 100, 3) AS bad_pct,
      (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS r, count(*) OVER () AS c FROM x WHERE d IS NOT NULL) WHERE r = c // 2) AS median_drift_km, max(d) AS max_drift_km, CASE WHEN count(*) FILTER (st IN ('degenerate', 'missing')) / count(*) > 0.5 THEN 'degenerate' WHEN count(*) FILTER (st = 'good') / count(*) >= 0.8 THEN 'healthy' ELSE 'mixed' END AS verdict FROM x""",
    "change_counts": "SELECT 'flag_' || l_returnflag AS change, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM lineitem",
    "build_stats": "SELECT l_linestatus AS task, count(*) FILTER (l_orderkey % 9 != 0) AS emitted, count(*) FILTER (l_orderkey % 9 = 0) AS dropped, round_even(avg(l_partkey) FILTER (l_orderkey % 9 != 0), 2) AS mean_chars, sum(l_linenumber) FILTER (l_orderkey % 9 != 0)::BIGINT AS boxes FROM lineitem GROUP BY 1",
    "split_leaks": f"WITH s AS (SELECT printf('poi_%06d', o_custkey) AS base, printf('poi_%06d_t%04d', o_custkey, o_orderkey % 7) AS stem FROM orders), x AS (SELECT base, {_SPLIT('stem')} AS split FROM s) SELECT base, count(DISTINCT split) AS n_splits FROM x GROUP BY base HAVING count(DISTINCT split) > 1",
    "hash_split": f"SELECT doc_id, {_SPLIT('doc_id::VARCHAR')} AS split FROM documents",
    "missing_roots": f"SELECT folder AS root, count(*) AS n FROM {_PATH} GROUP BY 1 ORDER BY n DESC, root LIMIT 12",
    "crowded_folders": f"SELECT folder, count(*) AS n FROM {_PATH} GROUP BY 1 HAVING count(*) > 150",
    "report_lines": f"WITH s AS (SELECT model, {_AGG} FROM {_R} GROUP BY model) SELECT '| ' || model || ' | ' || n || ' | ' || errors || ' | ' || n_passed || ' |' AS line FROM s",
    "iou_matches": f"""WITH p AS (SELECT a.o, a.g, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM {_BOX('l_linenumber = 1')} a LEFT JOIN {_BOX('l_linenumber > 1')} b ON a.o = b.o AND a.l = b.l)
      SELECT o AS order_id, g AS gold_id, round_even(coalesce(max(CASE WHEN i > 0 THEN i / (s - i) ELSE 0 END), 0), 6) AS best FROM p GROUP BY o, g""",
}
