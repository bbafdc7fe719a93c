"""The tables that queries read, and the columns that stand for places, guesses, pixels and scenes in them.

The sample tables hold no coordinates or images, so these are made from keys by whole-number arithmetic,
the same way in DataFrames and (through the functions that end in _sql) in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, in as many tasks as shuffles have: files of few partitions or row groups have too few for work that is heavy by row, and these tasks would grow with the table. Tables of more partitions stay as they are."""
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def lat_of(key: Column) -> Column:
    return (key * 37 % 1700) / F.lit(10.0) - 85.0


def lon_of(key: Column) -> Column:
    return (key * 53 % 3590) / F.lit(10.0) - 179.5


def lat_sql(key: str) -> str:
    return f"(({key} * 37 % 1700) / 10.0::DOUBLE - 85.0::DOUBLE)"


def lon_sql(key: str) -> str:
    return f"(({key} * 53 % 3590) / 10.0::DOUBLE - 179.5::DOUBLE)"


def haversine_sql(a: str, b: str, c: str, d: str, radius: float = 6371.0) -> str:
    """Kilometres between (a, b) and (c, d), latitudes first."""
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {radius}::DOUBLE * asin(least(1.0::DOUBLE, sqrt({h}))))"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, map_id of all customers."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), lat_of(F.col("c_custkey")).alias("lat"), lon_of(F.col("c_custkey")).alias("lon"), F.col("c_nationkey").cast("long").alias("map_id"))


PLACES_SQL = f"SELECT c_custkey AS id, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon, c_nationkey::BIGINT AS map_id FROM customer"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_id, lat, lon of all suppliers, away from the customers' places."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") * 7 + 3
    return s.select(F.col("s_suppkey").alias("feature_id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


FEATURES_SQL = f"SELECT s_suppkey AS feature_id, {lat_sql('(s_suppkey * 7 + 3)')} AS lat, {lon_sql('(s_suppkey * 7 + 3)')} AS lon FROM supplier"


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses from events: id, map_id, session_id, key, ts, the true place and the guessed one."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("map_id"), F.col("user_id").cast("string").alias("session_id"), F.get_json_object("props", "$.k").alias("key"), "ts",
        lat_of(F.col("user_id")).alias("truth_lat"), lon_of(F.col("user_id")).alias("truth_lon"), lat_of(F.col("event_id")).alias("guess_lat"), lon_of(F.col("event_id")).alias("guess_lon"),
    )


GUESSES_SQL = f"""SELECT event_id AS id, event_type AS map_id, user_id::VARCHAR AS session_id, json_extract_string(props, '$.k') AS key, ts,
  {lat_sql('user_id')} AS truth_lat, {lon_sql('user_id')} AS truth_lon, {lat_sql('event_id')} AS guess_lat, {lon_sql('event_id')} AS guess_lon FROM events"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels from line items: tile, x, y (0 to 63), classes before and after, bands and a change signal; ones that hold nothing have class 255.

    Places within a tile follow from the order's key and the line, so a tile's pixels aren't all different places.
    """
    i = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return i.select(
        (F.col("l_orderkey") % 50).alias("tile"), (k % 64).cast("int").alias("x"), (F.floor(k / 64) % 64).cast("int").alias("y"),
        F.when(F.col("l_partkey") % 31 == 0, 255).otherwise(F.col("l_partkey") % 9).cast("int").alias("class0"), (F.col("l_suppkey") % 9).cast("int").alias("class1"),
        (F.col("l_partkey") % 12).cast("int").alias("scene_class"), (F.col("l_partkey") % 4).cast("int").alias("land0"), (F.col("l_suppkey") % 4).cast("int").alias("land1"),
        (F.col("l_partkey") % 1000 / F.lit(1000.0)).alias("green"), (F.col("l_suppkey") % 97 / F.lit(100.0)).alias("nir"), (F.col("l_orderkey") % 89 / F.lit(100.0)).alias("swir"), (F.col("l_linenumber") / F.lit(10.0)).alias("red"),
        ((F.col("l_partkey") % 200 - 100) / F.lit(100.0)).alias("delta"), (F.col("l_suppkey") % 100).cast("double").alias("cloud"),
    )


PIXELS_SQL = """SELECT l_orderkey % 50 AS tile, ((l_orderkey * 7 + l_linenumber) % 64)::BIGINT AS x, (((l_orderkey * 7 + l_linenumber) // 64) % 64)::BIGINT AS y,
  (CASE WHEN l_partkey % 31 = 0 THEN 255 ELSE l_partkey % 9 END)::BIGINT AS class0, (l_suppkey % 9)::BIGINT AS class1, (l_partkey % 12)::BIGINT AS scene_class,
  (l_partkey % 4)::BIGINT AS land0, (l_suppkey % 4)::BIGINT AS land1,
  (l_partkey % 1000) / 1000.0::DOUBLE AS green, (l_suppkey % 97) / 100.0::DOUBLE AS nir, (l_orderkey % 89) / 100.0::DOUBLE AS swir, l_linenumber / 10.0::DOUBLE AS red,
  (l_partkey % 200 - 100) / 100.0::DOUBLE AS delta, (l_suppkey % 100)::DOUBLE AS cloud FROM lineitem"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows from line items: model, category, profile, scores of which some are missing, passed and error."""
    i = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    some = lambda c, m: F.when(k % m != 0, c)
    return i.select(
        F.concat(F.lit("model_"), F.lower("l_returnflag"), F.when(k % 2 == 0, "_plain").otherwise("")).alias("model"), F.col("l_linestatus").alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in ("wildfire", "flood_pulse", "land_use_change")]), (k % 3 + 1).cast("int")).alias("profile"),
        some(F.col("l_discount") * 10, 13).alias("score"), some(F.col("l_tax") * 12.5, 11).alias("lexical"), some(F.col("l_discount") * 5, 7).alias("grounding"), some(F.col("l_quantity") / 50, 17).alias("composite"),
        (F.col("l_discount") * 10).alias("pass_value"), (F.col("l_discount") >= 0.05).alias("passed"), F.when(k % 19 == 0, "timeout").alias("error"), F.col("l_partkey").alias("part"),
    )


RESULTS_SQL = """SELECT 'model_' || lower(l_returnflag) || CASE WHEN k % 2 = 0 THEN '_plain' ELSE '' END AS model, l_linestatus AS category, ['wildfire', 'flood_pulse', 'land_use_change'][k % 3 + 1] AS profile,
  CASE WHEN k % 13 != 0 THEN l_discount * 10 END AS score, CASE WHEN k % 11 != 0 THEN l_tax * 12.5::DOUBLE END AS lexical, CASE WHEN k % 7 != 0 THEN l_discount * 5 END AS grounding, CASE WHEN k % 17 != 0 THEN l_quantity / 50 END AS composite,
  l_discount * 10 AS pass_value, l_discount >= 0.05 AS passed, CASE WHEN k % 19 = 0 THEN 'timeout' END AS error, l_partkey AS part
  FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from orders: job_id, session, status, priority, created_at, and finished_at of finished ones."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("session"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), F.when(status == "completed", F.col("o_orderdate") + F.expr("interval 3 days")).alias("finished_at"), F.col("o_totalprice").alias("price"))


JOBS_SQL = """SELECT o_orderkey AS job_id, o_custkey AS session, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'queued' END AS status, o_orderpriority AS priority, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS finished_at, o_totalprice AS price FROM orders"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog locations from customers; some lack a map, have a place out of range, or need no hints."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("loc_"), k.cast("string")).alias("location_id"), F.when(k % 97 != 0, F.concat(F.lit("map_"), F.col("c_nationkey").cast("string"))).alias("map_id"),
        F.when(k % 89 == 0, 95.0).otherwise(lat_of(k)).alias("truth_lat"), lon_of(k).alias("truth_lon"), F.when(k % 5 == 0, "none").otherwise("tiers").alias("assist_level"), k.alias("k"),
    )


LOCATIONS_SQL = f"""SELECT 'loc_' || c_custkey AS location_id, CASE WHEN c_custkey % 97 != 0 THEN 'map_' || c_nationkey END AS map_id, CASE WHEN c_custkey % 89 = 0 THEN 95.0::DOUBLE ELSE {lat_sql('c_custkey')} END AS truth_lat,
  {lon_sql('c_custkey')} AS truth_lon, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'tiers' END AS assist_level, c_custkey AS k FROM customer"""


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from nations; one more than the locations use."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("map_"), (F.col("n_nationkey") + 1).cast("string")).alias("map_id"), F.col("n_name").alias("title"), (F.col("n_regionkey") % 2 == 0).alias("ranked_pool"))


MAPS_SQL = "SELECT 'map_' || (n_nationkey + 1) AS map_id, n_name AS title, n_regionkey % 2 = 0 AS ranked_pool FROM nation"
