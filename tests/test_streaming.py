"""Streams over files: what they give equals the same rows as a batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoloom.operators import dedup
from geoloom.streaming import jobs, stores

DAY = dt.datetime(2024, 1, 1)


def drained(spark, tmp_path, batches, schema, make, name):
    """All rows that a stream gives for files that come one after the other."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        stream = make(spark.readStream.schema(schema).json(source))
        query = stream.writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        made = stream.schema
    return spark.read.schema(made).json(out)


def test_append_once(spark, tmp_path):
    rows = [[("a", 1, DAY), ("b", 2, DAY), ("a", 3, DAY)], [("a", 4, DAY + dt.timedelta(hours=1)), ("c", 5, DAY)]]
    schema = "key string, v int, at timestamp"
    got = drained(spark, tmp_path, rows, schema, lambda s: stores.append_once(s, ["key"], "at"), "once")
    want = dedup.first_wins(spark.createDataFrame(rows[0] + rows[1], schema), ["key"], F.col("at"))
    assert sorted(r["key"] for r in got.collect()) == sorted(r["key"] for r in want.collect())


def test_nonces(spark, tmp_path):
    late = DAY + dt.timedelta(seconds=400)
    rows = [[("n1", DAY, DAY), ("n1", DAY, DAY), ("n2", DAY, late)], [("n1", DAY, DAY + dt.timedelta(seconds=10)), ("n3", DAY, DAY)]]
    got = drained(spark, tmp_path, rows, "nonce string, sent_at timestamp, received_at timestamp", stores.fresh_nonces, "nonces")
    assert sorted(r["nonce"] for r in got.collect()) == ["n1", "n3"]


def test_submissions_are_scored_once(spark, tmp_path):
    rounds = spark.createDataFrame([("r", "m", 10.0, 10.0, "open"), ("s", "m", 0.0, 0.0, "closed")], "round_id string, map_id string, truth_lat double, truth_lon double, status string")
    rows = [[("r", "k", 10.0, 10.0, DAY), ("s", "k", 1.0, 1.0, DAY)], [("r", "k", 50.0, 50.0, DAY)]]
    got = drained(spark, tmp_path, rows, "round_id string, key string, guess_lat double, guess_lon double, submitted_at timestamp", lambda s: stores.scored_submissions(s, rounds), "scored").collect()
    assert [(r["round_id"], r["score_points"]) for r in got] == [("r", 1_000_000)]


def test_job_states(spark, tmp_path):
    t = lambda n: DAY + dt.timedelta(seconds=n)
    rows = [[("j", None, "queued", t(0)), ("j", "queued", "running", t(1)), ("k", "queued", "running", t(1))], [("j", "queued", "cancelled", t(2)), ("j", "running", "completed", t(3)), ("j", "completed", "running", t(4))]]
    jobs.use_rocksdb(spark)
    try:
        made = drained(spark, tmp_path, rows, "job_id string, expected string, to_status string, at timestamp", jobs.job_states, "jobs")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = made.orderBy("job_id", "updated_at").collect()
    assert [(r["job_id"], r["status"], r["accepted"]) for r in got] == [("j", "queued", True), ("j", "running", True), ("j", "running", False), ("j", "completed", True), ("j", "completed", False), ("k", None, False)]


def test_rounds_expire(spark, tmp_path):
    rows = [[("a", "open", DAY), ("b", "open", DAY)], [("b", "closed", DAY + dt.timedelta(hours=1)), ("z", "open", DAY + dt.timedelta(days=30))], [("y", "open", DAY + dt.timedelta(days=31))]]
    got = drained(spark, tmp_path, rows, "round_id string, status string, at timestamp", stores.expired_rounds, "rounds")
    assert [r["round_id"] for r in got.collect()] == ["a"]


def test_windows(spark, tmp_path):
    rows = [[("m", 5, DAY), ("m", 7, DAY + dt.timedelta(hours=2)), ("m", 1, DAY + dt.timedelta(days=3))], [("m", 1, DAY + dt.timedelta(days=9))]]
    got = drained(spark, tmp_path, rows, "map_id string, score_points int, ts timestamp", lambda s: stores.windowed_counts(s, "ts", "map_id"), "windows").collect()
    assert {(r["n"], r["points"]) for r in got} >= {(2, 12)}


@pytest.mark.parametrize("name", ["latest"])
def test_latest_by_key(spark, tmp_path, name):
    path = str(tmp_path / name)
    df = spark.createDataFrame([("a", 1, DAY), ("a", 2, DAY + dt.timedelta(1))], "k string, v int, at timestamp")
    stores.latest_by_key(df, 0, path, ["k"], "at")
    stores.latest_by_key(df.where("v = 1"), 1, path, ["k"], "at")
    assert [(r["v"], r["epoch"]) for r in spark.read.parquet(path).orderBy("epoch").collect()] == [(2, 0), (1, 1)]
