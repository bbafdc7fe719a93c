"""Batches flushed exactly once, and job states by a stateful processor."""

import datetime as dt
import random

import pytest

from geoloom.operators.stores import NEXT_STATES
from geoloom.streaming import flush, jobs

DAY = dt.datetime(2024, 1, 1)
ROW = "id long, split string, v string"


def put(spark, path, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def run(spark, tmp_path, out, **how):
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(flush.flusher(out, **how)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_a_killed_batch_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for b in range(3):
        put(spark, str(tmp_path / "in"), [(b * 10 + i, "train" if i % 3 else "test", None if i == 4 else f"v{i}") for i in range(10)])
    tried = []

    def killed(epoch):
        tried.append(epoch)
        if epoch == 1 and tried.count(1) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, out, split="split", before_commit=killed)
    # The folder is there, but it doesn't count.
    assert flush.committed(spark, out) == [0] and (tmp_path / "out/batch=1").exists()
    assert flush.read_committed(spark, out, ROW).count() == 10
    run(spark, tmp_path, out, split="split", before_commit=killed)
    got = flush.read_committed(spark, out, ROW)
    assert sorted(r["id"] for r in got.collect()) == list(range(30)) and tried == [0, 1, 1, 2]
    assert {r["split"] for r in got.where("batch = 1").collect()} == {"train", "test"}


def test_a_batch_that_is_run_again_writes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    first, other = spark.createDataFrame([(1, "a", "x")], ROW), spark.createDataFrame([(2, "a", "y")], ROW)
    assert flush.flush(first, 5, out) and not flush.flush(other, 5, out)
    assert [r["id"] for r in flush.read_committed(spark, out, ROW).collect()] == [1]
    assert flush.flush(spark.createDataFrame([(i, "b", None) for i in range(9)], ROW).coalesce(1), 6, out, rows=4)
    assert len(list((tmp_path / "out/batch=6").glob("*.parquet"))) == 3
    assert flush.compact(spark, out, str(tmp_path / "all"), ROW) == 2
    assert flush.read_committed(spark, str(tmp_path / "all"), ROW).count() == 10
    assert flush.read_committed(spark, str(tmp_path / "none"), ROW).count() == 0


CHANGE = "job_id string, expected string, to_status string, at timestamp"


def brute(batches):
    """All changes by hand, a batch at a time."""
    state, out = {}, []
    for rows in batches:
        for job, expected, to, at in sorted(rows, key=lambda r: (r[0], r[3], r[2])):
            status = state.get(job)
            ok = (status is None and to == "queued") or (status is not None and expected == status and to in NEXT_STATES.get(status, ()))
            if ok:
                state[job] = to
            out.append((job, state.get(job), at, ok))
    return sorted(out, key=str)


def drained(spark, tmp_path, batches, **how):
    jobs.use_rocksdb(spark)
    try:
        for i, rows in enumerate(batches):
            put(spark, str(tmp_path / "in"), rows, CHANGE)
            stream = jobs.job_states(spark.readStream.schema(CHANGE).json(str(tmp_path / "in")), **how)
            query = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert query.awaitTermination(300), i
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted(((r["job_id"], r["status"], r["updated_at"], r["accepted"]) for r in spark.read.schema(jobs.STATE).json(str(tmp_path / "out")).collect()), key=str)


def test_job_states_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    states = ["queued", "running", "completed", "failed", "cancelled", "odd"]
    batches = [[(f"j{rng.randrange(4)}", rng.choice([*states, None]), rng.choice(states), DAY + dt.timedelta(minutes=40 * b + rng.randrange(40))) for _ in range(60)] for b in range(3)]
    batches[0] += [("hot", "running", "running", DAY + dt.timedelta(milliseconds=i)) for i in range(25_000)] + [("hot", None, "queued", DAY)]
    assert drained(spark, tmp_path, batches) == brute(batches)


def test_a_job_without_changes_is_given_up(spark, tmp_path):
    batches = [[("a", None, "queued", DAY), ("b", None, "queued", DAY)], [("b", "queued", "running", DAY + dt.timedelta(seconds=50))], [("z", None, "queued", DAY + dt.timedelta(seconds=500))], [("a", "queued", "running", DAY + dt.timedelta(seconds=501)), ("a", None, "queued", DAY + dt.timedelta(seconds=502))]]
    got = drained(spark, tmp_path, batches, ttl_seconds=100, late="0 seconds")
    assert [(s, ok) for j, s, at, ok in sorted(got, key=lambda r: r[2]) if j == "a"] == [("queued", True), (None, False), ("queued", True)]
