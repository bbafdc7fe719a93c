"""The scene search and database tables as data sources: what they give, and what is pushed into them."""

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from geoloom.sources import databases, readers, scene_store

UTC = dt.timezone.utc


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scenes(n=60):
    start = dt.datetime(2024, 1, 1)
    return [(f"s{i:03d}", "a" if i % 3 else "b", None if i % 11 == 5 else start + dt.timedelta(days=i), None if i % 13 == 7 else float(i * 7 % 100), -10.0 + i, 5.0, -9.0 + i, 6.0) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    scene_store.write_store(spark.createDataFrame(scenes(), scene_store.SCENE), str(tmp_path / "store"), per_page=10)
    return str(tmp_path / "store")


def wanted(rows, box, start, end, cloud):
    w, s, e, n = box
    return [r for r in rows if r[2] is not None and r[3] is not None and start <= r[2] <= end and r[3] < cloud and r[4] <= e and r[6] >= w and r[5] <= n and r[7] >= s]


BOX, START, END = (0.5, 0.0, 30.2, 9.0), dt.datetime(2024, 1, 15), dt.datetime(2024, 2, 20)


def test_search_gives_what_fits(spark, store):
    found = scene_store.search(spark, store, box=BOX, start=START, end=END, most_cloud=70)
    assert sorted(r["scene_id"] for r in found.collect()) == [r[0] for r in wanted(scenes(), BOX, START, END, 70)]
    some = scene_store.search(spark, store, box=BOX, start=START, end=END, most_cloud=70, collection="b")
    assert sorted(r["scene_id"] for r in some.collect()) == [r[0] for r in wanted(scenes(), BOX, START, END, 70) if r[1] == "b"]
    assert scene_store.search(spark, store, box=(100, 80, 101, 81), start=START, end=END, most_cloud=70).count() == 0


def test_search_pushes_filters_and_skips_pages(spark, store):
    found = scene_store.search(spark, store, box=BOX, start=START, end=END, most_cloud=70, collection="a")
    whole = plan(found)
    pushed = next(x for x in whole.split("\n") if "PushedFilters" in x)
    assert all(c in pushed for c in ("west", "east", "south", "north", "scene_ts", "cloud", "collection"))
    index = json.load(open(f"{store}/index.json"))
    assert len(index["pages"]) == 6 and 0 < found.rdd.getNumPartitions() < 6
    # Pages that can't hold anything aren't even opened.
    for p in index["pages"]:
        if p.get("bbox") and p["bbox"][2] < BOX[0]:
            open(f"{store}/{p['file']}", "w").write("no JSON")
    assert found.count() == scene_store.search(spark, store, box=BOX, start=START, end=END, most_cloud=70, collection="a").count()


def test_search_ends_after_items_counted_before_invalid_ones_go(spark, tmp_path):
    items = [{"id": f"i{k}", "collection": "c", "bbox": [0, 0, 1, 1], "properties": {"datetime": None if k in (1, 2) else f"2024-01-0{k + 1}T00:00:00Z", "eo:cloud_cover": 90 if k == 0 else 5}} for k in range(6)]
    (tmp_path / "p.json").write_text(json.dumps({"features": items}))
    (tmp_path / "index.json").write_text(json.dumps({"pages": [{"file": "p.json"}]}))
    ask = dict(box=(0, 0, 1, 1), start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 2, 1), most_cloud=30)
    assert [r["scene_id"] for r in scene_store.search(spark, str(tmp_path), max_items=3, **ask).collect()] == ["i3"]
    assert [r["scene_id"] for r in scene_store.search(spark, str(tmp_path), **ask).collect()] == ["i3", "i4", "i5"]
    (tmp_path / "index.json").write_text(json.dumps({"pages": []}))
    assert scene_store.search(spark, str(tmp_path), **ask).count() == 0


TABLES = {
    "leaderboard_rows": ("id INTEGER PRIMARY KEY, map_id TEXT, display_handle TEXT, score_points INTEGER, distance_km REAL", [(i * 3, f"m{i % 4}", None if i % 5 == 0 else f"h{i}", i * 10, i / 7) for i in range(1, 101)]),
    "ranked_rounds": ("round_id TEXT PRIMARY KEY, status TEXT, opened_at TEXT", [(f"r{i}", "open" if i % 2 else "closed", f"2024-01-{i + 1:02d}") for i in range(20)]),
    "idempotency": ("key TEXT, round_id TEXT, response BLOB", [(f"k{i}", f"r{i}", bytes([i])) for i in range(7)]),
    "pro_jobs": ("job_id TEXT, status TEXT, progress_pct INTEGER, cancel_requested BOOLEAN, note TEXT", [(f"j{i}", "queued", i, i % 2, 'quote " and é') for i in range(11)]),
    "empty_store": ("a INTEGER, b TEXT", []),
}


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "a store.sqlite")
    with sqlite3.connect(path) as c:
        for name, (columns, rows) in TABLES.items():
            c.execute(f"CREATE TABLE {name} ({columns})")
            if rows:
                c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    c.close()
    return path


def test_tables_round_trip(spark, database):
    for name, (_, rows) in TABLES.items():
        got = databases.table(spark, database, name)
        want = [tuple(bool(v) if c == "cancel_requested" else v for c, v in zip(got.columns, r, strict=True)) for r in rows]
        assert sorted(map(str, (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.collect()))) == sorted(map(str, want))
    with pytest.raises(Exception, match="no table"):
        databases.table(spark, database, "nowhere").count()


def test_rows_are_dealt_by_ranges(spark, database):
    df = databases.table(spark, database, "leaderboard_rows", partitions=5)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 100 and max(sizes) <= 21
    assert databases.table(spark, database, "idempotency", partitions=50).rdd.getNumPartitions() == 7


def test_comparisons_are_pushed(spark, database):
    df = databases.table(spark, database, "leaderboard_rows").where("score_points >= 300 and map_id = 'm1' and distance_km < 12.5")
    pushed = next(x for x in plan(df).split("\n") if "PushedFilters" in x)
    assert all(c in pushed for c in ("score_points", "map_id", "distance_km"))
    rows = TABLES["leaderboard_rows"][1]
    assert sorted(r["id"] for r in df.collect()) == [r[0] for r in rows if r[3] >= 300 and r[1] == "m1" and r[4] < 12.5]
    odd = databases.table(spark, database, "leaderboard_rows").where("display_handle > 'h5' or map_id in ('m0', 'm2')")
    assert sorted(r["id"] for r in odd.collect()) == [r[0] for r in rows if (r[2] is not None and r[2] > "h5") or r[1] in ("m0", "m2")]
    assert databases.table(spark, database, "leaderboard_rows", columns=["map_id"]).columns == ["map_id"]


def test_staged_splits(spark, tmp_path):
    for subset, split, n in (("default", "train", 5), ("default", "test", 2), ("extra", "train", 3)):
        spark.range(n).withColumn("t", F.lit(f"{subset}/{split}")).coalesce(1).write.parquet(str(tmp_path / "org/data" / subset / split))
    root = str(tmp_path)
    assert readers.staged_split(spark, root, "org/data", split="train").count() == 5
    assert {r["t"] for r in readers.staged_split(spark, root, "org/data", subset="extra", split="train").collect()} == {"extra/train"}
    assert readers.staged_split(spark, root, "org/data", split="test", columns=["id"], most=1).count() == 1
    with pytest.raises(ValueError, match="no split"):
        readers.staged_split(spark, root, "org/data", split="validation")
