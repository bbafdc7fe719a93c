"""Geodesy, joins by place and samples, against values by hand and brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import areas, joins, lines, pairs, sampling

POINTS = [(0.0, 0.0, 0.0, 0.0, 0.0), (40.7128, -74.006, 51.5074, -0.1278, 5570.2), (10.0, 179.9, 10.0, -179.9, 21.9), (89.0, 0.0, 89.0, 180.0, 222.4)]


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def test_distances(spark):
    df = spark.createDataFrame(POINTS, "a double, b double, c double, d double, want double")
    cols = [F.col(x) for x in "abcd"]
    for r in df.select(geo.haversine_km(*cols).alias("k"), (geo.haversine_m(*cols) / 1000).alias("m"), "want").collect():
        assert r["k"] == pytest.approx(r["want"], abs=0.1) and r["m"] == pytest.approx(r["k"], abs=1e-6)


def test_destination_goes_back(spark):
    df = spark.createDataFrame(POINTS[1:], "a double, b double, c double, d double, want double")
    at = geo.destination(F.col("a"), F.col("b"), geo.bearing(*[F.col(x) for x in "abcd"]), geo.haversine_km(*[F.col(x) for x in "abcd"]))
    for r in df.withColumn("p", at).collect():
        assert r["p"]["lat"] == pytest.approx(r["c"], abs=1e-6) and abs((r["p"]["lon"] - r["d"] + 180) % 360 - 180) < 1e-6
    with pytest.raises(Exception, match="negative"):
        df.select(geo.destination(F.col("a"), F.col("b"), F.lit(0.0), F.lit(-1.0))).collect()


def test_scores_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1e9,), (None,)], "d double")
    assert [tuple(r) for r in df.select(geo.score_ranked(F.col("d")), geo.score_casual(F.col("d"))).collect()] == [(1000000, 5000), (500000, 4997), (0, 0), (None, None)]
    bad = spark.createDataFrame([("x",), (" 7 ",), ("nan",), (None,), ("inf",)], "s string").select(geo.parse_coordinate(F.col("s")))
    assert [r[0] for r in bad.collect()] == [None, 7.0, None, None, None]


def places(n, seed):
    rng = random.Random(seed)
    out = [(i, round(math.degrees(math.asin(rng.uniform(-1, 1))), 3), round(rng.uniform(-180, 180), 3)) for i in range(n)]
    return out + [(n, 90.0, 0.0), (n + 1, -90.0, 10.0), (n + 2, 0.0, 180.0), (n + 3, 0.0, -180.0), (n + 4, 5.0, 179.99), (n + 5, 5.0, -179.99)]


@pytest.mark.parametrize("far", [30.0, 700.0, 6000.0])
def test_pairs_within(spark, far):
    a, b = places(120, 1), places(80, 2)
    found = joins.within_km(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "id long, lat double, lon double"), far)
    assert {(r["id_a"], r["id_b"]) for r in found.collect()} == {(p[0], q[0]) for p in a for q in b if km(*p[1:], *q[1:]) <= far}
    assert found.count() == found.distinct().count()


@pytest.mark.parametrize("far", [30.0, 700.0, 6000.0, 30000.0])
def test_near_pairs_in_tiles(spark, monkeypatch, far):
    monkeypatch.setattr(joins, "TILE", 4)
    monkeypatch.setattr(joins, "TASK_PAIRS", 50)
    schema = "id long, lat double, lon double"
    a, b = places(70, 1), places(40, 2)
    a = a + [(1000 + i, *a[3][1:]) for i in range(11)] + [(None, *a[4][1:]), (a[5][0], *a[5][1:]), (2000, None, 1.0), (2001, 1.0, None)]
    b = b + [(1000 + i, *a[3][1:]) for i in range(9)] + [(2000, None, None)]
    for p, q in ((a, b), (b, a)):
        got = joins.near_pairs(spark.createDataFrame(p, schema), spark.createDataFrame(q, schema), far).collect()
        want = [(x[0], y[0]) for x in p for y in q if None not in (*x[1:], *y[1:]) and km(*x[1:], *y[1:]) <= far]
        assert sorted(((r["id_a"], r["id_b"]) for r in got), key=str) == sorted(want, key=str)
    assert joins.near_pairs(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), far).count() == 0


def test_near_pairs_of_a_crowd_are_made_by_many_tasks(spark, monkeypatch, tmp_path):
    """the join of a small file ran in one task, whatever the number of its pairs."""
    from geoloom.plans import geo_queries

    monkeypatch.setattr(joins, "TILE", 64, raising=False)
    spark.range(600).selectExpr("id * 610300 AS c_custkey", "0 AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id * 610300 + 174371 AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    made = geo_queries.geo_near_pairs(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 240_000 and max(r["count"] for r in made) < 120_000


def test_nearest_and_closest(spark):
    a, b = places(60, 3), places(25, 4)
    df, features = spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "feature_id long, lat double, lon double")
    got = {r["id"]: r["km"] for r in joins.nearest(df, features).collect()}
    assert len(got) == len(a) and all(got[p[0]] == pytest.approx(min(km(*p[1:], *q[1:]) for q in b), abs=1e-6) for p in a)
    assert pairs.closest_pair_km(df) == pytest.approx(min(km(*p[1:], *q[1:]) for i, p in enumerate(a) for q in a[:i]), abs=1e-6)
    assert pairs.closest_pair_km(df.limit(0)) is None


def test_points_in_polygons(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    small = [{"x": 1.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 1.5, "y": 2.0}]
    polys = spark.createDataFrame([(1, 16.0, square), (2, 0.5, small)], "polygon_id long, area double, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.2, 1.5), (2, 3.0, 3.0), (3, 4.0, 2.0), (4, 5.0, 5.0), (5, None, 1.0)], "id long, lat double, lon double")
    assert {tuple(r) for r in joins.points_in_polygons(pts, polys).collect()} == {(1, 2), (2, 1), (3, 1)}


def test_spaced_is_the_walk(spark):
    rows = places(250, 5)
    order = sorted(rows, key=lambda p: (hashlib.sha256(f"s|{p[0]}".encode()).hexdigest(), p[0]))
    kept = []
    for p in order:
        if all(km(*p[1:], *q[1:]) >= 900 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    assert {r["id"] for r in sampling.spaced(df, "id", 900.0, "s").collect()} == {p[0] for p in kept}


def test_spread_is_farthest_first(spark):
    rows = places(60, 6)
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    picks = [r["id"] for r in sampling.spread(df, "id", 6, 100.0, "s").orderBy("pick").collect()]
    by_id = {p[0]: p for p in rows}
    want = [min(rows, key=lambda p: (hashlib.sha256(f"s|{p[0]}".encode()).hexdigest(), p[0]))[0]]
    while len(want) < 6:
        far = {p[0]: min(km(*p[1:], *by_id[w][1:]) for w in want) for p in rows}
        want.append(max(far, key=lambda i: (round(far[i], 6), -i)))
    assert picks == want
    assert sampling.spread(df.limit(0), "id", 6, 100.0, "s").count() == 0
    assert sampling.widest_separation(df, "id", 6, "s") > 100
