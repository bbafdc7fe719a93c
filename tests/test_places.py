"""Lines, areas, closest and far pairs and spread samples against brute force, dense cities, poles and the date line included."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import areas, close, joins, lines, pairs, sampling
from geoloom.sources import readers

from test_geo import km, places

PLACE = "id long, lat double, lon double"
RING = "array<struct<x:double,y:double>>"


def city(n, seed, lat=52.5, lon=13.4, wide=0.2, first=1000):
    rng = random.Random(seed)
    return [(first + i, lat + rng.gauss(0, wide), lon + rng.gauss(0, wide)) for i in range(n)]


# Lines


def vector(lat, lon):
    return (math.cos(math.radians(lat)) * math.cos(math.radians(lon)), math.cos(math.radians(lat)) * math.sin(math.radians(lon)), math.sin(math.radians(lat)))


def arc_km(p, a, b, steps=4000):
    """By walking along the arc, and then finer around the best step."""
    u, v = vector(*a), vector(*b)
    angle = km(*a, *b) / 6371.0
    if angle < 1e-12:
        return km(*p, *a)

    def at(t):
        x, y, z = ((math.sin((1 - t) * angle) * i + math.sin(t * angle) * j) / math.sin(angle) for i, j in zip(u, v, strict=True))
        return km(*p, math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x)))

    low, high = 0.0, 1.0
    for _ in range(4):
        ts = [low + (high - low) * i / 60 for i in range(61)]
        best = min(ts, key=at)
        low, high = max(0.0, best - (high - low) / 60), min(1.0, best + (high - low) / 60)
    return min(at(low), at(high), at((low + high) / 2))


def paths(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = rng.uniform(-80, 80), rng.uniform(-175, 175)
        out.append((i, [(lat, lon)] + [(max(-89.0, min(89.0, lat + rng.uniform(-4, 4) * k)), (lon + rng.uniform(-4, 4) * k + 180) % 360 - 180) for k in range(1, rng.randint(1, 5))]))
    return out + [(n, [(10.0, 170.0), (12.0, -170.0)]), (n + 1, [(89.5, 0.0), (89.5, 120.0)]), (n + 2, [(5.0, -60.0), (5.0, 60.0)])]


def line_table(spark, made):
    rows = [(i, [{"x": o, "y": a} for a, o in p]) for i, p in made] + [(900, None), (901, []), (902, [{"x": None, "y": 1.0}])]
    return spark.createDataFrame(rows, f"line_id long, path {RING}")


@pytest.mark.parametrize("degrees", [0.1, 5.0])
def test_nearest_line_against_walks(spark, degrees):
    made = paths(25, 8)
    where = places(60, 3) + city(30, 1, wide=2.0) + [(5000, 30.0, 0.0), (5001, 11.0, 180.0), (5002, 90.0, 77.0), (5003, None, 4.0)]
    got = {r["id"]: r for r in lines.nearest_line(spark.createDataFrame(where, PLACE), line_table(spark, made), degrees=degrees).collect()}
    assert set(got) == {p[0] for p in where if p[1] is not None}
    for i, lat, lon in where:
        if lat is not None:
            far = {k: min(arc_km((lat, lon), a, b) for a, b in zip(p, p[1:] or p, strict=False)) for k, p in made}
            assert got[i]["km"] == pytest.approx(min(far.values()), abs=2e-3) and far[got[i]["line_id"]] == pytest.approx(min(far.values()), abs=2e-3)
    assert got[5000]["km"] < 2600 and got[5001]["km"] < 30  # an arc bulges to the pole, and goes over the date line


def test_nearest_line_at_a_distance_meets_the_edge_of_a_crowd(spark):
    crowd = [(i, [(60.0 + i % 40 * 0.2, i // 40 * 7.0 - 170), (60.1 + i % 40 * 0.2, i // 40 * 7.0 - 169)]) for i in range(1600)]
    far = [(i, 20.0 + i % 7, i * 3.0 - 170) for i in range(100)]
    arcs = lines.arcs(line_table(spark, crowd))
    points = lines.sampled(arcs, 50.0).select(F.struct("line_id", "arc").alias("at"), "lat", "lon")
    assert close.candidates(spark.createDataFrame(far, PLACE).select("lat", "lon"), points, 25.0).count() < 1500
    got = {r["id"]: r["km"] for r in lines.nearest_line(spark.createDataFrame(far, PLACE), line_table(spark, crowd)).collect()}
    for i, lat, lon in far[::9]:
        assert got[i] == pytest.approx(min(arc_km((lat, lon), *p) for _, p in crowd if p[0][0] < 62), abs=0.01)


def test_samples_of_lines_do_not_grow_with_positions(spark, monkeypatch):
    """samples were as many as positions, so the rows of one task grew faster than these."""
    coasts = [(k, [(k * 29 % 170 - 85 + i % 3 * 4.0, -170.0 + 42.5 * i) for i in range(9)]) for k in range(5)]
    town = [(100 + i, [(50.0 + i % 20 * 1e-3, 8.0 + i // 20 * 1e-3), (50.0003 + i % 20 * 1e-3, 8.0 + i // 20 * 1e-3)]) for i in range(200)]
    where = places(300, 5) + city(900, 2, lat=50.01, lon=8.005, wide=0.01)
    counts = []

    def counted(positions, points, slack):
        out = close.candidates(positions, points, slack)
        counts.append((points.count(), out.count()))
        return out

    monkeypatch.setattr(lines, "candidates", counted)
    got = {r["id"]: r["km"] for r in lines.nearest_line(spark.createDataFrame(where, PLACE), line_table(spark, coasts + town)).collect()}
    assert counts[0][0] < 10 * (5 * 8 + 200) + 100 and counts[0][1] < 12 * len(where)
    for i, lat, lon in where[::45]:
        assert got[i] == pytest.approx(min(arc_km((lat, lon), a, b) for _, p in coasts + town for a, b in zip(p, p[1:], strict=False)), abs=2e-3)


def test_nearest_far_from_a_crowd(spark, monkeypatch):
    crowd = [(i, 70.0 + i % 40 * 0.1, i // 40 * 0.1) for i in range(1600)] + [(2000, 70.0, 0.0)]
    far = [(i, -80.0 + i % 40, i * 1.7 - 170) for i in range(200)] + [(500, None, 1.0)]
    monkeypatch.setattr(joins, "within_km", None)  # rings around a lonely place hold the whole crowd
    got = {r["id"]: (r["feature_id"], r["km"]) for r in joins.nearest(spark.createDataFrame(far, PLACE), spark.createDataFrame(crowd, "feature_id long, lat double, lon double")).collect()}
    assert len(got) == 200
    for i, lat, lon in far[:200:7]:
        assert got[i][1] == pytest.approx(min(km(lat, lon, y, x) for _, y, x in crowd), abs=1e-6)


def test_nearest_line_of_nothing_and_ties(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0)], PLACE)
    assert lines.nearest_line(df, line_table(spark, [])).count() == 0
    assert lines.nearest_line(df.limit(0), line_table(spark, paths(3, 1))).count() == 0
    same = [(7, [(1.0, 0.0), (1.0, 10.0)]), (4, [(1.0, 0.0), (1.0, 10.0)])]
    assert [r["line_id"] for r in lines.nearest_line(df, line_table(spark, same)).collect()] == [4]


# Areas


def even_odd(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ax, ay) == (bx, by):
                continue
            level = abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) < 1e-12
            if level and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def star(rng, x, y, size, points):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(points))
    return [(x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]


def polygon_rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(12):
        x, y, size = rng.uniform(-150, 150), rng.uniform(-60, 60), rng.choice([0.5, 4, 25])
        rings = [star(rng, x, y, size, rng.choice([3, 8, 120]))]
        rings += [star(rng, x, y, size / 4, 9)] * (i % 2) + [star(rng, x + 2.5 * size, y, size / 2, 5)] * (i % 3 == 0)
        out.append((i, size, rings))
    grid = [[(0.0, 0.0), (16.0, 0.0), (16.0, 16.0), (0.0, 16.0), (0.0, 0.0)], [(8.0, 8.0), (12.0, 8.0), (12.0, 12.0), (8.0, 12.0)]]  # along the cells' own sides
    return out + [(50, 1.0, grid), (51, 3.0, [[(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)]])]


def polygon_table(spark, rows):
    made = [(i, float(a), [[{"x": x, "y": y} for x, y in r] for r in rings], f"c{i % 4} ") for i, a, rings in rows]
    return spark.createDataFrame(made + [(98, 1.0, None, "c1"), (99, 1.0, [[], None], "c1")], f"polygon_id long, area double, rings array<{RING}>, code string")


@pytest.mark.parametrize(("largest", "halvings", "few"), [(8.0, 8, 12), (32.0, 3, 1)])
def test_holding_against_even_odd(spark, largest, halvings, few):
    rows, rng = polygon_rows(5), random.Random(6)
    points = [(x, y) for x in (-1.0, 0.0, 4.0, 8.0, 10.0, 12.0, 16.0, 17.0) for y in (-1.0, 0.0, 8.0, 10.0, 12.0, 16.0, 17.0)]
    for _, size, rings in rows[:12]:
        points += [p for r in rings for p in r[:6]] + [(rings[0][0][0] + rng.uniform(-1, 1) * size, rings[0][0][1] + rng.uniform(-1, 1) * size) for _ in range(25)]
    points = [(max(-180.0, min(180.0, x)), max(-90.0, min(90.0, y))) for x, y in points] + [(180.0, 90.0), (-180.0, -90.0)]
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)] + [(9999, None, 1.0)], PLACE)
    got = {(r["id"], r["polygon_id"]) for r in areas.holding(df, polygon_table(spark, rows), largest=largest, halvings=halvings, few=few).collect()}
    assert got == {(i, k) for i, (x, y) in enumerate(points) for k, _, rings in rows if even_odd(rings, x, y)}


def test_ways_that_bend_on_an_edge(spark):
    # The edges of these diamonds pass the sides of cells at the points' own latitudes, but for rounding.
    diamond = lambda x, y, h: [(x + h, y), (x, y + h), (x - h, y), (x, y - h)]
    rows, at = [], [(8, -57.68, -61.28, 6.0), (7, -104.32, -11.12, 5.0), (13, -111.68, -40.08, 6.0), (10, 35.6, -25.6, 3.0)]
    for i, x, y, h in at:
        rows.append((i, h, [diamond(x, y, h), diamond(x, y, h / 2), diamond(x + 2 * h, y, h / 3)]))
    points = [(3682, -61.6, -50.9), (14112, -60.6, -57.9), (28736, -11.8, -94.7), (36998, -42.4, -104.1), (44718, -38.4, -114.1), (43664, -28.2, 43.7), (85659, -26.7, 37.2)]
    got = {(r["id"], r["polygon_id"]) for r in areas.holding(spark.createDataFrame(points, PLACE), polygon_table(spark, rows)).collect()}
    held = lambda a, o, x, y, h: h / 2 <= abs(o - x) + abs(a - y) <= h or abs(o - x - 2 * h) + abs(a - y) <= h / 3
    assert got == {(i, k) for i, a, o in points for k, x, y, h in at if held(a, o, x, y, h)} == {(28736, 7), (44718, 13), (85659, 10)}


def test_cells_inside_need_no_edges(spark):
    cells = areas.cover(polygon_table(spark, polygon_rows(5)[-1:])).collect()
    assert sum(not c["edges"] for c in cells) > 800 and all(len(c["edges"]) <= 4 for c in cells)


def test_codes_stand_in_for_areas(spark):
    square = lambda x, y: [[(x + 0.0, y + 0.0), (x + 2.0, y + 0.0), (x + 2.0, y + 2.0), (x + 0.0, y + 2.0)]]
    polys = polygon_table(spark, [(0, 4, square(0, 0)), (4, 4, square(20, 0)), (1, 1, square(0, 0)), (2, 4, [])])
    points = spark.createDataFrame([(1, 1.0, 1.0, "c0"), (2, 1.0, 15.0, " C0"), (3, 1.0, 5.0, "c0"), (4, 1.0, 5.0, None), (5, 1.0, 5.0, "zz"), (6, None, 1.0, "c0"), (7, 0.5, 21.0, "c1")], PLACE + ", code string")
    assert {tuple(r) for r in areas.with_code(points, polys).collect()} == {(1, 1, "inside"), (2, 4, "nearest"), (3, 0, "nearest"), (7, 4, "inside")}
    assert areas.with_code(points, polys.limit(0)).count() == 0 and areas.with_code(points.limit(0), polys).count() == 0


def test_geojson_areas_keep_holes(spark, tmp_path):
    outer, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]
    feature = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    feats = [feature("Polygon", [outer, hole], NAME="A", ISO=" de"), feature("MultiPolygon", [[outer, hole], [[[9, 9], [10, 9], [10, 10]]]], NAME="B"), feature("Point", [1, 1], NAME="C"), feature("Polygon", [[[0, 0], [0, 0], [1, 1]]], NAME="D")]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    got = readers.geojson_areas(spark, str(tmp_path / "a.geojson"), ["NAME"], ["ISO"]).orderBy("polygon_id").collect()
    assert [(r["name"], r["code"], len(r["rings"]), r["area"]) for r in got] == [("A", "DE", 2, 15.0), ("B", None, 3, 15.5)]
    df = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 9.2, 9.8)], PLACE)
    found = areas.holding(df, readers.geojson_areas(spark, str(tmp_path / "a.geojson"), ["NAME"], ["ISO"])).collect()
    assert {(r["id"], r["polygon_id"]) for r in found} == {(2, 0), (2, 1), (3, 1)}


# Pairs


@pytest.mark.parametrize("rows", [places(40, 2), city(400, 3), city(300, 4, lat=89.99, wide=0.01) + places(30, 5), city(200, 6, lon=180.0) + [(1, 52.5, -179.999)], places(2, 1)[:2]])
def test_closest_pair(spark, rows):
    rows = [(i, max(-90.0, min(90.0, a)), (o + 180) % 360 - 180) for i, a, o in rows]
    df = spark.createDataFrame(rows + [(77, None, 1.0)], PLACE)
    assert pairs.closest_pair_km(df) == pytest.approx(min(km(*p[1:], *q[1:]) for i, p in enumerate(rows) for q in rows[:i]), abs=1e-6)


def test_closest_pair_of_the_same_places(spark):
    rows = [(i, 1.0, 2.0) for i in range(50)]
    assert pairs.closest_pair_km(spark.createDataFrame(rows, PLACE)) == 0.0
    assert pairs.closest_pair_km(spark.createDataFrame([(1, 1.0, 2.0)] * 30 + [(2, 1.5, 2.0)], PLACE)) == pytest.approx(km(1.0, 2.0, 1.5, 2.0))
    assert pairs.closest_pair_km(spark.createDataFrame([(1, 1.0, 2.0)] * 3, PLACE)) is None


@pytest.mark.parametrize("most", [0.0, 30.0, 95.0, 900.0, 19_000.0, 30_000.0])
def test_first_far_pair(spark, most, monkeypatch):
    monkeypatch.setattr(pairs, "FEW_PAIRS", 6)
    groups = {1: places(30, 1), 2: city(120, 2), 3: city(60, 3) + [(9, 0.0, 0.0)], 4: [(1, 5.0, 5.0)] * 1 + [(2, 5.0, 5.0)], 5: city(90, 4, lat=89.9, wide=0.3), 6: city(1, 5), 7: [(5, 0.0, 0.0), (3, 0.0, 180.0), (4, 0.0, 0.0)]}
    rng = random.Random(1)
    rows, want = [], {}
    for g, made in groups.items():
        made = [(a if abs(a) <= 90 else 90.0, (o + 180) % 360 - 180) for _, a, o in made]
        pos = rng.sample(range(1000), len(made))
        rows += [(g, p, a, o) for p, (a, o) in zip(pos, made, strict=True)]
        found = sorted((p, q) for p, x in zip(pos, made, strict=True) for q, y in zip(pos, made, strict=True) if p < q and km(*x, *y) > most)
        if found:
            want[g] = found[0]
    df = spark.createDataFrame(rows + [(None, 1, 0.0, 0.0), (None, 2, 0.0, 90.0), (8, 1, None, 0.0)], "job long, pos long, lat double, lon double")
    got = {r["job"]: (r["pos_a"], r["pos_b"]) for r in pairs.first_far_pair(df, "job", most).collect()}
    assert got == want


# Spread samples


@pytest.mark.parametrize(("apart", "k"), [(0.0, 12), (400.0, 30)])
def test_spread_touches_few_cells_and_is_farthest_first(spark, apart, k, monkeypatch):
    monkeypatch.setattr(sampling, "SPREAD_CELLS", 3)
    rows = places(80, 6) + [(i, max(-90.0, min(90.0, a)), o) for i, a, o in city(200, 7, wide=3.0)]
    by_id = {p[0]: p for p in rows}
    want = [min(rows, key=lambda p: (hashlib.sha256(f"s|{p[0]}".encode()).hexdigest(), p[0]))[0]]
    while len(want) < k:
        far = {p[0]: min(km(*p[1:], *by_id[w][1:]) for w in want) for p in rows}
        best = max(far, key=lambda i: (round(far[i], 7), -i))
        if far[best] < apart:
            break
        want.append(best)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(7777, None, None, "x")], PLACE + ", cell string")
    assert [r["id"] for r in sampling.spread(df, "id", k, apart, "s").orderBy("pick").collect()] == want


def test_spread_of_more_than_there_are(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 9.0)], PLACE)
    assert sampling.spread(df, "id", 9, 0.0, "s").count() == 2 + (sampling.spread(df, "id", 1, 0.0, "s").first()["id"] == 2)
    assert sampling.spread(df, "id", 0, 0.0, "s").count() == 0
