"""Catalogs, stores, pixels, rows and scores on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from geoloom.functions import boxes, text
from geoloom.operators import catalog, dedup, joins, pixels, ranking, regions, rows, scoring, stores, summaries


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_winners(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 1, "w"), ("a", 2, "y")], "k string, o int, v string")
    assert rows_of(dedup.first_wins(df, ["k"], F.col("o"))) == [("a", 1, "x"), (None, 1, "w")]
    assert rows_of(dedup.last_wins(df, ["k"], F.col("o"))) == [("a", 2, "y"), (None, 3, "z")]
    assert dedup.first_wins(df.limit(0), ["k"], F.col("o")).count() == 0
    with pytest.raises(ValueError, match="conflict"):
        dedup.must_be_empty(df, "conflict")


def test_append_is_idempotent(spark):
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    more = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3)], "k string, v int")
    once = dedup.append_once(stored, more, ["k"], F.col("v"))
    assert rows_of(once) == [("a", 1), ("b", 2)] == rows_of(dedup.append_once(once, more, ["k"], F.col("v")))


def test_board_places_ties_by_id(spark):
    df = spark.createDataFrame([("m", 2, "abcdefghij", 5, 1.0), ("m", 1, "q", 5, 1.0), ("m", 3, None, 9, 0.5), ("n", 4, "r", 1, 2.0)], "map_id string, id long, session_id string, score_points long, distance_km double")
    assert [tuple(r)[:4] for r in stores.ranked_board(df).orderBy("map_id", "place").collect()] == [("m", 1, 3, None), ("m", 2, 1, "RNK-Q"), ("m", 3, 2, "RNK-ABCDEFGH"), ("n", 1, 4, "RNK-R")]


def test_transitions_are_guarded(spark):
    jobs = spark.createDataFrame([(1, "queued"), (2, "completed"), (3, "running"), (4, "queued")], "job_id long, status string")
    ch = spark.createDataFrame([(1, "queued", "running", 1), (2, "completed", "running", 1), (3, "queued", "running", 1), (4, "queued", "completed", 1)], "job_id long, expected string, to_status string, at int")
    assert rows_of(stores.transitioned(jobs, ch)) == [(1, "running", True), (2, "completed", False), (3, "running", False), (4, "queued", False)]


def test_placed_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(7)
    out = ranking.placed(df, "id").collect()
    assert len(out) == 1000 and all(r["id"] == r["place"] for r in out)
    assert ranking.placed(df.limit(0), "id").count() == 0


def test_lint(spark):
    df = spark.createDataFrame([("a", "m", 1.0, 2.0), ("a", "m", 1.0, 2.0), ("b", None, 95.0, 2.0), ("c", " ", None, -181.0)], "location_id string, map_id string, truth_lat double, truth_lon double")
    assert {(r["code"], r["key"]) for r in catalog.lint_locations(df).collect()} == {("duplicate_location_id", "a"), ("missing_map_id", "b"), ("range_lat", "b"), ("missing_map_id", "c"), ("missing_truth_lat", "c"), ("range_lon", "c")}


def test_hints(spark):
    good = {f"tier_{i}": "fine" for i in range(1, 7)}
    df = spark.createDataFrame([(1, good, None), (2, good | {"tier_1": "at 12.34567, -8.91234"}, "full"), (3, good | {"tier_2": " "}, "full"), (4, {f"tier_{i}": "" for i in range(1, 7)}, "none"), (5, good | {"tier_3": "x" * 281}, "full")], "id int, hints map<string,string>, assist_level string")
    assert {tuple(r) for r in catalog.hint_violations(df, "id").collect()} == {("coordinate_literal", "2", "tier_1"), ("empty_tier", "3", "tier_2"), ("length_cap", "5", "tier_3")}


def test_leaks_are_found_in_schemas(spark):
    assert catalog.no_leak(spark.createDataFrame([(1,)], "a int")) is not None
    with pytest.raises(ValueError, match="truth_lat"):
        catalog.no_leak(spark.createDataFrame([([{"truth_lat": 1.0}],)], "a array<struct<truth_lat:double>>"))


def test_regions(spark):
    picture = ["aab", "cab", "aca"]
    px = [("t", y, x, "abc".index(c)) for y, line in enumerate(picture) for x, c in enumerate(line)]
    df = spark.createDataFrame(px, "tile string, y int, x int, k int")
    eight = {(r["class_id"], r["x1"], r["y1"], r["x2"], r["y2"], r["area_px"]) for r in regions.regions(df, "tile", "k").collect()}
    assert eight == {(0, 0, 0, 2, 2, 5), (1, 2, 0, 2, 1, 2), (2, 0, 1, 1, 2, 2)}
    four = sorted((r["class_id"], r["area_px"]) for r in regions.regions(df, "tile", "k", eight=False).collect())
    assert four == [(0, 1), (0, 1), (0, 3), (1, 2), (2, 1), (2, 1)]
    assert regions.regions(df.limit(0), "tile", "k").count() == 0


def test_fractions(spark):
    df = spark.createDataFrame([({0: 1.0, 1: 3.0, 12: 9.0, 2: -1.0},), ({},), (None,)], "f map<int,double>")
    got = [r[0] for r in df.select(pixels.normalised_fractions(F.col("f"))).collect()]
    assert got == [{0: 0.25, 1: 0.75}, {}, None]
    sample = df.limit(1).select(pixels.class_sample(F.col("f"))).first()[0]
    assert len(sample) == 32 and sample.count(1.0) == 24 and sample.count(0.0) == 8
    up = df.limit(1).select(pixels.shifted(F.col("f"), 6, 0.3, (0, 1))).first()[0]
    assert up == {1: 0.7, 6: 0.3}
    assert df.limit(1).select(pixels.absent_class(F.col("f"), F.array(F.lit(2)))).first()[0] == 3


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(boxes.iou(F.col("a"), F.col("b"))).collect()] == [0.142857, 0.0]
    g = spark.createDataFrame([('[{"label":"a","bbox":[0,0,1,1]}]',), ("[]",), ("{",), ('[{"label":"a","bbox":[0,0,1]}]',), (None,)], "t string")
    assert [r[0] for r in g.select(boxes.grounding_error(F.col("t"))).collect()] == ["ok", "ok", "json_decode", "item_0_bad_bbox", "json_decode"]


def test_texts(spark):
    df = spark.createDataFrame([("cover 23.9% and 0.3%, 1.5%; ~30% stays",), ("",), (None,)], "t string")
    assert [r[0] and r[0]["text"] for r in df.select(text.coarse_percentages(F.col("t"))).collect()] == ["cover ~25% and <1%, ~2%; ~30% stays", "", None]
    style = [r[0] for r in df.select(text.style_violations(F.lit("This sector offers a glimpse of a landscape, perfect for players and more."))).limit(1).collect()]
    assert style == [["banned_opener_0", "banned_phrase_0", text.CLUSTER_CODE]]
    caps = spark.createDataFrame([("One. Two three.", 60), ("x" * 100, 60)], "t string, n int").select(text.capped(F.col("t"), 10)).collect()
    assert [r[0] for r in caps] == ["One. Two…", "x" * 9 + "…"]


def test_messages(spark):
    raw = '[{"role":"user","content":[{"type":"image","image":"images/a.png"},{"type":"text","text":"Hi"},{"type":"text","text":" "}]},{"role":"assistant","content":"Plain"},{"role":"","content":"x"}]'
    df = spark.createDataFrame([(raw,), ("nope",), (None,)], "raw string").withColumn("m", rows.parsed_messages(F.col("raw")))
    got = df.select(rows.image_paths(F.col("m")).alias("p"), rows.role_length(F.col("m"), "user").alias("u"), rows.role_length(F.col("m"), "assistant").alias("a")).collect()
    assert tuple(got[0]) == (["images/a.png"], 4, 5) and got[1]["p"] == [] and got[2]["u"] == 0
    assert df.limit(1).select(F.size(rows.rewritten(F.col("m"), {"assistant": 100}))).first()[0] == 2
    assert rows.wanted_tasks(["per_class", "analysis"]) == ["production_analysis", "per_class_grounding", "per_class_focus"]


def test_contract(spark):
    fence = '\n```json\n{"boxes": [{"label": "a", "bbox": [0, 0, 1, 1], "confidence": 0.5}]}\n```'
    words = " ".join(["word"] * 12)
    df = spark.createDataFrame([(words + fence,), ("short" + fence,), (words,), (words + "\n```json\n{oops\n```",), (words + '\n```\n{"boxes": [{"bbox": [0, 0, 2, 1]}]}\n```',), ("[captions: " + words + fence,), (None,), (words + '```{"boxes": []}``` and ' + words + fence,)], "c string")
    assert [r[0]["verdict"] for r in df.select(scoring.contract_score(F.col("c"))).collect()] == ["ok", "preamble_too_short", "no_fenced_block", "json_parse_failed", "schema_invalid", "leak", "no_fenced_block", "ok"]


def test_composite_leaves_out_missing_scores(spark):
    df = spark.createDataFrame([(0.5, None, 1.0, None), (0.5, 0.2, 1.0, 0.4), (None, None, None, None)], "l double, g double, c double, f double")
    got = [r[0] for r in df.select(scoring.composite(*[F.col(x) for x in "lgcf"])).collect()]
    assert got == [pytest.approx(0.775, abs=1e-4), pytest.approx(0.18 * 0.5 + 0.42 * 0.2 + 0.22 + 0.18 * 0.4, abs=1e-4), 0.0]


def test_summaries_of_errors_only(spark):
    df = spark.createDataFrame([("m", None, "x", None, True), ("m", 0.5, None, 0.25, None)], "model string, score double, error string, lexical double, passed boolean")
    r = summaries.by_model(df, ["lexical"]).first()
    assert (r["n"], r["errors"], r["n_passed"], r["mean_score"], r["mean_lexical"]) == (2, 1, 0, 0.5, 0.25)
    assert summaries.parsed_thresholds("0.5, x 0.5 2 .25") == [0.25, 0.5]


def scene_rows(seed, n_events=150, n_scenes=400):
    """Events and scenes of a few sites and days, with equal times, equal gaps, nulls and repeated events."""
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    when = lambda: start + timedelta(days=rng.choice([*range(8), 70, 95, 120]), hours=rng.choice([0, 6, 12, 18, 23]))
    events = [(i, rng.choice(["a", "a", "b", None]), None if i % 40 == 0 else when()) for i in range(n_events)]
    scenes = [(i, rng.choice(["a", "a", "b", "c", None]), None if i % 50 == 0 else when(), rng.choice([None, 0.0, 5.0, 10.0, 50.0])) for i in range(n_scenes)]
    return events + events[:9], scenes


@pytest.mark.parametrize("zero", [False, True])
def test_scene_pairs_against_all_pairs(spark, zero):
    for seed, n in ((1, 400), (2, 25)):
        events, scenes = scene_rows(seed, n_scenes=n)
        got = joins.scene_pairs(spark.createDataFrame(events, "event_id long, site string, event_ts timestamp"), spark.createDataFrame(scenes, "scene_id long, site string, scene_ts timestamp, cloud double"), key="site", cloud_zero_is_missing=zero)

        def best(event, sign, low, high):
            _, site, ts = event
            met = [(abs(t - ts), 100.0 if zero and c == 0 else c, sign * (t - datetime(2024, 1, 1)), i) for i, k, t, c in scenes if ts and t and site and k == site and c is not None and c < 30 and low <= (t.date() - ts.date()).days <= high]
            return min(met)[3] if met else None

        assert sorted(tuple(r) for r in got.collect()) == sorted(((e[0], best(e, -1, -90, 0), best(e, 1, 0, 60)) for e in events), key=lambda r: r[0]), seed


def joined_rows(df):
    """The rows of every join of a plan that has run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            out.append(node.metrics().get("numOutputRows").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_scene_pairs_meet_no_crowd(spark):
    events = spark.range(500).select(F.col("id").alias("event_id"), F.lit("a").alias("site"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 1000).alias("event_ts"))
    scenes = spark.range(5000).select(F.col("id").alias("scene_id"), F.lit("a").alias("site"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 100).alias("scene_ts"), F.lit(1.0).alias("cloud"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = joins.scene_pairs(events, scenes, key="site")
        assert sorted(map(tuple, df.collect())) == [(i, i * 10, i * 10) for i in range(500)]
        assert 0 < sum(joined_rows(df)) <= 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_spaced_places_of_a_crowd_do_not_meet_as_pairs(spark, monkeypatch):
    """F8: all pairs of near places were made before the walk."""
    from geoloom.operators import sampling

    rows = [(i, 40.0 + (i % 50) * 1e-4, 7.0 + (i // 50) * 1e-4) for i in range(1500)] + [(5000 + i, -60.0 + i * 0.4, 20.0) for i in range(200)]
    pairs = []
    within = sampling.within_km

    def counted(*given, **named):
        out = within(*given, **named)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(sampling, "within_km", counted)
    monkeypatch.setattr(sampling, "FIRST_PART", 30, raising=False)
    df = spark.createDataFrame(rows, "id long, lat double, lon double").repartition(3)
    got = {r.id for r in sampling.spaced(df, "id", 100.0, "s").collect()}
    assert sum(pairs) < 100_000

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    kept = []
    for r in sorted(rows, key=lambda r: hashlib.sha256(f"s|{r[0]}".encode()).hexdigest()):
        if all(km(r, o) >= 100.0 for o in kept):
            kept.append(r)
    assert got == {r[0] for r in kept}
