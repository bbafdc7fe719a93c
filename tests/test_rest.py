"""Functions that no query reaches, each over a few values."""

import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from geoloom.functions import boxes, geo, raster
from geoloom.functions import text as T
from geoloom.operators import catalog, pixels, ranking, rows, sampling, scoring
from geoloom.sources import readers, writers


def values(spark, *columns):
    """The values of constant expressions."""
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def box(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_boxes(spark):
    got = values(spark, boxes.clamped(box(-5, 2, 50, 9), 20, 8), boxes.clamped(box(30, 2, 50, 9), 20, 8), boxes.normalised(box(0, 2, 10, 8), 20, 8))
    assert got == [[0.0, 2.0, 20.0, 8.0], None, [0.0, 0.25, 0.5, 1.0]]
    item = lambda label, *xs: F.struct(F.lit(label).alias("label"), box(*xs).alias("box"), boxes.area(box(*xs)).alias("area"))
    none = F.array().cast("array<struct<label:string,box:array<double>,area:double>>")
    gold = F.array(item("a", 0, 0, 0.5, 0.5), item("b", 0, 0, 1, 1))
    found = F.array(item("a", 0, 0, 0.5, 0.25), item("c", 0, 0, 1, 1))
    got = values(spark, boxes.grounding_score(gold, found), boxes.grounding_score(gold, found, same_label=False), boxes.grounding_score(none, found), boxes.grounding_score(gold, none), boxes.grounding_score(none, none, no_features=F.lit(True)))
    assert got[:1] == [0.25] and abs(got[1] - 0.75) < 1e-12 and got[2:] == [None, 0.0, 1.0]


def test_catalog_rows(spark):
    m = spark.createDataFrame([("a", "s", None), ("b", None, "missing_still")], "location_id string, still_id string, problem string")
    assert catalog.must_have_stills(m.where("still_id is not null")).collect()[0].still_id == "s"
    with pytest.raises(Exception, match="no still for b"):
        catalog.must_have_stills(m).collect()
    got = catalog.seed_rows({"x": "d", "y": "e"}, spark.createDataFrame([("1", None), ("2", "q")], "id string, x string")).collect()
    assert [tuple(r) for r in got] == [("1", "d", "e"), ("2", "q", "e")]


def test_places(spark):
    frame = geo.box_around_flat(F.lit(10.0), F.lit(20.0), 1.0)
    offset = geo.street_offset(F.lit(10.0), F.lit(20.0), 50.0, F.lit(1.0), F.lit(0.25))
    got = values(spark, geo.in_box(F.lit(10.0), F.lit(20.0), frame), geo.in_box(F.lit(10.02), F.lit(20.0), frame), geo.in_box(F.lit(10.02), F.lit(20.0), frame, 1.0), geo.reference_grid(F.lit(10.0), F.lit(20.0), frame, 10.0), offset, geo.haversine_m(F.lit(10.0), F.lit(20.0), offset["lat"], offset["lon"]))
    assert got[:3] == [True, False, True] and got[3].epsg == 32634 and {got[3].width, got[3].height} <= {200, 201}
    assert abs(got[5] - 50.0) < 0.01 and got[4].lon > 20 and abs(got[4].lat - 10) < 1e-5
    whole = F.struct(F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(8.0).alias("east"), F.lit(4.0).alias("north"))
    assert tuple(values(spark, pixels.zone_centre(F.lit(0), F.lit(1), 4, whole))[0]) == (3.5, 3.0)


def test_raster_and_ranks(spark):
    got = values(spark, *[raster.cloud_colour(F.lit(c)) for c in (9, 7, 4)], raster.reflectance(F.lit(0.5), F.lit(1.2)), raster.reflectance(F.lit(500.0), F.lit(9000.0)))
    assert got == [[255, 255, 255, 200], [160, 160, 160, 140], [0, 0, 0, 0], 5000.0, 500.0]
    texts = spark.createDataFrame([("g", "This sector offers a long enough text for the rules."), ("g", "A plain and long enough text without any stock phrase."), ("g", "short"), ("h", "b"), ("h", "a")], "g string, t string")
    got = {r.g: r.t for r in ranking.best_candidates(texts, "g", "t", T.style_rank(F.col("t"))).collect()}
    assert got == {"g": "A plain and long enough text without any stock phrase.", "h": "a"}


def test_files(spark, tmp_path):
    for name, doc in (("metadata/s1/poi_1_g2.json", {"poi_id": "poi_1_g2", "lat": 1.0}), ("metadata/poi_2.json", {"poi_id": "poi_2", "lat": 2.0}), ("metadata/x.txt", {})):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc))
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in readers.checksums(spark, str(tmp_path)).collect()}
    assert sums["x.txt"] == hashlib.sha256(b"{}").hexdigest() and len(sums) == 3
    docs = readers.sidecars(spark, str(tmp_path), "poi_id string, lat double")
    assert {(r.stem, r.lat) for r in docs.collect()} == {("poi_1_g2", 1.0), ("poi_2", 2.0)}
    got = readers.place_index(docs.withColumn("lon", F.lit(0.0))).collect()
    assert {(r.id, r.lat) for r in got} == {("poi_1_g2", 1.0), ("poi_1", 1.0), ("poi_2", 2.0)}
    rows_ = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n int")
    for _ in range(2):
        writers.append_json_lines(rows_, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    writers.by_value(rows_, str(tmp_path / "by"), "k")
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/by/k=*")) == ["k=a", "k=b"] and spark.read.json(str(tmp_path / "by")).count() == 3
    writers.text_lines(rows_, "n", str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1", "2", "3"]


def test_chat_rows(spark):
    m = rows.chat_row(F.array(F.lit("images/a.png"), F.lit("images/a.png")), F.lit("see **this**"), F.lit("- built here"))
    got = values(spark, rows.all_paths(m, F.array(F.lit("images/b.png"), F.lit("images/a.png"))), rows.image_paths(rows.with_media_tag(m, "t1")), rows.final_text(F.lit("- the **built** part\n\n\n\nend"), F.lit("user")), rows.final_text(F.lit("**x**"), F.lit("system")))
    assert got == [["images/a.png", "images/b.png"], ["images/t1/a.png"] * 2, "the built areas part\n\nend", "**x**"]
    seen = spark.createDataFrame([("poi_1_g1", 2, "other/x"), ("poi_1_g2", 5, "images/y"), ("poi_2", 1, "z")], "stem string, n int, path string")
    got = {r.base: (r.first_pos.n, r.hint) for r in rows.first_images(seen, T.base_id(F.col("stem")), ["n"]).collect()}
    assert got == {"poi_1": (2, "images/y"), "poi_2": (1, "z")}
    paths = [r.path for r in rows.shard_paths(spark.createDataFrame([("s", "s00001")], "stem string, h string"), 2, F.col("h")).orderBy("pos").collect()]
    assert paths == ["metadata/s00001/s.json", "metadata/s00000/s.json", "metadata/s.json"]
    found = spark.createDataFrame([(i, list("abcdef")) for i in range(50)], "k long, f array<string>")
    mixed = rows.mixed_findings(found, "k", "f", "seed").collect()
    for r in mixed:
        h = lambda *x: hashlib.sha256("|".join(("seed", str(r.k), *x)).encode()).hexdigest()  # noqa: E731, B023
        assert r.f == sorted("abcdef", key=h)[: 2 + int(h("n")[:8], 16) % 3]


def test_samples(spark):
    places = spark.createDataFrame([(i, 0.0, float(i)) for i in range(30)], "id long, lat double, lon double")
    assert sampling.select_places(places, "id", 5, 0.0, "s").count() == 5 and sampling.spaced_head(places, "id", 3, 300.0, "s").count() == 3
    far = sorted(r.lon for r in sampling.select_places(places, "id", 4, 300.0, "s").collect())
    assert len(far) == 4 and all(b - a > 2 for a, b in zip(far, far[1:]))
    allow = spark.createDataFrame([(3,), (9,), (1,)], "id long")
    assert [r.id for r in sampling.selected(places, "id", allow=allow, limit=2).collect()] == [1, 3] and sampling.selected(places, "id", limit=4, seed="x").count() == 4


def test_scores_and_texts(spark):
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    shares = lambda **kw: F.create_map(*[F.lit(x) for pair in kw.items() for x in pair])
    numbers = F.array(F.lit(29.0), F.lit(80.0))
    got = values(
        spark, scoring.alignment_score(words("a"), words("a", "b"), F.lit(10.0)), scoring.alignment_score(words("a"), words("a", "b"), F.lit(400.0)), scoring.disagreement(numbers, shares(a=30.0), shares(a=70.0)), scoring.swapped_shares(shares(a=50.0, b=30.0, c=20.0)), scoring.flipped(numbers),
        T.canonical_key(b=F.lit(1), a=F.lit("x")), *[T.error_class(F.lit(m)) for m in ("Read timed out", "connection refused", "HTTP 403", "status 502", "odd", None)], T.minified_json(F.lit('{"b": 1, "a": [1, 2]}')), T.minified_json(F.lit("no")), T.redacted_blob(F.lit("- Data (JSON):\n{\"a\": 1}\n\nTask: x"), "Data"),
        T.replaced(F.lit("a The b"), [("the", "$x")], any_case=True), T.usable(F.lit(" "), F.lit("-99"), F.lit(" y ")), T.retry_advice(words("too_short", "banned_phrase_1", "banned_phrase_2", "odd")), T.retry_advice(F.array().cast("array<string>")),
    )
    assert got[:5] == [0.5, 0.26, 0.5, {"a": 20.0, "b": 30.0, "c": 50.0}, [-29.0, -80.0]]
    assert got[5] == hashlib.sha256(b'{"a":"x","b":1}').hexdigest() and got[6:12] == ["timeout", "connection", "auth", "upstream", "internal", "internal"]
    assert got[12:17] == ['{"a":[1,2],"b":1}', "no", "- Data (JSON):\n<omitted>\n\nTask: x", "a $x b", "y"]
    assert got[17].startswith("write at least two full sentences; avoid brochure phrases") and got[17].endswith("; odd") and got[17].count("brochure") == 1 and got[18] == ""
