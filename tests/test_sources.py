"""Readers and writers over files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_yaml_catalog(spark, tmp_path):
    put(tmp_path / "loc/a.yaml", "location_id: a\nmap_id: 'm 1'\ntruth_lat: 12.5  # north\ntruth_lon: -3\nassist_level: \"none\"\nbbox: [1, 2]\n")
    put(tmp_path / "loc/b.yaml", "truth_lat: 1\ntruth_lon: null\n")
    got = {r["location_id"]: tuple(r)[1:6] for r in readers.catalog_locations(spark, str(tmp_path / "loc")).collect()}
    assert got == {"a": ("m 1", 12.5, -3.0, "none", "a"), "b": ("b", 1.0, None, None, "b")}
    maps = put(tmp_path / "maps.yaml", "content_version: v1\nmaps:\n  - map_id: x\n    title: Ex\n    ranked_pool: true\n  - map_id: y\n    title: Why\n    ranked_pool: false\n")
    assert [tuple(r) for r in readers.catalog_maps(spark, maps).select("map_id", "title", "ranked_pool").orderBy("pos").collect()] == [("x", "Ex", True), ("y", "Why", False)]


def test_last_still_wins(spark, tmp_path):
    p = put(tmp_path / "still.json", json.dumps({"locations": [{"location_id": "a", "still_bundle_id": "old"}, {"location_id": "b", "still_bundle_id": "b1"}, {"location_id": "a", "still_bundle_id": "new"}]}))
    assert {(r["location_id"], r["still_bundle_id"]) for r in readers.still_index(spark, p).collect()} == {("a", "new"), ("b", "b1")}
    for i in (1, 2):
        put(tmp_path / f"hints/{i}.json", json.dumps({"location_id": "a", "n": i}))
    assert [r["n"] for r in readers.keyed_documents(spark, str(tmp_path / "hints"), "location_id string, n int", "location_id").collect()] == [2]


def test_strict_lines(spark, tmp_path):
    good = put(tmp_path / "good.jsonl", '{"map_id":"m","location_id":"a"}\n\n{"map_id":"m","location_id":"b"}\n')
    schema = "map_id string, location_id string"
    assert readers.strict_json_lines(spark, good, schema, ["map_id", "location_id"]).count() == 2
    for name, text in (("bad", "{oops"), ("missing", '{"map_id":"m"}'), ("twice", '{"map_id":"m","location_id":"a"}\n{"map_id":"m","location_id":"a"}')):
        with pytest.raises(Exception, match="bad line|repeated key"):
            readers.strict_json_lines(spark, put(tmp_path / f"{name}.jsonl", text), schema, ["map_id", "location_id"]).collect()
    commented = put(tmp_path / "c.jsonl", '# note\n{"map_id":"m"}\n')
    assert readers.json_lines(spark, commented, schema, comments=True).count() == 1


def test_concatenated_values(spark, tmp_path):
    p = put(tmp_path / "many.json", '[{"a": 1}, {"a": 2}]\n{"a": 3}\n[{"a": 4}]')
    assert [r["a"] for r in readers.concatenated_json(spark, p, "struct<a:int>").orderBy("at", "pos").collect()] == [1, 2, 3, 4]
    q = put(tmp_path / "line.json", '  [{"a": 1}][{"a": 2},\n\n{"a": 3}]{"a": 4}  ')
    assert [r["a"] for r in readers.concatenated_json(spark, q, "struct<a:int>").orderBy("at", "pos").collect()] == [1, 2, 3, 4]


def test_events(spark, tmp_path):
    p = put(tmp_path / "e.json", json.dumps([{"id": "x", "latitude": 1.5, "lon": "2", "date": "2024-01-01", "region": "n"}, {"lat": 1, "lon": 2, "datetime": "2024-02-02"}, {"lat": "?", "lon": 2, "date": "2024-01-01"}]))
    got = readers.events(readers.event_table(spark, p).withColumn("pos", F.lit(7)), "fire", "test").collect()
    assert {(r["event_id"], r["lat"], r["event_date"]) for r in got} == {("x", 1.5, "2024-01-01"), ("fire_000007", 1.0, "2024-02-02")}
    assert next(r["metadata"] for r in got if r["event_id"] == "x") == {"region": "n"}
    c = put(tmp_path / "e.csv", "event_id,lat,lon,event_date\nq,3,4,2024-01-01\n")
    assert readers.events(readers.event_table(spark, c), "fire", "test").count() == 1
    g = put(tmp_path / "g.csv", " Location_ID,AI_lat,ai_lon\na,1,2\nb,x,2\n")
    assert [tuple(r) for r in readers.csv_guesses(spark, g).orderBy("location_id").collect()] == [("a", 1.0, 2.0, None), ("b", None, 2.0, None)]
    with pytest.raises(ValueError, match="ai_lat"):
        readers.csv_guesses(spark, put(tmp_path / "h.csv", "location_id,ai_lon\na,1\n"))


def test_places_fall_back(spark, tmp_path):
    put(tmp_path / "b/poi_1/poi.json", json.dumps({"poi_id": "poi_1", "latitude": 1.0, "longitude": 2.0}))
    assert [r["poi_id"] for r in readers.places(spark, str(tmp_path / "b")).collect()] == ["poi_1"]
    put(tmp_path / "b/x_manifest.json", json.dumps({"points": [{"poi_id": "poi_7", "latitude": 1.0, "longitude": 2.0}]}))
    assert [r["poi_id"] for r in readers.places(spark, str(tmp_path / "b")).collect()] == ["poi_7"]
    with pytest.raises(ValueError, match="no places"):
        readers.places(spark, str(tmp_path / "none"))


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    p = put(tmp_path / "f.geojson", json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"ADMIN": "-99", "NAME": "Here"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"NAME": "River"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "properties": {"NAME": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
    ]}))
    got = readers.geojson_rings(spark, p, ["ADMIN", "NAME"]).collect()
    assert sorted((r["name"], len(r["ring"])) for r in got) == [("Here", 5), ("River", 2), ("Two", 5), ("Two", 5)]


def test_files_and_writers(spark, tmp_path):
    for name in ("a.png", "b.JSON", ".git/x", "deep/c.json"):
        put(tmp_path / "tree" / name, name)
    assert sorted(r["name"] for r in readers.files(spark, str(tmp_path / "tree"), [".json"]).collect()) == ["b.JSON", "c.json"]
    df = spark.createDataFrame([("train", 1, None), ("test", 2, "é"), ("train", 3, "z")], "split string, b int, a string")
    writers.split_json_lines(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("split = 'train'").count() == 2
    writers.parquet_shards(df.coalesce(1), str(tmp_path / "shards"), 2)
    assert len(list((tmp_path / "shards").glob("*.parquet"))) == 2 and readers.shards(spark, str(tmp_path / "shards"), ["b"]).columns == ["b"]
    assert [r[0] for r in writers.canonical_json(df).collect()] == ['{"a":null,"b":1,"split":"train"}', '{"a":"é","b":2,"split":"test"}', '{"a":"z","b":3,"split":"train"}']
    stored = spark.createDataFrame([(5, "x")], "id long, v string")
    assert sorted(tuple(r) for r in writers.append_with_ids(stored, spark.createDataFrame([("q",), ("p",)], "v string"), "id", "v").select("id", "v").collect()) == [(6, "p"), (7, "q")]
    assert readers.evolved(stored, {"id": ("long", 0), "flag": ("boolean", True)}).first().asDict() == {"id": 5, "v": "x", "flag": True}
