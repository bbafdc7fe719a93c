"""YAML documents, against values by hand and JSON, which is YAML too."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import yaml
from geoloom.sources import readers, writers

GOOD = [
    ("a: 1\nb: 'x y'\nc: \"q\\n\\u00e9\"\n", {"a": 1, "b": "x y", "c": "q\né"}),
    ("a:\n  - 1\n  - b: 2\n    c: 3\n  -\n    d: 4\n  - - 5\n    - 6\n", {"a": [1, {"b": 2, "c": 3}, {"d": 4}, [5, 6]]}),
    ("maps:\n- map_id: x\n  title: POI x\n  local_only: true\n- map_id: y\n", {"maps": [{"map_id": "x", "title": "POI x", "local_only": True}, {"map_id": "y"}]}),
    ("a: |\n  one\n   two\n\n  three\nb: >-\n  fold\n  ed\n\n  para\nc: |+\n  k\n\nd: 1", {"a": "one\n two\n\nthree\n", "b": "fold ed\npara", "c": "k\n\n", "d": 1}),
    ("a: [1, 'b', {c: d, e: [2]}]\nb: {x: 1, y: }\nc: [\n  1,\n  2 # two\n]\nd: z", {"a": [1, "b", {"c": "d", "e": [2]}], "b": {"x": 1, "y": None}, "c": [1, 2], "d": "z"}),
    ("# c\n---\na: b # d\nu: http://x.y/z#w\nt: 12:30\n...\n", {"a": "b", "u": "http://x.y/z#w", "t": "12:30"}),
    ("a: plain\n  goes on\nb: yes\nc: ~\nd:\ne: 0x1F\nf: 1.5\nh: 017\ni: -3\nj: 2024-01-01\nk: 'no'", {"a": "plain goes on", "b": True, "c": None, "d": None, "e": 31, "f": 1.5, "h": 15, "i": -3, "j": "2024-01-01", "k": "no"}),
    ("a: >\n  x\n  y\n\n\n  z\n   more\n  w\n", {"a": "x y\n\nz\n more\nw\n"}),
    ("a: \"multi\n  line\n\n  text\"\nb: 2", {"a": "multi line\ntext", "b": 2}),
    ("", None),
    ("- a\n- b", ["a", "b"]),
]


@pytest.mark.parametrize(("text", "value"), GOOD)
def test_documents(text, value):
    made, error = yaml.parsed(text)
    assert error is None and json.loads(made) == value


@pytest.mark.parametrize("text", ["a: &x 1\nb: *x", "? x", "a:\n    b: 1\n  c: 2", "a: 1\n---\nb: 2", "a: b: c", "a: [1, 2", "\ta: 1", "a: 'x", "a: !!int 3", "[" * 200_000 + "]" * 200_000, "a: " + "{b: " * 200_000, "- " * 2000 + "x"])
def test_what_cannot_be_read_is_told(text):
    made, error = yaml.parsed(text)
    assert made is None and error


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(st.characters(codec="utf-8", exclude_characters="\x85\u2028\u2029\ufeff", exclude_categories=("Cs", "Cc")), max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("abc d", max_size=4), v, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 2]))
def test_json_is_read_as_it_is(value, indent):
    made, error = yaml.parsed("k: " + json.dumps(value, ensure_ascii=False, indent=indent).replace("\n", "\n  "))
    assert error is None and json.loads(made) == {"k": value}


def test_quoted_texts_come_back(spark):
    texts = ["plain", "yes", "a: b", "#x", "", " lead", "tail ", "é\"'\\\n\t", "12", "null", "- a", "Null", "x #y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", yaml.document(F.concat(F.lit("k: "), yaml.quoted(F.col("t")), F.lit("\n"))).alias("d"))
    for r in df.select("t", F.try_variant_get("d.value", "$.k", "string").alias("v"), "d.error").collect():
        assert r["error"] is None and r["v"] == r["t"]


def test_map_files(spark, tmp_path):
    for name, text in {"a": "maps:\n- map_id: x\n- 5\n- title: no id\n- map_id: x\n", "b": "maps: 7\n", "c": "maps: &x\n", "d": "content_version: v\nmaps: []\n", "e": "maps:\n"}.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    got = {(r["code"], r["key"] if r["code"] != "maps_yaml_parse" else "") for r in readers.lint_map_files(spark, str(tmp_path)).collect()}
    assert got == {("map_row_type", "maps[1]"), ("map_id_missing", "maps[2]"), ("duplicate_map_id", "x"), ("maps_type", "b"), ("maps_yaml_parse", "")}
    locations = tmp_path / "loc"
    locations.mkdir()
    (locations / "p.yaml").write_text("truth_lat: 1.5\ntruth_lon: '2'\nextra:\n  deep: [1, {a: b}]\nassist_level: >-\n  none\n")
    (locations / "q.yaml").write_text("a: *x\n")
    rows = {r["location_id"]: r for r in readers.catalog_locations(spark, str(locations)).collect()}
    assert (rows["p"]["truth_lat"], rows["p"]["truth_lon"], rows["p"]["assist_level"], rows["p"]["error"]) == (1.5, 2.0, "none", None) and rows["q"]["error"]


def test_maps_are_written_and_read(spark, tmp_path):
    maps = spark.createDataFrame([("b", "Yes", True, False), ("a", "x: y", False, True), ("c", None, None, None)], "map_id string, title string, local_only boolean, ranked_pool boolean")
    writers.maps_yaml(maps, str(tmp_path / "maps"), "v 1")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "maps").glob("part-*")))
    made, error = yaml.parsed(whole)
    assert error is None and json.loads(made)["content_version"] == "v 1"
    (tmp_path / "maps.yaml").write_text(whole)
    assert [tuple(r) for r in readers.catalog_maps(spark, str(tmp_path / "maps.yaml")).orderBy("pos").collect()] == [(0, "a", "x: y", False, True), (1, "b", "Yes", True, False), (2, "c", None, False, False)]
