"""Tile and pair rows, presets, slim answers and entries: the cases that their queries don't reach."""

import json

from pyspark.sql import functions as F

from geoloom.operators import analytics, rows, scoring

TILE = "stem string, split string, caption string, fractions map<int,double>, regions array<struct<class_id:int,label:string,box:array<int>,area_px:int>>"


def test_tile_rows(spark):
    region = lambda c, name: (c, name, [0, 0, 10, 20], 200)
    tiles = spark.createDataFrame([("a", "train", "c", {0: 0.5, 1: 0.04, 2: 0.05, 6: 0.2, 99: 0.9}, [region(0, "water"), region(6, "built"), region(0, "water")]), ("b", "test", None, None, None), ("c", "val", "", {3: 1.0}, [])], TILE)
    got = {(r["stem"], r["tag"]): r for r in rows.tile_rows(tiles, size=40, prompts={"focus": "On {class_name}!"}).collect()}
    assert set(got) == {("a", t) for t in ("caption", "ground_all", "classfocus_water", "ground_water", "classfocus_built", "ground_built", "classfocus_grass")} | {("b", "caption"), ("c", "caption"), ("c", "classfocus_flooded_vegetation")}
    assert got["b", "caption"]["assistant"] == "" and got["a", "classfocus_built"]["user"] == "On built!" and got["a", "caption"]["image"] == "images/a.png"
    assert json.loads(got["a", "ground_water"]["assistant"]) == [{"label": "water", "bbox": [0.0, 0.0, 0.25, 0.5]}] * 2 and len(json.loads(got["a", "ground_all"]["assistant"])) == 3
    assert "one or two dominant" in got["a", "classfocus_water"]["assistant"]
    few = {r["tag"] for r in rows.tile_rows(tiles.where("stem = 'a'"), size=40, grounding=False, most=1).collect()}
    assert few == {"caption", "classfocus_water"} and rows.tile_rows(tiles.limit(0), size=40).count() == 0


def test_pair_rows(spark):
    pairs = spark.createDataFrame([(1, "train", ["a.png", "b.png"], "c", [("burn", [0, 0, 5, 10], 50, 0.123456), ("x", [1, 1, 2, 2], 1, None)]), (2, "test", ["a.png"], None, None)], "key int, split string, images array<string>, caption string, regions array<struct<label:string,box:array<int>,area_px:int,score:double>>")
    got = {(r["key"], r["tag"]): r["row"] for r in rows.pair_rows(pairs, size=10, system="S").collect()}
    assert set(got) == {(1, "caption"), (1, "grounding"), (2, "caption")}
    said = json.dumps(got[1, "grounding"], default=str)
    assert "burn" in said and "0.1235" in said and "a.png" in said and "b.png" in said and '"S"' in said


def test_presets_and_slim_answers(spark):
    df = spark.createDataFrame([("auto", None, "none", None), (None, True, None, None), ("gone", True, "x", None), ("auto", True, "x", [1.0, 0.0, 0.0]), ("auto", True, "x", [1.0])], "a string, i boolean, s string, w array<double>")
    label = scoring.preset_label(F.col("a"), F.col("i"), F.col("s"), explicit=F.col("w"))
    got = df.select(label.alias("l"), scoring.preset_weights(label, explicit=F.col("w")).alias("w")).collect()
    assert [r["l"] for r in got] == ["image_only", "procedural_analytics", "default", "explicit_cli", "procedural_analytics"] and got[3]["w"]["lexical"] == 1.0 and got[3]["w"]["faithfulness"] == 0.0
    answers = spark.createDataFrame([("[]",), ('{"vlm_artifacts": 3, "tim_payload": {"npz_base64": null}}',), ("null",), (None,)], "j string").select(F.to_json(analytics.worker_response(F.try_parse_json("j"))).alias("j")).collect()
    empty = {"run_manifest": {}, "vlm_artifacts": []}
    assert [json.loads(r["j"]) for r in answers] == [empty, empty | {"tim_payload": {"has_npz": False}}, empty, empty]


def test_entries(spark):
    df = spark.createDataFrame([('{"t": [1, 2.5, -1], "e": [], "m": [1, "x"], "s": "' + "q" * 3000 + '"}',), ('"text"',), (None,)], "j string")
    a, b, c = (r["o"] for r in df.select(analytics.output_entry(F.lit("k"), F.try_parse_json("j"), sample=2).alias("o")).collect())
    t = a["fields"]["t"]
    assert (t["n"], round(t["mean"], 4), round(t["std"], 4), t["min"], t["max"], list(t["sample"]), t["text"]) == (3, 0.8333, 1.4337, -1.0, 2.5, [1.0, 2.5], None)
    assert a["fields"]["m"]["n"] is None and a["fields"]["m"]["text"] == '[1,"x"]' and len(a["fields"]["s"]["text"]) == 2000
    assert b["fields"] is None and b["text"] == '"text"' and c["fields"] is None and c["text"] is None
