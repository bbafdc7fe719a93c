"""Scenes' analytics, dates, nested JSON, texts and answers against small expectations and brute force."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from geoloom.functions import boxes, dates, nested
from geoloom.functions import text as T
from geoloom.operators import analytics, pixels, rows, scoring


def one(spark, column, **values):
    """The value of a column expression over one row of values."""
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_pruned_and_capped_json(spark):
    given = {"a": [1] * 300, "x": 1, "_p": 2, "_truncated": True, "deep": {"ids": [1], "s": "y" * 3000, "keep": None}, "engine": {"model_id": "m", "weights": 1}}
    rows_ = spark.createDataFrame([(json.dumps(given),), ("no json",), (None,), (json.dumps({"engine": {"w": 1}}),)], "t string").select(nested.pruned_json("t").alias("p")).collect()
    assert json.loads(rows_[0].p) == {"a": [1] * 200, "_truncated": True, "deep": {"s": "y" * 2000 + "…", "keep": None}, "engine": {"model_id": "m"}}
    assert [r.p for r in rows_[1:]] == [None, None, "{}"]
    capped = spark.createDataFrame([(json.dumps({"sample": [*range(40)], "npz_base64": "zz", "in": {"sample": "q"}}),), (json.dumps(["w" * 1900] * 9),)], "t string").select(nested.capped_json("t").alias("p")).collect()
    assert json.loads(capped[0].p) == {"sample": [*range(16)], "npz_base64": "<redacted>", "in": {"sample": "<redacted>"}}
    note = json.loads(capped[1].p)
    assert note["_truncated"] and len(note["utf8_preview"]) == 12_000


def test_samples_and_balanced_objects(spark):
    text = json.dumps({"b": {"sample": [1, None, "x", 2.5]}, "l": [{"sample": [9]}], "sample": [3]})
    got = spark.createDataFrame([(text,), ("x",)], "t string").select(nested.sample_numbers("t").alias("s")).collect()
    assert [r.s for r in got] == [[1.0, 2.5, 3.0], None]
    t = 'say {"tim_modality_outputs": {"a": "}\\"{"}} end {"b": 1}'
    got = spark.createDataFrame([(t,), ('{"tim_modality_outputs": {',), (None,)], "t string").select(nested.json_object(F.col("t")).alias("o")).collect()
    assert tuple(got[0].o) == ("say ", '{"tim_modality_outputs": {"a": "}\\"{"}}', ' end {"b": 1}') and got[1].o is None and got[2].o is None


def test_bounds_and_coordinates(spark):
    texts = ['{"west": 1, "south": 2.5, "east": 3, "north": 4}', "[1, 2, 3, 4]", "[1, 2, 3]", '{"west": "1", "south": 2, "east": 3, "north": 4}', "7"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(nested.bounds(F.parse_json("t")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(1, 2.5, 3, 4), (1, 2, 3, 4), None, None, None]
    wrap = lambda x: json.dumps({"tim_modality_outputs": {"Coordinates": x}})
    texts = ['{"ai_lat": 1, "ai_lon": 2}', wrap({"lat": 3, "lon": 4}), wrap({"kind": "other", "lat": 3, "lon": 4}), wrap([{"kind": "x"}, {"kind": "coordinates", "latitude": 5, "longitude": 6}]), "{}"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(nested.coordinates(F.parse_json("t")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in got] == [(1, 2), (3, 4), None, (5, 6), None]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-28T23:30:00Z", None), (None, "2023-01-01/2023-02-01T00"), ("bad", "x")], "t string, q string")
    got = [tuple(r.b) for r in df.select(dates.scene_bounds(F.col("t"), F.col("q"), F.lit("2024-06-01").cast("date")).alias("b")).collect()]
    assert got == [("2024-02-28", "2024-02-29"), ("2023-01-01", "2023-02-01"), ("2024-03-03", "2024-06-01")]
    centre = lambda a, b: str(one(spark, dates.scene_centre(F.lit(a), F.lit(b))))
    assert centre("2024-01-01", "2024-01-01") == "2024-01-01 12:00:00" and centre("2024-01-01", "2024-01-04") == "2024-01-02 12:00:00"
    assert one(spark, dates.window_text(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))) == "2024-01-01/2024-02-01"
    slices = dates.scene_slices(F.lit("wildfire"), F.lit("now"), F.lit("old"), {k: F.lit(None).cast("string") for k in ("t0", "t1", "t2")})
    made = dates.slice_parameters(slices, F.create_map(F.lit("cloud"), F.lit("20")), F.create_map(F.lit("t0"), F.create_map(F.lit("cloud"), F.lit("5"))))
    assert one(spark, made) == {"t0": {"cloud": "5", "datetime": "old"}, "t1": {"cloud": "20", "datetime": "now"}}
    scenes = spark.createDataFrame([([("b", "i2", "d2", 3.0), ("a", "i1", None, None), ("c", None, "d", 1.0)],)], "s array<struct<label:string,item_id:string,datetime:string,cloud_pct:double>>")
    assert {k: tuple(v) for k, v in scenes.select(dates.provenance(F.col("s")).alias("p")).first().p.items()} == {"a": ("i1", None, None), "b": ("i2", "d2", 3.0)}


def test_context_of_a_profile(spark):
    df = spark.createDataFrame([("wildfire", {1: 0.6, 7: 0.4}), ("brief_only", {0: 1.0}), ("flood_pulse", {})], "p string, f map<int,double>")
    got = [r.c for r in df.select(analytics.procedural_context(F.col("p"), F.col("f")).alias("c")).collect()]
    lulc = got[0].tim_modality_outputs.LULC
    assert lulc.class_fractions == {"trees": 0.5, "bare_ground": 0.5} and len(lulc.classes.sample) == 32 and got[0].tim_modality_outputs["tok_lulc@224"].sample == lulc.classes.sample and got[0].tim_modality_outputs.Coordinates is None
    burn = got[0].profile_analytics.burn_change
    assert (burn.changed_area_pct, burn.hotspot_count, burn.heat_clusters[0].confidence, burn.sample_count) == (10.0, 1, "high", 32) and got[0].profile_analytics.summary is None
    assert got[1].profile_analytics.summary.largest_deltas == [] and got[2].profile_analytics.water_change.sample_count == 0 and got[2].inputs_meta.s2_stac.eo_cloud_cover == 0.0
    lines = df.where("p = 'wildfire'").select(analytics.summary_lines(F.col("p"), F.col("f"), analytics.share_changes(F.col("f"), pixels.profile_fractions(F.col("f"), F.col("p")))).alias("l")).first().l
    assert lines == ["- Profile: wildfire", "- Largest classes: trees (60.0%), bare_ground (40.0%)", "- Change: bare ground area is predicted to increase from 40.0% to 50.0%.", "- Finding: more bare ground"]
    spec = df.select(analytics.image_spec(F.col("p"), F.lit("s"), F.col("f"), F.col("f"), F.array(F.struct(F.array(F.lit(1.9), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("box"), F.lit("x").alias("label")))).alias("s")).first().s
    assert spec.deltas == [] and tuple(spec.regions_px[0]) == (1, 2, 3, 4, "x")
    assert one(spark, analytics.shares_of_names(F.create_map(F.lit("water"), F.lit(0.5), F.lit("moon"), F.lit(1.0), F.lit("built"), F.lit(0.0)))) == {0: 0.5}


def test_payloads_and_records(spark):
    brief = F.struct(F.lit("all " * 900).alias("executive_summary"), F.array(*[F.lit(f"f{i}") for i in range(7)]).alias("key_findings"), F.lit(None).cast("array<string>").alias("recommended_actions"), F.lit("high").alias("confidence"))
    art = lambda i, cat, mime: F.struct(F.lit(i).alias("artifact_id"), F.lit("").alias("role"), F.lit(cat).alias("category"), F.lit(mime).alias("mime"), F.lit(None).cast("string").alias("url"))
    got = one(spark, analytics.on_device_payload(brief, F.array(*[F.lit(str(i)) for i in range(6)]), F.array(art("a", "vlm_image", "x"), art("b", "other", "image/png"), art("c", "other", "text/plain"))))
    assert [s.title for s in got.sections] == ["Executive summary", "Key findings"] and len(got.sections[0].body) == 2000 and got.sections[1].body.count("\n") == 4
    assert got.overlays == ["0", "1", "2", "3"] and [i.role for i in got.images] == ["a", "b"]
    none = F.lit(None).cast("array<string>")
    empty = F.struct(F.lit(" ").alias("executive_summary"), none.alias("key_findings"), none.alias("recommended_actions"), F.lit(None).cast("string").alias("confidence"))
    assert one(spark, analytics.on_device_payload(empty, F.array().cast("array<string>"), F.array().cast("array<struct<artifact_id:string,role:string,category:string,mime:string,url:string>>"))) is None
    job = spark.createDataFrame([("j", "done", None, "[1]", '[{"a": 1}]', None, 1), ("k", "new", "wildfire", '{"p": 2}', "", 7, None)], "job_id string, status string, analysis_profile string, request_params string, artifact_manifest string, progress_pct int, cancel_requested int")
    r = job.select(analytics.job_record({c: F.col(c) for c in job.columns}).alias("r")).select("r.*").withColumn("request_params", F.to_json("request_params")).withColumn("artifact_manifest", F.to_json("artifact_manifest")).collect()
    assert [tuple(x) for x in r] == [("j", "done", "brief_only", "{}", '[{"a":1}]', 0, True), ("k", "new", "wildfire", '{"p":2}', "[]", 7, False)]
    picked = F.to_json(analytics.picked(F.parse_json(F.lit('{"role": 1, "secret": 2, "mime": "x"}')), ("role", "mime", "width")))
    assert json.loads(one(spark, picked)) == {"role": 1, "mime": "x"}
    pack = one(spark, analytics.judge_pack(target_id=F.lit("t"), score=F.lit(0.5)))
    assert pack.target_id == "t" and pack.scores.primary == 0.5 and pack.scores.composite is None
    listed = one(spark, analytics.listed_artifacts(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(b"xy").alias("content"), F.lit("m").alias("mime")) for r in "ba"])))
    assert [(a.role, a.size) for a in listed] == [("a", 2), ("b", 2)] and listed[0].sha256 == hashlib.sha256(b"xy").hexdigest()
    assert one(spark, analytics.answer_text([("A", F.array(F.lit("x"), F.lit("y"))), ("B", F.array().cast("array<string>"))])) == "A:\nx\ny"
    assert [one(spark, analytics.folder_profile(F.lit(p), F.lit(f))) for p, f in ((None, "MaritimeSet"), ("own", "fire"), ("", "x"))] == ["oceanscout", "own", "profile"]
    assert one(spark, analytics.profile_name(F.lit(" vessel_monitoring "))) == "oceanscout_ship_detection"


CONTRACTS = [
    ('{"boxes": 3}', "boxes_not_list"), ('{"boxes": null}', "missing_boxes_key"), ('{"x": 1}', "missing_boxes_key"), ('{"boxes": []}', None), ('{"boxes": [4]}', "box_0_not_object"), ('{"boxes": [{"bbox": [0, 0, 1]}]}', "box_0_bbox_shape"),
    ('{"boxes": [{"bbox": [0, 0, 1, "q"]}]}', "box_0_bbox_numeric"), ('{"boxes": [{"bbox": [0, 0, 1, "0.5"]}]}', None), ('{"boxes": [{"bbox": [0, 0, 1, 2]}]}', "box_0_bbox_range"), ('{"boxes": [{"bbox": [0, 0, 1, 1]}, {"bbox": [1, 0, 0, 1]}]}', "box_1_bbox_order"),
    ('{"boxes": [{"bbox": [0, 0, 1, 1], "confidence": "high"}]}', "box_0_confidence_type"), ('{"boxes": [{"bbox": [0, 0, 1, 1], "confidence": 2}]}', "box_0_confidence_range"), ('{"boxes": [{"bbox": [0, 0, 1, 1], "confidence": null}]}', None),
]


def test_contract_errors(spark):
    df = spark.createDataFrame([(t,) for t, _ in CONTRACTS], "t string")
    assert [r.e for r in df.select(boxes.contract_error(F.parse_json("t")).alias("e")).collect()] == [e for _, e in CONTRACTS]


def test_faithfulness(spark):
    shares = F.create_map(F.lit("water"), F.lit(30.0), F.lit("trees"), F.lit(10.0))
    cases = [
        ("Water and trees, 30%", True, "wildfire", 0, 0.78), ("Water, 90%", True, "wildfire", 0, 0.58), ("Nothing here", True, "wildfire", 0, 0.35), ("A town by the water", True, "wildfire", 0, 0.58), ("", True, "wildfire", 0, 0.0),
        ("Uncertain view", False, "brief_only", 0, 0.65), ("A view", False, "brief_only", 0, 0.2), ("water and trees x1 = 0.0", True, "wildfire", 0, 0.4), ("- image sequence: water and trees", True, "wildfire", 0, 0.78),
        ("No ships, water and trees", True, "oceanscout_ship_detection", 2, 0.58), ("No ships, water and trees", True, "oceanscout_ship_detection", 0, 0.78), ("No ships but a candidate, water and trees", True, "oceanscout_ship_detection", 2, 0.78),
    ]
    df = spark.createDataFrame(cases, "c string, rich boolean, p string, v int, want double")
    got = df.select("c", "want", scoring.faithfulness_score(F.col("c"), shares, F.col("rich"), profile=F.col("p"), vessels=F.col("v")).alias("s")).collect()
    assert [(r.c, r.s) for r in got] == [(r.c, r.want) for r in got]


def brute_boxes(text):
    def of(obj):
        if isinstance(obj, dict) and isinstance(obj.get("label"), str) and isinstance(obj.get("bbox"), list) and len(obj["bbox"]) == 4:
            try:
                return [(obj["label"], tuple(float(v) for v in obj["bbox"]))]
            except (TypeError, ValueError):
                pass
        return []

    def load(s):
        try:
            return json.loads(s)
        except ValueError:
            return None

    out = [b for m in re.findall(boxes.BOX_FRAGMENT, text) for b in of(load(m))]
    out += [b for m in re.findall(boxes.BOX_LIST, text) if isinstance(load(m), list) for x in load(m) for b in of(x)]
    if not out:
        for m in re.findall(boxes.BOXES_KEY, text):
            found = load("{" + m + "}")
            out += [b for x in (found["boxes"] if found else []) for b in of(x)]
    return out


def test_boxes_in_texts_against_brute_force(spark):
    random.seed(3)
    pieces = ['{"label": "a", "bbox": [1, 2, 3, 4]}', '[{"label": "b", "bbox": [1, 2, 3, 4.5]}, {"label": "c", "bbox": []}]', '{"boxes": [{"label": "d", "bbox": [0, 0, 1, 1]}]}', '"boxes": []', "[1, 2, 3]", '{"label": 3, "bbox": [1, 2, 3, 4]}', '{"label": "e", "bbox": [1, "x", 3, 4]}', "{oops", "text ", '{"bbox": [1, 2, 3, 4], "label": "f"}', '{"boxes": [{"n": {}, "label": "g", "bbox": [0, 1, 2, 3]}]}']
    texts = [" ".join(random.choice(pieces) for _ in range(random.randint(0, 5))) for _ in range(150)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", boxes.parsed_boxes(F.col("t")).alias("b")).collect()
    for r in got:
        assert [(b.label, tuple(b.box)) for b in r.b] == brute_boxes(texts[r.i]), texts[r.i]


def brute_normalised(text, most):
    n, out = 0, text
    for pattern, to in ((T.CENTRED_NEAR, "centered near an unspecified location."), (T.ISO_COUNTRY, ""), (T.VICINITY, "")):
        new = re.sub(pattern, to, out)
        n, out = n + (new != out), new

    def band(m):
        v = float(m[1])
        return "<1%" if v < 1 else "~2%" if v < 3 else f"~{max(5, min(100, int(5 * round(v / 5))))}%"

    out, percents = re.subn(T.PERCENT, band, out)
    cut = len(out) > most
    if cut:
        head = out[: most - 1]
        m = re.search(r"[.!?]\s", head[::-1])
        out = (head[: len(head) - m.start()].rstrip() if m else head.rstrip()) + "\n\n[trimmed]"
    return out, n, percents, int(cut), int(bool(re.search(T.COORDINATE_WORD, out)))


def test_normalised_texts_against_brute_force(spark):
    random.seed(2)
    pieces = ["Water covers 12.5% ", "and 0.4% or 2.9% ", "ISO country: no. ", "Vicinity: a street 5. ", "The scene is centered near 52.44480°, -8.92879°. ", "latitude x ", "End! ", "So? ", "~7% ", "100% ", "1.5.3% "]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 9))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.normalised_text(F.col("t"), 60).alias("r")).collect()
    for r in got:
        assert tuple(r.r) == brute_normalised(texts[r.i], 60), texts[r.i]


def brute_cut(text, most):
    t = text.strip()
    if len(t) <= most:
        return t
    window = t[:most]
    if most < 32:
        return window.rstrip()
    at = max(window.rfind(m) for m in (". ", ".\n", "? ", "! ", "\n\n"))
    space = window.rfind(" ")
    out = t[: (at if at >= most // 3 else space if space > most // 3 else most - 1) + 1].strip()
    return out.rstrip(".,; ") + "…" if len(out) < len(t) else out


def brute_lead(text, most, sentences=4):
    t = re.sub(r"\s+", " ", text).strip()
    if len(t) <= most:
        return t
    fit = ""
    for s in re.split(r"(?<=[.!?])\s+", t)[:sentences]:
        if len(f"{fit} {s}".strip()) > most:
            break
        fit = f"{fit} {s}".strip()
    return fit or brute_cut(t, most)


@pytest.mark.parametrize("most", [20, 40, 120])
def test_cuts_against_brute_force(spark, most):
    random.seed(most)
    texts = ["".join(random.choice(["word ", "A long one. ", "why? ", "so, ", "x" * 30, "\n\n", " ", "end.\n"]) for _ in range(random.randint(0, 25))) for _ in range(150)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.cut_at_boundary(F.col("t"), most).alias("c"), T.leading_sentences(F.col("t"), most).alias("l")).collect()
    for r in got:
        assert (r.c, r.l) == (brute_cut(texts[r.i], most), brute_lead(texts[r.i], most)), texts[r.i]


def brute_prose(text):
    t = (text or "").strip()
    t = re.sub(r"```[^\n`]*\n(.*?)```", lambda m: m[1], t, flags=re.S)
    t = re.sub(r"```(.*?)```", lambda m: m[1], t, flags=re.S)
    t = re.sub(r"^\s*-{3,}\s*$", "", t, flags=re.M)
    t = re.sub(r"\s-{3,}\s", " ", t)
    t = re.sub(r"^#+\s*", "", t, flags=re.M)
    for mark in (r"\*\*", "__"):
        t = re.sub(f"{mark}(.*?){mark}", lambda m: m[1], t, flags=re.S)
    t = re.sub(r"(?<!\*)\*(?!\*)([^*\n]+)\*(?!\*)", lambda m: m[1], t)
    t = re.sub("`([^`]*)`", lambda m: m[1], t)
    t = re.sub(r"^\s*[-*]\s+", "", t, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", t)).strip()


def test_plain_prose_against_brute_force(spark):
    random.seed(7)
    pieces = ["# Title\n", "```py\ncode\n```\n", "---\n", "* **bold** and `x`\n", "- __under__   far\n", "\n", " --- ", "*it* ", "word ", "```a```"]
    texts = [None, *("".join(random.choice(pieces) for _ in range(random.randint(0, 9))) for _ in range(150))]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.plain_prose(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == brute_prose(texts[r.i]), texts[r.i]


def test_turns_as_aggregates(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be"), (1, 1, "user", "hi"), (1, 2, "assistant", "npz_base64 x"), (1, 3, "user", " "), (2, 0, "user", "q" * 50), (3, 0, "user", None)], "conv_id long, turn int, role string, text string")
    assert {r.conv_id: r.drop_reason for r in rows.gated_turns(turns, 40).collect()} == {1: "bloat:npz_base64", 2: "prompt_too_long", 3: None}
    assert {r.conv_id: tuple(r)[1:] for r in rows.last_texts(turns).collect()} == {1: ("be", None, "npz_base64 x"), 2: (None, "q" * 50, None), 3: (None, None, None)}
    assert {r.conv_id: tuple(r)[1:] for r in rows.turn_lengths(turns).collect()} == {1: (3, 12), 2: (50, 0), 3: (0, 0)}


def test_responsiveness(spark):
    got = [one(spark, scoring.responsiveness(F.lit(a), F.lit(b))) for a, b in (("a b c d", "a b c d"), ("a b c d", "x y z"), ("", ""), ("a b c d", "A b  c e"))]
    assert got == [0.0, 1.0, 0.0, 0.666667]


def test_json_of_any_depth(spark):
    deep = ["[" * 200_000, "[" * 200_000 + "]" * 200_000, '{"a":' * 50_000 + "1" + "}" * 50_000]
    df = spark.createDataFrame([(x,) for x in [*deep, '{"a": [1]}']], "t string")
    got = df.select(nested.pruned_json("t").alias("p"), nested.capped_json("t").alias("c"), nested.sample_numbers("t").alias("s"), nested.json_values("t").alias("v")).collect()
    assert got[0].p is None and got[0].c is None and got[0].s is None and got[0].v.values == [] and got[0].v.rest
    assert got[3].p == '{"a": [1]}' == got[3].c and got[3].s == [] and got[3].v.rest is None


def test_bad_ends_of_json_files_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1} [{"a": 2}] {oops')
    (tmp_path / "b.json").write_text('{"a": 3}')
    from geoloom.sources import readers

    assert sorted(r["a"] for r in readers.concatenated_json(spark, str(tmp_path), "struct<a:int>").collect()) == [1, 2, 3]
    assert [r["rest"] for r in readers.unread_json(spark, str(tmp_path)).collect()] == ["{oops"]


def test_heavy_rows_go_to_as_many_tasks_as_shuffles_have(spark):
    """a table of as many partitions as cores stayed in them, so tasks grew with the table."""
    from geoloom.plans import tables

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.range(500, numPartitions=spark.sparkContext.defaultParallelism)
        dealt = tables.spread(df)
        assert dealt.rdd.getNumPartitions() == 23 and dealt.count() == 500
        assert tables.spread(spark.range(500, numPartitions=40)).rdd.getNumPartitions() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_texts_that_are_certainly_too_deep_do_not_go_to_python(spark):
    """each took 2 ms of Python."""
    deep, less = "[" * (nested.DEEPEST + 1), "[" * (nested.DEEPEST - 1)
    assert nested.prune(less) is None and nested.cap(less) is None
    df = spark.createDataFrame([(1, deep), (2, less), (3, "[[1]]"), (4, None)], "k int, t string")
    assert {r.k: r.s for r in df.select("k", nested._readable("t").isNotNull().alias("s")).collect()} == {1: False, 2: True, 3: True, 4: False}
    assert {r.k: (r.p, r.c) for r in df.select("k", nested.pruned_json("t").alias("p"), nested.capped_json("t").alias("c")).collect()} == {1: (None, None), 2: (None, None), 3: ("[[1]]", "[[1]]"), 4: (None, None)}
