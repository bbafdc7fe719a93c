"""Queries over shapes of records: nested JSON, contexts of profiles, records and payloads of jobs, errors and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested, raster
from ..functions import text as T
from ..operators import analytics as A
from ..operators import pixels as P
from ..operators import rows as R
from ..operators import sampling
from ..operators import scoring as S
from . import analytics_queries as AQ
from . import pixel_queries as Q
from . import tables as t


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return t.spread(t.table(spark, d, "orders")).select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 7).cast("int").alias("m"))


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def pruned_json(spark: SparkSession, d: str) -> DataFrame:
    """Records with inner keys at every depth, an engine of which little stays, long lists and texts, and some that are no JSON or too deep."""
    k, p, m = F.col("k"), F.col("p"), F.col("m")
    body = _said('{"id": ', k, ', "_hidden": 1, "_truncated": true, "body": {"name": "', p, '", "x": [1], "deep": [{"embeddings": 2, "kept": ', m, '}]}, "engine": {"model_id": "e', m, '", "weights": [9], "version": "', F.col("s"), '"}, "long": "', F.repeat(F.lit("ab"), F.col("m") * 300), '", "list": [', F.array_join(F.sequence(F.lit(0), m * 60), ","), "]}")
    bad = F.when(m == 6, F.repeat(F.lit("["), 200_000)).when(m == 5, F.lit("no json"))
    return _orders(spark, d).select("k", F.md5(nested.pruned_json(F.coalesce(bad, body))).alias("digest"))


def capped_json(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("k"), F.col("m")
    body = _said('{"id": ', k, ', "npz_base64": "', F.repeat(F.lit("z"), 50), '", "in": {"sample": [', F.array_join(F.sequence(F.lit(1), m * 5 + 1), ", "), '], "inline_base64": 3}, "texts": [', F.array_join(F.array_repeat(F.concat(F.lit('"'), F.repeat(F.lit("é "), m * 170), F.lit('"')), m), ", "), "]}")
    return _orders(spark, d).select("k", nested.capped_json(body).alias("j")).select("k", F.length("j").cast("long").alias("size"), F.md5("j").alias("digest"))


def sample_lists(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("k"), F.col("m")
    body = _said('{"a": {"sample": [', k, ', null, "x", ', m, '.5]}, "sample": 3, "b": [{"sample": [1]}], "c": {"d": {"sample": [true, -2]}}}')
    return _orders(spark, d).select("k", F.array_join(F.transform(nested.sample_numbers(body), lambda v: v.cast("string")), ",").alias("numbers"))


def json_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a JSON object between lines of theirs; some lack its end."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[{}\"\\]", "")
    whole = F.concat(text, F.lit(' {"tim_modality_outputs": {"s": "}{\\"", "n": {"v": '), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("}}} "), text)
    x = t.spread(t.table(spark, d, "documents")).select("doc_id", nested.json_object(whole).alias("o"))
    return x.select("doc_id", F.md5("o.before").alias("before"), "o.object", F.length("o.after").cast("long").alias("after"))


def found_coordinates(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("k"), F.col("m")
    at = _said('{"latitude": ', m, '.5, "longitude": -', k % 90, "}")
    listed = _said('[{"kind": "other", "latitude": 1, "longitude": 1}, {"kind": "Coordinates_WGS84", "lat": ', m, ', "lon": 2}]')
    forms = F.array(_said('{"ai_lat": ', m, ', "ai_lon": 7.25, "tim_modality_outputs": {"Coordinates": ', at, "}}"), _said('{"tim_modality_outputs": {"Coordinates": ', at, "}}"), _said('{"tim_modality_outputs": {"coordinates": ', listed, "}}"), _said('{"tim_modality_outputs": {"Coordinates": {"kind": "text", "latitude": 1, "longitude": 2}}}'), _said('{"ai_lat": ', m, "}"))
    c = nested.coordinates(F.try_parse_json(F.element_at(forms, (k % 5 + 1).cast("int"))))
    return _orders(spark, d).select("k", c.alias("c")).select("k", "c.lat", "c.lon")


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    x = AQ._changes(spark, d)
    scene = F.struct(F.concat(F.lit("scene_"), F.col("tile").cast("string")).alias("stac_item_id"), F.lit("2024-01-01").alias("stac_datetime"), F.when(F.col("tile") % 2 == 0, 4.5).alias("eo_cloud_cover"))
    lat = F.when(F.col("tile") % 3 != 0, F.col("tile") / F.lit(2.0))
    return x.select("tile", "profile", A.procedural_context(F.col("profile"), F.col("f"), lat=lat, lon=F.lit(12.0), scene=scene).alias("c"))


def context_scores(spark: SparkSession, d: str) -> DataFrame:
    """The library's own contexts, read by its own scores: as VARIANT they have shares, a signal, a body and coordinates."""
    x = _contexts(spark, d).select("tile", "profile", F.to_variant_object("c").alias("v"), F.to_json(A.prompt_context(F.col("c"))).alias("prompt"), F.col("c.inputs_meta.s2_stac").alias("scene"))
    shares = S.supported_shares(F.col("v"))
    outputs = F.try_variant_get("v", "$.tim_modality_outputs", "variant")
    rich, healthy = (S.body_is_rich(F.col("v"), F.col("profile"), samples=s) for s in (True, False))
    return x.select(
        "tile", F.size(shares).cast("long").alias("n_shares"), A.has_signal(outputs).alias("signal"), rich.alias("rich"), healthy.alias("healthy"), nested.coordinates(F.col("v"))["lat"].alias("lat"), F.col("scene.eo_cloud_cover").alias("cloud"),
        (F.col("prompt").contains("sentinel") | F.col("prompt").contains("provenance")).alias("echoes"),
    )


def analytics_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each profile's blocks, as JSON has them, nulls left out."""
    x = _contexts(spark, d).select("tile", "profile", F.to_variant_object("c.profile_analytics").alias("v"))
    block = F.element_at(F.create_map(*[F.lit(y) for p, b in (("land_use_change", "land_transition"), ("wildfire", "burn_change"), ("flood_pulse", "water_change"), ("oceanscout_ship_detection", "observation_coverage"), ("brief_only", "summary")) for y in (p, b)]), F.col("profile"))
    text = F.from_json(F.to_json("v"), "map<string,string>")
    names = lambda m: F.array_join(F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: v.isNotNull() & (v != "null")))), ",")
    inner = F.from_json(F.try_element_at(text, block), "map<string,string>")
    return x.select("tile", names(text).alias("blocks"), names(inner).alias("fields"), F.try_variant_get("v", "$.scene_provenance.stac_item_id", "string").alias("scene"))


def job_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stored jobs, and what a device is given of their briefs."""
    k, m = F.col("k"), F.col("m")
    row = {
        "job_id": k, "status": F.col("s"), "analysis_profile": F.when(m == 3, F.lit("")).when(m != 4, F.lit("wildfire")), "request_params": F.when(m == 1, F.lit("[1]")).when(m == 2, F.lit("{oops")).otherwise(_said('{"zoom": ', m, "}")),
        "artifact_manifest": F.when(m == 0, F.lit("{}")).otherwise(_said('[{"role": "r', m, '"}, 2]')), "progress_pct": F.when(m != 5, m * 10), "cancel_requested": F.when(m != 6, m % 2),
    }
    job = A.job_record(row)
    art = lambda i, cat, mime: F.struct(_said(f"a{i}_", k).alias("artifact_id"), F.lit("role" if i else "").alias("role"), F.lit(cat).alias("category"), F.lit(mime).alias("mime"), F.lit(None).cast("string").alias("url"))
    brief = F.when(m != 2, F.struct(F.when(m != 3, F.repeat(F.col("p"), m * 100)).alias("executive_summary"), F.array_repeat(F.repeat(F.col("p"), m * 10), m).alias("key_findings"), F.when(m > 4, F.array(F.lit("act"))).alias("recommended_actions"), F.lit("high").alias("confidence")))
    device = A.on_device_payload(brief, F.transform(F.sequence(F.lit(1), m + 1), lambda i: i.cast("string")), F.when(m != 2, F.array(art(0, "vlm_image", "x"), art(1, "other", "image/png"), art(2, "other", "text/plain"))).otherwise(F.array().cast("array<struct<artifact_id:string,role:string,category:string,mime:string,url:string>>")))
    x = _orders(spark, d).select("k", job.alias("j"), device.alias("o"))
    return x.select(
        "k", "j.job_id", "j.analysis_profile", F.to_json("j.request_params").alias("params"), F.to_json("j.artifact_manifest").alias("artifacts"), F.col("j.progress_pct").cast("long").alias("progress"), "j.cancel_requested",
        F.array_join(F.transform("o.sections", lambda s: _said(s["title"], ":", F.length(s["body"]))), "|").alias("sections"), F.size("o.overlays").cast("long").alias("n_overlays"), F.array_join(F.transform("o.images", lambda i: i["role"]), ",").alias("images"),
    )


def judge_packs(spark: SparkSession, d: str) -> DataFrame:
    r = t.results(spark, d)
    pack = A.judge_pack(target_id=F.col("part").cast("string"), model_name=F.col("model"), analysis_profile=F.col("profile"), error=F.col("error"), score=F.col("score"), lexical=F.col("lexical"), grounding=F.col("grounding"), composite=F.col("composite"))
    x = r.select(pack.alias("p")).select("p.target_id", "p.model_name", "p.caption", "p.error", "p.scores.*")
    some = lambda c: F.count(c).alias(f"n_{c}")
    return x.groupBy("model_name").agg(F.count("*").alias("n"), *[some(c) for c in ("caption", "error", "primary", "lexical", "grounding", "faithfulness", "composite")], F.round(F.sum(F.col("primary").cast("decimal(18,4)")).cast("double"), 4).alias("primary_sum"))


def artifact_lists(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    held = F.array(*[F.struct(_said(r, F.col("m")).alias("role"), F.concat(F.col("p"), F.lit(r)).cast("binary").alias("content"), F.lit("text/plain").alias("mime")) for r in "cab"])
    x = o.select("k", F.explode(A.listed_artifacts(held)).alias("a"))
    return x.select("k", "a.role", "a.sha256", F.col("a.size").cast("long").alias("size"))


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as error messages after a code."""
    k = F.col("doc_id")
    code = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 503 ", "got 401: ", "Timed out ", "can't CONNECT ", "1503 ", "")]), (k % 6 + 1).cast("int"))
    text = F.concat(code, F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]", ""))
    return t.table(spark, d, "documents").select("doc_id", T.error_class(text).alias("code"))


def first_names(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", T.usable(F.when(k % 3 == 0, "-99").when(k % 3 == 1, "  "), F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))), F.when(k % 5 != 0, F.col("c_name"))).alias("name"))


def small_json(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    text = F.when(F.col("m") == 0, F.lit("{ not json")).otherwise(_said('{ "b" : [ 1 , ', F.col("k"), ' ],\n "a" : {"z": null, "y": "', F.col("p"), '"} }'))
    return o.select("k", T.minified_json(text).alias("json"))


def masks(spark: SparkSession, d: str) -> DataFrame:
    """Reflectances in one unit, and the colours and roles of scene classes, by tile."""
    p = t.pixels(spark, d)
    largest = p.groupBy("tile").agg(F.max(F.when(F.col("tile") % 2 == 0, F.col("green") * 9000).otherwise(F.col("green"))).alias("top"))
    x = p.join(largest, "tile").select("tile", raster.reflectance(F.when(F.col("tile") % 2 == 0, F.col("green") * 9000).otherwise(F.col("green")), F.col("top")).alias("r"), raster.cloud_colour(F.col("scene_class")).alias("c"), raster.scene_role(F.col("scene_class")).alias("role"))
    return x.groupBy("tile").agg(F.round(F.sum(F.col("r").cast("decimal(20,6)")).cast("double"), 3).alias("sum"), F.sum(F.col("c")[3]).cast("long").alias("opaque"), F.sum(F.col("c")[0]).cast("long").alias("red"), F.count("role").alias("roles"))


def selected_places(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred places of a list in a seeded order: a sampling operator."""
    p = t.places(spark, d)
    allow = t.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return sampling.selected(p, "id", allow=allow, seed="pick", limit=100).select("id", "lat", "lon")


def swapped_maps(spark: SparkSession, d: str) -> DataFrame:
    """Shares dealt out in reverse rank, and samples turned over."""
    x = Q._maps(spark, d).select("tile", P.normalised_fractions(F.col("f")).alias("f"))
    rows = x.select("tile", F.explode(S.swapped_shares(F.col("f"))).alias("class_id", "share"))
    return rows.select("tile", F.col("class_id").cast("long").alias("class_id"), F.round("share", 6).alias("share"))


def tile_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with shares and up to three regions as training rows."""
    o = _orders(spark, d)
    m = F.col("m")
    region = lambda i, at: F.struct(F.lit(i).alias("class_id"), raster.land_cover_name(F.lit(i)).alias("label"), F.array(m, F.lit(at), m + 28, F.lit(at + 56)).alias("box"), F.lit(28 * 56).alias("area_px"))
    regions = F.when(m == 1, F.lit(None)).otherwise(F.slice(F.array(region(0, 0), region(6, 112), region(0, 168)), F.lit(1), m % 4))
    shares = F.map_filter(F.create_map(F.lit(0), m / 20.0, F.lit(6), F.lit(0.3), F.lit(1), F.lit(0.04), F.lit(3), F.lit(0.2)), lambda k, v: (m != 2) | (k == 3))
    tiles = o.select(_said("t", F.col("k")).alias("stem"), T.split_of(_said("t", F.col("k"))).alias("split"), F.when(m != 3, F.col("p")).alias("caption"), F.when(m != 5, shares).alias("fractions"), regions.alias("regions"))
    return R.tile_rows(tiles, size=224).select("stem", "split", "tag", "image", "user", "assistant")


def pair_rows(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    m = F.col("m")
    region = F.struct(F.lit("burn").alias("label"), F.array(F.lit(0), m * 10, F.lit(100), F.lit(224)).alias("box"), F.lit(9).alias("area_px"), F.when(m % 2 == 0, m / 8.0).alias("score"))
    pairs = o.select(F.col("k").alias("key"), F.lit("train").alias("split"), F.array(_said("a", F.col("k"), ".png"), _said("b", F.col("k"), ".png")).alias("images"), F.col("p").alias("caption"), F.when(m > 2, F.array(region)).alias("regions"))
    x = R.pair_rows(pairs, size=224, system="Compare both images.")
    return x.select("key", "tag", F.size(R.image_paths(F.col("row"))).cast("long").alias("n_images"), F.array_join(R.texts_of(F.col("row"), "assistant"), "|").alias("answer"), F.array_join(R.texts_of(F.col("row"), "system"), "|").alias("system"))


def weight_presets(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("k"), F.col("m")
    asked = F.element_at(F.array(*[F.lit(x) for x in ("auto", " AUTO", None, "optical_focus", "nothing", "", "auto")]), m + 1)
    source = F.element_at(F.array(*[F.lit(x) for x in ("none", "synthetic_oracle", "TIM_generated_health=good", "procedural", None)]), (k % 5 + 1).cast("int"))
    own = F.when(k % 11 == 0, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)))
    label = S.preset_label(asked, k % 3 != 0, source, explicit=own)
    return _orders(spark, d).select("k", label.alias("label"), S.preset_weights(label, explicit=own).alias("w")).select("k", "label", "w.*")


def worker_responses(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("k"), F.col("m")
    body = _said(
        '{"materialization_id": "x', k, '", "secret": 1, "run_manifest": ', F.when(m == 0, "3").otherwise(_said('{"vlm_canvas": ', m, ', "bbox_wgs84": [1, 2], "inner": {"a": 1}}')), ', "vlm_artifacts": [{"role": "r", "url": "u", "width": ', m, '}, 7], "analysis_profile": "',
        F.when(m == 1, " ").otherwise(" fire "), '", "tim_payload": ', F.when(m == 2, "null").otherwise(_said('{"branch": "b", "npz_base64": "', F.when(m > 3, "zz").otherwise(""), '", "profile_analytics": {}, "tim_modality_outputs": {"s": ', m, '}}')), ', "confidence": "high"}',
    )
    v = F.try_parse_json(body)
    return _orders(spark, d).select("k", F.to_json(A.worker_response(v)).alias("slim"), F.array_join(F.array_sort(F.map_keys(A.manifest_excerpt(v))), ",").alias("excerpt"), F.array_join(F.map_keys(A.brief_response(v)), ",").alias("brief"))


def output_entries(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a model's outputs: their statistics, and the rest as text."""
    e = t.table(spark, d, "embeddings")
    v = F.to_variant_object(F.struct(F.col("embedding").cast("array<double>").alias("tensor"), F.repeat(F.lit("ab"), 1500).alias("note"), F.col("vec_id").alias("id")))
    x = e.select("vec_id", A.output_entry(F.lit("s2"), v).alias("o"), A.output_entry(F.lit("s3"), F.to_variant_object(F.array("vec_id"))).alias("p"))
    f = F.col("o.fields")
    at = f["tensor"]
    return x.select("vec_id", at["n"].cast("long").alias("n"), *[F.round(at[c], 5).alias(c) for c in ("mean", "std", "min", "max")], F.size(at["sample"]).cast("long").alias("n_sample"), F.length(f["note"]["text"]).cast("long").alias("note"), f["id"]["text"].alias("id"), F.col("p.text").alias("other"))


QUERIES = {f.__name__: f for f in (
    pruned_json, capped_json, sample_lists, json_pieces, found_coordinates, context_scores, analytics_fields, job_payloads, judge_packs, artifact_lists, error_classes, first_names, small_json, masks, selected_places, swapped_maps,
    tile_rows, pair_rows, weight_presets, worker_responses, output_entries,
)}

_O = "(SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, (o_orderkey % 7)::INT AS m FROM orders)"
_FIELDS = {
    0: ("land_transition", "class_distribution,normalized_total_pct,raw_counts_total,source_keys,temporal_comparison_available,top_transitions,transition_matrix"),
    1: ("burn_change", "changed_area_pct,confidence_bins,heat_clusters,hotspot_count,metric_source,sample_count,source_keys,thresholds"),
    2: ("water_change", "affected_area_proxy_pct,confidence_bins,expanded_area_pct,inundation_polygon_count,metric_source,sample_count,source_keys,thresholds"),
    3: ("confidence,detection_score_summary,evidence_level,limitations,notices,observation_coverage,shoreline_policy,vessel_candidates", "cloud_masked_count,no_observation_count,normalization,valid_observation_count"),
    4: ("summary", "dominant_sentinel_classes,dominant_tim_classes,kind,largest_deltas,confidence"),
}
_sorted = lambda *names: ",".join(sorted(n for x in names for n in x.split(",")))
_HEAD = "profile,scene_provenance,schema_version,thresholds"
_BLOCKS = " ".join(f"WHEN {i} THEN '{_sorted(_HEAD, b)}'" for i, (b, _) in _FIELDS.items())
_INNER = " ".join(f"WHEN {i} THEN '{_sorted(f)}'" for i, (_, f) in _FIELDS.items())

# A number rounded half to even, as JSON has it: with a digit after the point at least.
_DEC = lambda x, n=4: f"(CASE WHEN round_even({x}, {n}) = trunc({x}) THEN printf('%d.0', trunc({x})::BIGINT) ELSE rtrim(printf('%.{n}f', round_even({x}, {n})), '0') END)"

SQL = {
    "pruned_json": f"""SELECT k, CASE WHEN m < 5 THEN md5('{{"id": ' || k || ', "_truncated": true, "body": {{"name": "' || p || '", "deep": [{{"kept": ' || m || '}}]}}, "engine": {{"model_id": "e' || m || '", "version": "' || s || '"}}, "long": "' || CASE WHEN m * 600 > 2000 THEN substr(repeat('ab', m * 300), 1, 2000) || '…' ELSE repeat('ab', m * 300) END
      || '", "list": [' || array_to_string(range(0, least(200, m * 60 + 1)), ', ') || ']}}') END AS digest FROM {_O}""",
    "capped_json": f"""WITH x AS (SELECT k, m, '{{"id": ' || k || ', "npz_base64": "<redacted>", "in": {{"sample": [' || array_to_string(range(1, least(16, m * 5 + 1) + 1), ', ') || '], "inline_base64": "<redacted>"}}, "texts": [' || array_to_string(list_transform(range(0, m), lambda i: '"' || CASE WHEN m * 340 > 2000 THEN substr(repeat('é ', m * 170), 1, 2000) || '…' ELSE repeat('é ', m * 170) END || '"'), ', ') || ']}}' AS j FROM {_O}),
      y AS (SELECT k, CASE WHEN length(j) <= 12000 THEN j ELSE '{{"_truncated": true, "utf8_preview": ' || to_json(substr(j, 1, 12000))::VARCHAR || '}}' END AS j FROM x) SELECT k, length(j) AS size, md5(j) AS digest FROM y""",
    "sample_lists": f"SELECT k, k || '.0,' || m || '.5,1.0,-2.0' AS numbers FROM {_O}",
    "json_pieces": r"""WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{}"\\]', '', 'g') AS t, doc_id % 5 != 0 AS whole FROM documents)
      SELECT doc_id, CASE WHEN whole THEN md5(t || ' ') END AS before, CASE WHEN whole THEN '{"tim_modality_outputs": {"s": "}{\"", "n": {"v": ' || (doc_id % 9) || '}}}' END AS object, CASE WHEN whole THEN length(t) + 1 END AS after FROM x""",
    "found_coordinates": f"SELECT k, CASE k % 5 WHEN 0 THEN m WHEN 1 THEN m + 0.5 WHEN 2 THEN m END::DOUBLE AS lat, CASE k % 5 WHEN 0 THEN 7.25 WHEN 1 THEN -(k % 90) WHEN 2 THEN 2 END::DOUBLE AS lon FROM {_O}",
    "context_scores": f"""WITH g AS ({Q.SQL['profile_fractions']}), n AS (SELECT tile, count(*) AS n FROM g WHERE fraction > 0 GROUP BY tile), s AS (SELECT DISTINCT tile FROM {Q._FR('class0')}),
      w AS (SELECT s.tile, n.n, coalesce(max(delta) FILTER (label = 'bare_ground'), 0) > 0 AS burnt, coalesce(max(delta) FILTER (label = 'water'), 0) > 0 AS wet FROM s JOIN n USING (tile) LEFT JOIN {AQ._DELTAS} d ON d.tile = s.tile GROUP BY s.tile, n.n),
      r AS (SELECT *, CASE tile % 5 WHEN 0 THEN n >= 2 WHEN 1 THEN burnt WHEN 2 THEN wet ELSE true END AS rich FROM w)
      SELECT tile, n AS n_shares, true AS signal, rich, rich AS healthy, CASE WHEN tile % 3 != 0 THEN tile / 2.0::DOUBLE END AS lat, CASE WHEN tile % 2 = 0 THEN 4.5 ELSE 0 END::DOUBLE AS cloud, false AS echoes FROM r""",
    "analytics_fields": f"SELECT tile, CASE tile % 5 {_BLOCKS} END AS blocks, CASE tile % 5 {_INNER} END AS fields, 'scene_' || tile AS scene FROM (SELECT DISTINCT tile FROM {Q._FR('class0')})",
    "job_payloads": f"""SELECT k, k::VARCHAR AS job_id, CASE WHEN m IN (3, 4) THEN 'brief_only' ELSE 'wildfire' END AS analysis_profile, CASE WHEN m IN (1, 2) THEN '{{}}' ELSE '{{"zoom":' || m || '}}' END AS params, CASE WHEN m = 0 THEN '[]' ELSE '[{{"role":"r' || m || '"}},2]' END AS artifacts, CASE WHEN m = 5 THEN 0 ELSE m * 10 END::BIGINT AS progress, m % 2 = 1 AND m != 6 AS cancel_requested,
      CASE WHEN m != 2 THEN concat_ws('|', CASE WHEN m NOT IN (0, 3) THEN 'Executive summary:' || least(2000, length(p) * m * 100) END, CASE WHEN m > 0 THEN 'Key findings:' || (least(5, m) * (2 + least(300, length(p) * m * 10)) + least(5, m) - 1) END, CASE WHEN m > 4 THEN 'Recommended actions:5' END) END AS sections,
      CASE WHEN m != 2 THEN least(4, m + 1) END::BIGINT AS n_overlays, CASE WHEN m != 2 THEN 'a0_' || k || ',role' END AS images FROM {_O}""",
    "judge_packs": f"""SELECT model AS model_name, count(*) AS n, 0::BIGINT AS n_caption, count(error) AS n_error, count(score) AS n_primary, count(lexical) AS n_lexical, count(grounding) AS n_grounding, 0::BIGINT AS n_faithfulness, count(composite) AS n_composite, round(sum(score::DECIMAL(18,4))::DOUBLE, 4) AS primary_sum FROM ({t.RESULTS_SQL}) GROUP BY model""",
    "artifact_lists": f"SELECT k, r || m AS role, sha256(p || r) AS sha256, length(p)::BIGINT + 1 AS size FROM {_O}, (SELECT unnest(['a', 'b', 'c']) AS r)",
    "error_classes": r"""WITH x AS (SELECT doc_id, lower(['HTTP 503 ', 'got 401: ', 'Timed out ', 'can''t CONNECT ', '1503 ', ''][doc_id % 6 + 1] || regexp_replace(coalesce(text, ''), '[0-9]', '', 'g')) AS t FROM documents)
      SELECT doc_id, CASE WHEN contains(t, 'timeout') OR contains(t, 'timed out') THEN 'timeout' WHEN contains(t, 'connect') THEN 'connection' WHEN doc_id % 6 = 1 THEN 'auth' WHEN doc_id % 6 = 0 THEN 'upstream' ELSE 'internal' END AS code FROM x""",
    "first_names": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 != 0 THEN c_name END) AS name FROM customer",
    "small_json": f"""SELECT k, CASE WHEN m = 0 THEN '{{ not json' ELSE '{{"a":{{"y":"' || p || '","z":null}},"b":[1,' || k || ']}}' END AS json FROM {_O}""",
    "masks": f"""WITH p AS (SELECT tile, CASE WHEN tile % 2 = 0 THEN green * 9000 ELSE green END AS g, scene_class AS c FROM {Q._P}), x AS (SELECT *, max(g) OVER (PARTITION BY tile) AS top FROM p)
      SELECT tile, round(sum((CASE WHEN top <= 1.5 THEN g * 10000.0::DOUBLE ELSE g END)::DECIMAL(20,6))::DOUBLE, 3) AS sum, sum(CASE WHEN c IN (8, 9) THEN 200 WHEN c IN (3, 7, 10) THEN 140 ELSE 0 END)::BIGINT AS opaque, sum(CASE WHEN c IN (8, 9) THEN 255 WHEN c IN (3, 7, 10) THEN 160 ELSE 0 END)::BIGINT AS red, count(*) FILTER (c IN (4, 5, 6, 11)) AS roles FROM x GROUP BY tile""",
    "selected_places": f"SELECT id, lat, lon FROM ({t.PLACES_SQL}) WHERE id IN (SELECT o_custkey FROM orders) ORDER BY sha256('pick|' || id), id LIMIT 100",
    "swapped_maps": f"""WITH f AS (SELECT tile, class_id, fraction, row_number() OVER (PARTITION BY tile ORDER BY fraction DESC, class_id) AS r, count(*) OVER (PARTITION BY tile) AS c FROM {Q._FR('class0')})
      SELECT a.tile, a.class_id, round(b.fraction, 6) AS share FROM f a JOIN f b ON a.tile = b.tile AND b.r = a.c + 1 - a.r""",
    "tile_rows": f"""WITH o AS (SELECT 't' || k AS stem, CASE WHEN ('0x' || substr(sha256('t' || k), 1, 16))::UBIGINT % 10 <= 7 THEN 'train' WHEN ('0x' || substr(sha256('t' || k), 1, 16))::UBIGINT % 10 = 8 THEN 'validation' ELSE 'test' END AS split, p, m, CASE WHEN m = 1 THEN 0 ELSE m % 4 END AS n FROM {_O}),
      b AS (SELECT stem, i, c, '{{"label":"' || l || '","bbox":[' || {_DEC('m / 224.0::DOUBLE')} || ',' || {_DEC('y / 224.0::DOUBLE')} || ',' || {_DEC('(m + 28) / 224.0::DOUBLE')} || ',' || {_DEC('(y + 56) / 224.0::DOUBLE')} || ']}}' AS j FROM o, (VALUES (1, 0, 'water', 0), (2, 6, 'built', 112), (3, 0, 'water', 168)) r(i, c, l, y) WHERE i <= n),
      a AS (SELECT stem, '[' || string_agg(j, ',' ORDER BY i) || ']' AS j FROM b GROUP BY stem), ac AS (SELECT stem, c, count(*) AS n, '[' || string_agg(j, ',' ORDER BY i) || ']' AS j FROM b GROUP BY stem, c),
      f AS (SELECT stem, split, c, name, v FROM (SELECT stem, split, m, c, name, CASE c WHEN 0 THEN m / 20.0::DOUBLE WHEN 6 THEN 0.3 ELSE 0.2 END AS v FROM o, (VALUES (0, 'water'), (6, 'built'), (3, 'flooded_vegetation')) x(c, name)) WHERE v >= 0.05 AND m != 5 AND (m != 2 OR c = 3)),
      r AS (SELECT stem, split, 'caption' AS tag, 'Describe this satellite image.' AS user_, CASE WHEN m != 3 THEN p ELSE '' END AS assistant FROM o UNION ALL SELECT stem, split, 'ground_all', 'Find land cover regions visible in this satellite imagery and give their boxes as JSON.', j FROM o JOIN a USING (stem)
        UNION ALL SELECT f.stem, split, 'classfocus_' || name, 'Describe ' || name || ' in this satellite image.', 'In this satellite imagery, **' || name || '** accounts for about ' || {_DEC('v * 100', 1)} || '% of valid pixels, showing ' || CASE coalesce(ac.n, 0) WHEN 0 THEN 'spatially mixed appearance in this resolution.' ELSE 'one or two dominant contiguous patches.' END FROM f LEFT JOIN ac ON f.stem = ac.stem AND f.c = ac.c
        UNION ALL SELECT f.stem, split, 'ground_' || name, 'Find ' || replace(name, '_', ' ') || ' and give their boxes as JSON.', ac.j FROM f JOIN ac ON f.stem = ac.stem AND f.c = ac.c)
      SELECT stem, split, tag, 'images/' || stem || '.png' AS image, user_ AS "user", assistant FROM r""",
    "pair_rows": f"""SELECT k AS key, 'caption' AS tag, 2::BIGINT AS n_images, p AS answer, 'Compare both images.' AS system FROM {_O} UNION ALL
      SELECT k, 'grounding', 2, '[{{"label":"burn","bbox":[0.0,' || {_DEC('m * 10 / 224.0::DOUBLE')} || ',0.4464,1.0]' || CASE WHEN m % 2 = 0 THEN ',"score":' || {_DEC('m / 8.0::DOUBLE')} ELSE '' END || '}}]', 'Compare both images.' FROM {_O} WHERE m > 2""",
    "weight_presets": f"""WITH x AS (SELECT *, k % 11 = 0 AS own, CASE WHEN k % 11 = 0 THEN 'explicit_cli' WHEN m = 3 THEN 'optical_focus' WHEN m = 4 THEN 'default' WHEN k % 3 = 0 OR k % 5 = 0 THEN 'image_only' WHEN k % 5 = 1 THEN 'synthetic_oracle' WHEN k % 5 = 2 THEN 'tim_generated' ELSE 'procedural_analytics' END AS label FROM {_O})
      SELECT k, label, w[1]::DOUBLE AS lexical, w[2]::DOUBLE AS grounding, w[3]::DOUBLE AS contract, w[4]::DOUBLE AS faithfulness FROM (SELECT *, CASE label WHEN 'explicit_cli' THEN [0.5, 0.3, 0.2, 0] {" ".join(f"WHEN '{n}' THEN {list(w)}" for n, w in S.WEIGHTS.items())} END AS w FROM x)""",
    "worker_responses": f"""SELECT k, '{{"materialization_id":"x' || k || '","run_manifest":' || CASE WHEN m = 0 THEN '{{}}' ELSE '{{"bbox_wgs84":[1,2],"vlm_canvas":' || m || '}}' END || ',"vlm_artifacts":[{{"role":"r","width":' || m || '}}]' || CASE WHEN m != 1 THEN ',"analysis_profile":"fire"' ELSE '' END
        || CASE WHEN m != 2 THEN ',"tim_payload":{{"branch":"b","has_npz":' || (m > 3) || ',"tim_modality_outputs":{{"s":' || m || '}}}}' ELSE '' END || '}}' AS slim, CASE WHEN m = 0 THEN '' ELSE 'bbox_wgs84,vlm_canvas' END AS excerpt, 'confidence' AS brief FROM {_O}""",
    "output_entries": """WITH v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings) SELECT vec_id, len(e)::BIGINT AS n, round(list_avg(e), 5) AS mean, round(list_stddev_pop(e), 5) AS std, round(list_min(e), 5) AS min, round(list_max(e), 5) AS max, least(16, len(e))::BIGINT AS n_sample, 2000::BIGINT AS note, vec_id::VARCHAR AS id, '[' || vec_id || ']' AS other FROM v""",
}
