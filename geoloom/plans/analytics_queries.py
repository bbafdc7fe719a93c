"""Queries over scenes' analytics: dates, profiles, changes of shares, signals in JSON, briefs and boxes in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import dates as D
from ..functions import raster
from ..operators import analytics as A
from ..operators import pixels as P
from ..operators import scoring as S
from . import pixel_queries as Q
from . import tables as t

_CATEGORIES = ("Glacier front", "marine_reserve", "pine forest edge", "URBAN core", "waterway", "plain", None)
_SOURCES = ("none", "synthetic_oracle", "tim_generated", "procedural_or_tim", "procedural_or_dw", "dynamic_world", "procedural", "other")


def _pick(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at % len(values) + 1).cast("int"))


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    time = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, F.concat(day.cast("string"), F.lit("T12:30:00Z"))).otherwise(day.cast("string"))
    query = F.when(k % 4 == 0, F.concat_ws("/", day.cast("string"), F.date_add(day, F.pmod(k, F.lit(40)).cast("int")).cast("string"))).when(k % 4 == 1, " ")
    return o.select(k.alias("k"), time.alias("time"), query.alias("query"), F.lit("2024-06-01").cast("date").alias("today"))


def scene_windows(spark: SparkSession, d: str) -> DataFrame:
    x = _scenes(spark, d).withColumn("b", D.scene_bounds(F.col("time"), F.col("query"), F.col("today")))
    w = D.date_windows(F.col("b.start"), F.col("b.end"), F.col("query"), F.col("today"))
    return x.select("k", F.posexplode(w).alias("pos", "w")).select("k", F.col("pos").cast("long").alias("pos"), "w.start", "w.end", "w.tag")


def scene_slices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    ids = {label: F.when(k % n == 0, F.concat(F.lit("s"), k.cast("string"))).cast("string") for label, n in (("t0", 5), ("t1", 2), ("t2", 7))}
    s = D.scene_slices(_pick(A.PROFILES, k), F.lit("now"), F.lit("before"), ids)
    return t.table(spark, d, "orders").select(k.alias("k"), F.posexplode(s).alias("pos", "s")).select("k", F.col("pos").cast("long").alias("pos"), "s.label", "s.interval", "s.scene_id")


def target_profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    hint = F.when(k % 5 == 0, F.lit(" Wildfire ")).when(k % 5 == 1, F.lit(" "))
    mode, asked = _pick(("lexical", " Structured", "tim_alignment", "composite", None), k), _pick(("auto", None, "", "Grounding "), k)
    return t.table(spark, d, "part").select("p_partkey", A.target_profile(hint, _pick(_CATEGORIES, k)).alias("profile"), A.pass_metric(F.coalesce(mode, F.lit("")), asked).alias("metric"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    profile = _pick(("land_use_change", "wildfire", "flood_pulse", "oceanscout_ship_detection", "brief_only"), F.col("tile"))
    x = Q._maps(spark, d).select("tile", profile.alias("profile"), "f")
    return x.select("*", P.profile_fractions(F.col("f"), F.col("profile")).alias("g"))


def share_changes(spark: SparkSession, d: str) -> DataFrame:
    x = _changes(spark, d).select("tile", F.explode(A.share_changes(F.col("f"), F.col("g"))).alias("c"))
    return x.select("tile", F.col("c.class_id").cast("long").alias("class_id"), "c.label", F.round("c.delta", 5).alias("delta"), "c.direction")


def profile_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = _changes(spark, d).select("tile", "profile", "f", "g", A.profile_analytics(F.col("profile"), F.col("f"), F.col("g"), P.class_sample(F.col("g"))).alias("a"))
    found_bins = A.change_bins(A.share_changes(F.col("f"), F.col("g")))
    x = x.withColumn("bins", found_bins)
    bins = [F.col(f"bins.{b}").cast("long").alias(b) for b in ("low", "medium", "high")]
    found = F.coalesce(F.col("a.burn_change.hotspot_count"), F.col("a.water_change.inundation_polygon_count"), F.size("a.vessel_candidates"))
    listed = F.coalesce(F.size("a.land_transition.transition_matrix"), F.size("a.summary.largest_deltas"))
    area = F.coalesce(F.col("a.burn_change.changed_area_pct"), F.col("a.water_change.expanded_area_pct"))
    return x.select("tile", "profile", *bins, F.when(F.col("profile").isin("wildfire", "flood_pulse", "oceanscout_ship_detection"), found).cast("long").alias("found"), F.when(F.col("profile").isin("land_use_change", "brief_only"), listed).cast("long").alias("listed"), F.round(area, 2).alias("area"))


def chosen_sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    bit = lambda n: F.floor(k / n) % 2 == 1
    c = A.chosen_source(_pick(_SOURCES, k), generated=bit(8), health=F.when(bit(16), F.lit("good")).when(bit(32), F.lit("degenerate")), scene=bit(64), dynamic_world=bit(128), oracle=bit(8))
    return t.table(spark, d, "customer").select("c_custkey", c.alias("c")).select("c_custkey", "c.kind", "c.label")


def _json(spark: SparkSession, d: str) -> DataFrame:
    """Analytics as JSON texts, of many forms, from customers."""
    k = F.col("c_custkey")
    n = (k % 4).cast("string")
    land = F.concat(F.lit('"land_transition": {"transition_matrix": [{"count": '), n, F.lit('}], "top_transitions": [{"from": "a", "to": "'), _pick(("a", "b"), k), F.lit('", "count": 3}], "class_distribution": [{"label": "water", "fraction": 0.'), (k % 9).cast("string"), F.lit('}, {"label": "built", "fraction": 0}]}'))
    fire = F.concat(F.lit('"burn_change": {"hotspot_count": '), n, F.lit(', "sample_count": 4}'))
    sea = F.concat(F.lit('"vessel_candidates": ['), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('{"score": 0.'), (k % 10).cast("string"), F.lit('}, {"score": null}'))), F.lit('], "detection_score_summary": {"sample_count": '), n, F.lit("}"))
    body = F.element_at(F.array(land, fire, sea, F.lit('"summary": {"largest_deltas": [1]}'), F.lit('"water_change": {}')), (k % 5 + 1).cast("int"))
    outputs = F.concat(F.lit('{"LULC": {"class_fractions": {"trees": 0.'), (k % 7).cast("string"), F.lit('}}, "s": {"sample": [0, '), (k % 2).cast("string"), F.lit("]}}"))
    whole = F.concat(F.lit('{"tim_modality_outputs": '), outputs, F.lit(', "profile_analytics": {'), body, F.lit("}}"))
    return t.table(spark, d, "customer").select(k.alias("k"), _pick(("land_use_change", "wildfire", "oceanscout_ship_detection", "brief_only", "flood_pulse"), k).alias("profile"), F.parse_json(whole).alias("v"))


def signal_strengths(spark: SparkSession, d: str) -> DataFrame:
    a = F.try_variant_get("v", "$.profile_analytics", "variant")
    return _json(spark, d).select("k", A.signal_strength(a).alias("strength"), A.vessel_strength(a).alias("vessels"), A.has_signal(F.try_variant_get("v", "$.tim_modality_outputs", "variant")).alias("signal"), S.body_is_rich(F.col("v"), F.col("profile")).alias("rich"))


def supported_shares(spark: SparkSession, d: str) -> DataFrame:
    return _json(spark, d).select("k", F.explode(S.supported_shares(F.col("v"))).alias("label", "pct")).withColumn("pct", F.round("pct", 6))


def brief_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    artifacts = F.when(k % 3 == 0, F.array(F.lit("observation_coverage"), F.lit("overlay"))).when(k % 3 == 1, F.array(F.lit("overlay"))).otherwise(F.array().cast("array<string>"))
    keys = F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    profile = _pick(A.PROFILES, k)
    return t.table(spark, d, "customer").select("c_custkey", A.brief_confidence(profile, k % 4 != 0, artifacts).alias("confidence"), F.array_join(A.key_findings(profile, keys, artifacts, k % 3), "|").alias("findings"), F.size(A.limitations(profile)).cast("long").alias("n_limits"), F.size(A.recommended_actions(profile)).cast("long").alias("n_actions"))


def guarded_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as briefs: their lines are findings, and a common word stands for one that is too certain."""
    x = t.table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    section = F.array(F.struct(F.lit("").alias("title"), F.array_join("lines", " ").alias("body"), F.when(F.col("doc_id") % 3 == 0, " High").when(F.col("doc_id") % 3 == 1, "sure").alias("confidence")))
    b = A.guarded_brief(F.lit("wildfire"), F.concat(F.lit(" "), F.array_join("lines", "\n")), F.col("lines"), section, F.col("lines"), F.col("lines"), F.when(F.col("doc_id") % 2 == 0, "MODERATE"), [("the", "that")])
    return x.select("doc_id", b.alias("b")).select(
        "doc_id", F.md5("b.executive_summary").alias("summary"), F.array_join("b.key_findings", "\n").alias("findings"), F.col("b.sections")[0]["body"].alias("body"), F.col("b.sections")[0]["confidence"].alias("section_confidence"), "b.confidence",
        F.array_join("b.warnings", "\n").alias("warnings"), F.array_join("b.notices", "\n").alias("notices"),
    )


def _box_texts(spark: SparkSession, d: str) -> DataFrame:
    """Answers with boxes as single objects, in lists, or under a key, whole and broken, among lines of documents. A list or a key whose first bracket that closes is a box's own isn't JSON as it is cut, so only single objects count in these."""
    k = F.col("doc_id")
    box = F.concat(F.lit('{"label": "s'), (k % 5).cast("string"), F.lit('", "bbox": [0.1, 0.'), (k % 7).cast("string"), F.lit(', 0.5, "0.9"]}'))
    json = F.element_at(F.array(box, F.concat(F.lit("["), box, F.lit(", 3]")), F.lit('{"boxes": [{"bbox": [0, 0, 1, 1], "label": "inner {x}"}]}'), F.lit('{"label": 4, "bbox": [1, 2, 3, 4]}'), F.lit('{"label": "a", "bbox": [1, 2, 3]}'), F.lit("[not json at all]")), (k % 6 + 1).cast("int"))
    return t.table(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]{}]", ""), json, F.when(k % 4 == 0, box)).alias("text"))


def boxes_in_texts(spark: SparkSession, d: str) -> DataFrame:
    x = _box_texts(spark, d).select("doc_id", F.posexplode(B.parsed_boxes(F.col("text"))).alias("pos", "b"))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), "b.label", F.array_join(F.transform("b.box", lambda v: F.round(v, 3).cast("string")), ",").alias("box"))


def cropped_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = t.pixels(spark, d).groupBy("tile", "y", "x").agg(F.min("class0").alias("class0"))
    windows = p.select("tile").distinct().select("tile", (F.col("tile") % 50).alias("row_off"), F.lit(10).alias("col_off"), F.lit(30).alias("height"), F.lit(20).alias("width"))
    c = P.cropped(p, windows, "tile", "class0", size=24, fill=99)
    return c.groupBy("tile").agg(F.count("*").alias("n"), F.sum("class0").alias("classes"), F.sum(F.col("class0") * (F.col("y") * 24 + F.col("x"))).alias("placed"))


QUERIES = {f.__name__: f for f in (scene_windows, scene_slices, target_profiles, share_changes, profile_blocks, chosen_sources, signal_strengths, supported_shares, brief_findings, guarded_briefs, boxes_in_texts, cropped_tiles)}

_LIST = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
_AT = lambda values, k: f"{_LIST(values)}[{k} % {len(values)} + 1]"
_DELTAS = f"""(WITH g AS ({Q.SQL['profile_fractions']}), f AS (SELECT tile, class_id, fraction FROM {Q._FR('class0')}), j AS (SELECT tile, class_id, coalesce(g.fraction, 0) - coalesce(f.fraction, 0) AS x FROM f FULL JOIN g USING (tile, class_id))
  SELECT tile, class_id, {Q._NAMES}[class_id + 1] AS label, round_even(x, 6) AS delta FROM j WHERE abs(x) >= 0.005)"""
_HOW = "(SELECT c_custkey, s, g, CASE WHEN h1 THEN 'good' WHEN h2 THEN 'degenerate' END AS health, sc, dw FROM (SELECT c_custkey, " + _AT(_SOURCES, "c_custkey") + " AS s, " + ", ".join(f"c_custkey // {n} % 2 = 1 AS {name}" for n, name in ((8, "g"), (16, "h1"), (32, "h2"), (64, "sc"), (128, "dw"))) + " FROM customer))"
_BODY = "(SELECT c_custkey AS k, c_custkey % 5 AS b, c_custkey % 4 AS n FROM customer)"
_JSON_LIST = r"list_transform(regexp_extract_all(text, '\[[\s\S]{10}[\s\S]*?\]'), lambda s: CASE WHEN json_valid(s) THEN s END)"

SQL = {
    "scene_windows": """WITH s AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders),
      x AS (SELECT k, CASE WHEN k % 4 = 0 THEN d WHEN k % 4 = 1 THEN NULL END AS qa, CASE WHEN k % 4 = 0 THEN d + (k % 40)::INT END AS qb, k % 3 != 0 AS timed, d FROM s),
      b AS (SELECT *, CASE WHEN timed THEN d WHEN qa IS NOT NULL THEN qa ELSE DATE '2024-06-01' - 90 END AS a, CASE WHEN timed THEN d + 1 WHEN qa IS NOT NULL THEN qb ELSE DATE '2024-06-01' END AS e FROM x),
      c AS (SELECT *, CASE WHEN e <= a THEN a::TIMESTAMP + INTERVAL 12 HOUR ELSE a::TIMESTAMP + to_seconds((e - a) * 43200) END AS mid FROM b)
      SELECT k, 0 AS pos, strftime(a, '%Y-%m-%d') AS "start", strftime(e, '%Y-%m-%d') AS "end", 'scene_window' AS tag FROM c
      UNION ALL SELECT k, h.pos, strftime((mid - to_days(h.n))::DATE, '%Y-%m-%d'), strftime((mid + to_days(h.n))::DATE + 1, '%Y-%m-%d'), 'symmetric_' || h.n || 'd' FROM c, (VALUES (1, 7), (2, 14), (3, 30), (4, 60), (5, 120)) h(pos, n)
      UNION ALL SELECT k, 6, strftime(qa, '%Y-%m-%d'), strftime(qb, '%Y-%m-%d'), 'stac_datetime_query_fallback' FROM c WHERE qa IS NOT NULL""",
    "scene_slices": f"""WITH s AS (SELECT o_orderkey AS k, {_AT(A.PROFILES, 'o_orderkey')} AS p, CASE WHEN o_orderkey % 5 = 0 THEN 's' || o_orderkey END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey END AS b, CASE WHEN o_orderkey % 7 = 0 THEN 's' || o_orderkey END AS c FROM orders), w AS (SELECT *, p IN ('land_use_change', 'wildfire', 'flood_pulse') OR coalesce(a, b, c) IS NOT NULL AS two FROM s)
      SELECT k, 0 AS pos, 't0' AS label, 'before' AS interval, a AS scene_id FROM w WHERE two UNION ALL SELECT k, two::INT, 't1', 'now', b FROM w UNION ALL SELECT k, 2, 't2', 'now', c FROM w WHERE c IS NOT NULL""",
    "target_profiles": f"""WITH x AS (SELECT p_partkey, lower(coalesce({_AT(_CATEGORIES, 'p_partkey')}, '')) AS c, lower(trim({_AT(('lexical', ' Structured', 'tim_alignment', 'composite', ''), 'p_partkey')})) AS m, p_partkey % 4 = 3 AS asked FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'wildfire' WHEN contains(c, 'glacier') THEN 'brief_only' WHEN contains(c, 'marine') OR contains(c, 'water') THEN 'oceanscout_ship_detection' WHEN contains(c, 'forest') OR contains(c, 'coastal') OR contains(c, 'urban') THEN 'land_use_change' ELSE 'brief_only' END AS profile,
        CASE WHEN asked THEN 'grounding' WHEN m = 'lexical' THEN 'lexical' WHEN m = 'structured' THEN 'output_contract' WHEN m = 'tim_alignment' THEN 'faithfulness' ELSE 'composite' END AS metric FROM x""",
    "share_changes": f"SELECT tile, class_id, label, round(delta, 5) AS delta, CASE WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM {_DELTAS}",
    "profile_blocks": f"""WITH t AS (SELECT DISTINCT tile FROM {Q._FR('class0')}), w AS (SELECT tile, count(label) AS n, count(*) FILTER (abs(delta) < 0.04) AS low, count(*) FILTER (abs(delta) >= 0.04 AND abs(delta) < 0.12) AS medium, count(*) FILTER (abs(delta) >= 0.12) AS high, greatest(0, coalesce(max(delta) FILTER (label = 'bare_ground'), 0)) AS burnt, greatest(0, coalesce(max(delta) FILTER (label = 'water'), 0)) AS wet FROM t LEFT JOIN {_DELTAS} USING (tile) GROUP BY tile)
      SELECT tile, {_AT(('land_use_change', 'wildfire', 'flood_pulse', 'oceanscout_ship_detection', 'brief_only'), 'tile')} AS profile, low, medium, high, CASE tile % 5 WHEN 1 THEN (burnt >= 0.04)::BIGINT WHEN 2 THEN (wet >= 0.04)::BIGINT WHEN 3 THEN 1 END AS found, CASE tile % 5 WHEN 0 THEN least(n, 8) WHEN 4 THEN least(n, 5) END AS listed, round(CASE tile % 5 WHEN 1 THEN round_even(burnt * 100, 3) WHEN 2 THEN round_even(wet * 100, 3) END, 2) AS area FROM w""",
    "chosen_sources": f"""SELECT c_custkey, CASE WHEN s = 'synthetic_oracle' AND g THEN 'oracle' WHEN s IN ('tim_generated', 'procedural_or_tim', 'procedural_or_dw') AND g AND health = 'good' OR s = 'tim_generated' AND g THEN 'generated' WHEN s IN ('procedural_or_dw', 'dynamic_world') AND dw THEN 'dynamic_world' WHEN s IN ('procedural_or_tim', 'procedural_or_dw', 'dynamic_world', 'procedural') AND sc THEN 'scene' END AS kind,
      CASE s WHEN 'none' THEN 'none' WHEN 'synthetic_oracle' THEN CASE WHEN g THEN 'synthetic_oracle' ELSE 'synthetic_oracle_missing' END WHEN 'procedural' THEN CASE WHEN sc THEN 'procedural' ELSE 'procedural_no_scl_fractions' END WHEN 'dynamic_world' THEN CASE WHEN dw THEN 'dynamic_world' WHEN sc THEN 'dynamic_world_fallback_scl' ELSE 'dynamic_world_no_inputs' END WHEN 'other' THEN 'unknown_source:other'
        ELSE CASE WHEN g AND health = 'good' THEN 'tim_generated' WHEN s = 'tim_generated' THEN 'tim_generated_health=' || coalesce(health, 'unknown') WHEN s = 'procedural_or_tim' THEN CASE WHEN sc THEN 'procedural_fallback_tim_health=' || coalesce(health, 'unknown') ELSE 'procedural_or_tim_no_inputs' END WHEN dw THEN 'procedural_or_dw_dynamic_world' WHEN sc THEN 'procedural_or_dw_scl' ELSE 'procedural_or_dw_no_inputs' END END AS label FROM {_HOW}""",
    "signal_strengths": f"""SELECT k, CASE WHEN b = 0 AND (n > 0 OR k % 2 = 1) THEN 0.72 WHEN b = 1 THEN 0.55 WHEN b = 2 AND k % 3 != 0 THEN 0.65 WHEN b = 2 AND n > 0 THEN 0.35 ELSE 0 END::DOUBLE AS strength, CASE WHEN b = 2 AND k % 3 != 0 THEN ('0.' || (k % 10))::DOUBLE ELSE 0 END AS vessels, k % 7 > 0 OR k % 2 = 1 AS signal,
      CASE b WHEN 0 THEN true WHEN 1 THEN n > 0 WHEN 2 THEN k % 3 != 0 OR n > 0 WHEN 3 THEN true ELSE false END AS rich FROM {_BODY}""",
    "supported_shares": f"SELECT k, 'trees' AS label, (k % 7) * 10.0::DOUBLE AS pct FROM {_BODY} WHERE k % 7 > 0 UNION ALL SELECT k, 'water', (k % 9) * 10.0::DOUBLE FROM {_BODY} WHERE b = 0 AND k % 9 > 0",
    "brief_findings": f"""WITH x AS (SELECT c_custkey AS k, {_AT(A.PROFILES, 'c_custkey')} AS p, {_AT([A.LABELS[p] for p in A.PROFILES], 'c_custkey')} AS l FROM customer)
      SELECT k AS c_custkey, CASE WHEN k % 4 != 0 AND k % 3 < 2 AND NOT (p = 'oceanscout_ship_detection' AND k % 3 != 0) THEN 'moderate' ELSE 'limited' END AS confidence,
        concat_ws('|', 'Profile: ' || l || '.', 'Artifacts available: ' || (2 - k % 3) || '.', CASE WHEN k % 2 = 0 THEN 'TiM summary keys present: a, b.' END, CASE WHEN k % 3 > 0 THEN 'Composed from ' || (k % 3) || ' job(s).' END, CASE WHEN p = 'oceanscout_ship_detection' THEN CASE WHEN k % 3 = 0 THEN 'Observation coverage artifact is available and should be shown before candidate claims.' ELSE 'Observation coverage artifact is missing; maritime conclusions remain screening-only.' END END) AS findings,
        CASE WHEN p = 'brief_only' THEN 1 ELSE 2 END::BIGINT AS n_limits, 2::BIGINT AS n_actions FROM x""",
    "guarded_briefs": r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), y AS (SELECT *, regexp_matches(t, 'the', 'i') AS said, regexp_replace(t, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS whole, regexp_replace(array_to_string(l, ' '), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS line FROM x)
      SELECT doc_id, md5(regexp_replace(whole, 'the', 'that', 'gi')) AS summary, array_to_string([regexp_replace(regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'), 'the', 'that', 'gi') for s in l[1:8]], chr(10)) AS findings, substr(regexp_replace(line, 'the', 'that', 'gi'), 1, 2000) AS body,
        CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'limited' END AS section_confidence, CASE WHEN doc_id % 2 = 0 THEN 'moderate' ELSE 'limited' END AS confidence, array_to_string([substr(s, 1, 300) for s in l[1:8]], chr(10)) AS warnings,
        CASE WHEN said THEN 'A key finding contained unsupported certainty language and was softened.' || chr(10) || 'Certainty language was softened by the PRO brief guard.' || chr(10) || 'Section untitled was softened by the PRO brief guard.' ELSE '' END AS notices FROM y""",
    "boxes_in_texts": r"""WITH d AS (SELECT doc_id AS k, '{"label": "s' || doc_id % 5 || '", "bbox": [0.1, 0.' || doc_id % 7 || ', 0.5, "0.9"]}' AS b FROM documents), x AS (SELECT k, 's' || k % 5 AS l, '0.1,0.' || k % 7 || ',0.5,0.9' AS v, (k % 6 < 2)::INT + (k % 4 = 0)::INT AS n FROM d)
      SELECT k AS doc_id, u AS pos, l AS label, v AS box FROM (SELECT *, unnest(range(n)) AS u FROM x)""",
    "cropped_tiles": f"""WITH g AS (SELECT tile, y, x FROM (SELECT DISTINCT tile FROM {Q._P}), (SELECT unnest(range(24)) AS y), (SELECT unnest(range(24)) AS x)), p AS (SELECT tile, y, x, min(class0) AS class0 FROM {Q._P} GROUP BY 1, 2, 3), v AS (SELECT g.*, CASE WHEN g.y < 30 AND g.x < 20 THEN coalesce(p.class0, 99) ELSE 99 END AS c FROM g LEFT JOIN p ON p.tile = g.tile AND p.y = g.y + g.tile % 50 AND p.x = g.x + 10)
      SELECT tile, count(*) AS n, sum(c)::BIGINT AS classes, sum(c * (y * 24 + x))::BIGINT AS placed FROM v GROUP BY tile""",
}
