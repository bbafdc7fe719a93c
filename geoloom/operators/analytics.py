"""Analytics of scenes by profile: changes of land-cover shares, their reading as burns, floods, transitions or vessels, briefs and payloads.

All of it is projection: a row of shares (map<int,double>) gives a struct, and rows never move. What differs between
profiles are the struct's blocks, of which a row has the one of its profile; the others are null, and JSON leaves those out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import raster
from ..functions import text as T
from . import pixels as P

# The profiles, older names of them, the class that each looks at, and words in a place's category that imply one.
PROFILES = ("brief_only", "land_use_change", "wildfire", "flood_pulse", "oceanscout_ship_detection")
OLD_NAMES = {"vessel_monitoring": "oceanscout_ship_detection"}
LOOKS_AT = {"land_use_change": "built", "wildfire": "bare_ground", "flood_pulse": "water", "oceanscout_ship_detection": "water"}
CATEGORY_WORDS = ((("glacier",), "brief_only"), (("marine", "water"), "oceanscout_ship_detection"), (("forest", "coastal", "urban"), "land_use_change"))
FOLDER_WORDS = ((("fire",), "firewatch"), (("ocean", "maritime"), "oceanscout"), (("land",), "landshift"), (("flood",), "floodpulse"))
# The metric that a score's mode passes by.
PASS_METRICS = {"lexical": "lexical", "grounding": "grounding", "structured": "output_contract", "output_contract": "output_contract", "tim_alignment": "faithfulness", "faithfulness": "faithfulness"}
# The profiles' names in briefs, what limits them, and what they recommend.
LABELS = {"wildfire": "FireWatch", "oceanscout_ship_detection": "OceanScout", "land_use_change": "LandShift", "flood_pulse": "FloodPulse", "brief_only": "Brief Composer"}
_CHANGE_LIMITS = ("Change metrics depend on comparable temporal scenes and cloud conditions.", "Thresholds should be calibrated before external reporting.")
LIMITATIONS = {
    "oceanscout_ship_detection": ("Optical and pseudo-SAR-like evidence cannot establish legal certainty.", "Cloud, sun glint, shoreline ambiguity, and observation cadence may hide vessels."),
    "wildfire": _CHANGE_LIMITS,
    "flood_pulse": _CHANGE_LIMITS,
    "land_use_change": _CHANGE_LIMITS,
}
OTHER_LIMITATIONS = ("Brief output is a synthesis aid, not a field-verified assessment.",)
ACTIONS = {
    "wildfire": ("Review temporal scene comparability, cloud masks, and hotspot overlays before escalation.", "Corroborate burn/change signals with incident, weather, or in-situ reports."),
    "oceanscout_ship_detection": ("Display observation coverage before vessel-candidate summaries.", "Corroborate candidates with AIS, SAR, patrol reports, or other independent maritime sources."),
    "land_use_change": ("Review before/after scene provenance and top transition classes.", "Corroborate large transitions with cadastral, field, or recent high-resolution imagery."),
    "flood_pulse": ("Review pre/post scene quality and water-mask confidence before impact estimates.", "Corroborate affected-area signals with hydrology, gauge, or emergency management data."),
}
OTHER_ACTIONS = ("Review source artifacts and observation coverage before sharing.", "Corroborate high-impact findings with an independent data source.")
# How strong a signal each block of analytics is.
STRENGTHS = {"land_transition": 0.72, "vessel_candidates": 0.65, "water_change": 0.55, "burn_change": 0.55, "detection_score_summary": 0.35}


def _by_words(text: Column, table, otherwise: Column) -> Column:
    """The value of the first entry any of whose words text holds."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.when(F.lit(False), F.lit(""))
    for words, value in table:
        said = F.lit(False)
        for w in words:
            said = said | low.contains(w)
        out = out.when(said, F.lit(value))
    return out.otherwise(otherwise)


def _lookup(key: Column, table: dict, otherwise) -> Column:
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v)
    out = F.when(F.lit(False), lit(next(iter(table.values()))))
    for name, value in table.items():
        out = out.when(key == name, lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else lit(otherwise))


def profile_name(profile: Column) -> Column:
    """A profile's present name."""
    p = F.trim(profile)
    return _lookup(p, OLD_NAMES, p)


def target_profile(hint: Column, category: Column) -> Column:
    """The hinted profile, or the one that a place's category implies."""
    return F.coalesce(F.nullif(F.lower(F.trim(hint)), F.lit("")), _by_words(category, CATEGORY_WORDS, F.lit("brief_only")))


def folder_profile(profile: Column, folder: Column) -> Column:
    """A record's own profile, or the one that its folder's name implies."""
    return F.coalesce(F.nullif(profile, F.lit("")), _by_words(folder, FOLDER_WORDS, F.lit("profile")))


def pass_metric(mode: Column, asked: Column) -> Column:
    """The metric asked for, or with auto or nothing the one of the score's mode."""
    want = F.lower(F.trim(F.coalesce(asked, F.lit("auto"))))
    return F.when(~want.isin("", "auto"), want).otherwise(_lookup(F.lower(F.trim(mode)), PASS_METRICS, "composite"))


def named_shares(fractions: Column) -> Column:
    """A map of class names to shares, by class id."""
    entries = F.array_sort(F.transform(F.map_entries(P.normalised_fractions(fractions)), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("v"))))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(raster.land_cover_name(e["id"]).alias("key"), e["v"].alias("value"))))


def shares_of_names(named: Column) -> Column:
    """A map of class ids to the positive shares of a map of class names; other names are left out."""
    ids = F.create_map(*[x for i, n in enumerate(raster.LAND_COVER) for x in (F.lit(n), F.lit(i))])
    known = F.filter(F.map_entries(named), lambda e: (e["value"] > 0) & F.try_element_at(ids, e["key"]).isNotNull())
    return F.map_from_entries(F.transform(known, lambda e: F.struct(F.try_element_at(ids, e["key"]).alias("key"), e["value"].cast("double").alias("value"))))


def share_changes(before: Column, after: Column, least: float = 0.005) -> Column:
    """array<struct(class_id, label, before, after, delta, direction)> of two maps of shares, the largest changes first and then by id."""
    def changes(x: Column) -> Column:
        of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
        rows = F.transform(F.array(*[F.lit(i) for i in range(len(raster.LAND_COVER))]), lambda k: F.struct(k.alias("class_id"), of(x["b"], k).alias("before"), of(x["a"], k).alias("after")))
        rows = F.transform(F.filter(rows, lambda r: F.abs(r["after"] - r["before"]) >= least), lambda r: F.struct((-F.abs(F.bround(r["after"] - r["before"], 6))).alias("o"), r["class_id"], r["before"], r["after"], F.bround(r["after"] - r["before"], 6).alias("delta")))
        return F.transform(F.array_sort(rows), lambda r: F.struct(r["class_id"], raster.land_cover_name(r["class_id"]).alias("label"), r["before"], r["after"], r["delta"], F.when(r["delta"] > 0, "increase").otherwise("decrease").alias("direction")))

    return T.let(F.struct(P.normalised_fractions(before).alias("b"), P.normalised_fractions(after).alias("a")), changes)


def change_bins(changes: Column) -> Column:
    """struct(low, medium, high): how many changes are of each size."""
    count = lambda keep: F.size(F.filter(changes, lambda r: keep(F.abs(r["delta"]))))
    return F.struct(count(lambda d: d < 0.04).alias("low"), count(lambda d: (d >= 0.04) & (d < 0.12)).alias("medium"), count(lambda d: d >= 0.12).alias("high"))


def _delta_of(changes: Column, label: str) -> Column:
    return F.coalesce(F.get(F.filter(changes, lambda r: r["label"] == label), F.lit(0))["delta"], F.lit(0.0))


# Keys, names and texts of the blocks.
SOURCE_KEYS = ("Coordinates", "LULC", "tok_lulc@224")
METRIC_SOURCE, EVIDENCE = "procedural_fraction_delta", "tim_pseudosar_plus_lulc"
VESSEL_NOTICES = ("Candidate vessel detections are presence indicators and require corroboration.", "Pseudo-SAR-like TiM outputs are not equivalent to true SAR observations.")
VESSEL_LIMITS = ("cloud", "sun_glint", "shoreline_ambiguity", "optical_only_constraints")
SHORELINE = {"version": "1.0", "buffer_m": 500.0, "morphology_kernel_px": 3.0, "min_water_fraction": 0.3}
SCENE = "struct<stac_item_id:string,stac_datetime:string,eo_cloud_cover:double>"


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _constants(**values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def named_changes(changes: Column) -> Column:
    """share_changes() as blocks hold them: class_id, label, sentinel_fraction, tim_fraction, delta and direction."""
    return F.transform(changes, lambda r: F.struct(r["class_id"], r["label"], F.bround(r["before"], 6).alias("sentinel_fraction"), F.bround(r["after"], 6).alias("tim_fraction"), r["delta"], r["direction"]))


def profile_analytics(profile: Column, before: Column, after: Column, samples: Column, scene: Column | None = None) -> Column:
    """What a profile reads from two maps of shares and a sample of classes: a struct of which a profile's own blocks aren't null.

    profile, schema_version, scene_provenance (of SCENE) and thresholds are there for all; then come land_transition, burn_change, water_change, vessel_candidates with
    observation_coverage, detection_score_summary, evidence_level, confidence, notices, limitations and shoreline_policy, or for any other profile summary.
    """
    nothing = F.lit(None)

    def blocks(x: Column) -> Column:
        changes, after_ = x["changes"], x["after"]
        n = F.size(samples)
        is_ = lambda name: profile == name
        bins = change_bins(changes)
        matrix = F.transform(F.slice(changes, 1, 8), lambda r: F.struct(r["label"].alias("from"), r["label"].alias("to"), F.bround(F.abs(r["delta"]) * 1000, 0).cast("int").alias("count"), F.bround(F.abs(r["delta"]) * 100, 3).alias("pct"), r["direction"]))
        burnt, wetter = F.greatest(F.lit(0.0), _delta_of(changes, "bare_ground")), F.greatest(F.lit(0.0), _delta_of(changes, "water"))
        all_ = F.aggregate(changes, F.lit(0.0), lambda s, r: s + F.abs(r["delta"]))
        signal = F.least(F.lit(100.0), F.bround(F.coalesce(F.try_element_at(after_, F.lit(0)), F.lit(0.0)) * 30, 3))
        cluster = _constants(cluster_id="procedural-burn-0000", score=F.bround(F.least(F.lit(1.0), burnt / 0.15), 6), confidence=F.when(burnt >= 0.08, "high").otherwise("medium"), source=METRIC_SOURCE)
        land = _constants(
            transition_matrix=matrix, top_transitions=named_changes(F.slice(changes, 1, 8)), class_distribution=P.dominant_classes(after_), raw_counts_total=n, normalized_total_pct=F.when(n > 0, 100.0).otherwise(0.0),
            temporal_comparison_available=True, source_keys=_texts(SOURCE_KEYS),
        )
        fire = _constants(
            changed_area_pct=F.bround(burnt * 100, 3), hotspot_count=F.when(burnt >= 0.04, 1).otherwise(0), heat_clusters=F.filter(F.array(cluster), lambda c: burnt > 0), confidence_bins=bins, source_keys=_texts(SOURCE_KEYS), sample_count=n,
            metric_source=METRIC_SOURCE, thresholds=_constants(normalized_signal_medium=0.33, normalized_signal_high=0.67, min_cluster_px=nothing.cast("int")),
        )
        flood = _constants(
            expanded_area_pct=F.bround(wetter * 100, 3), affected_area_proxy_pct=F.bround(all_ * 100, 3), inundation_polygon_count=F.when(wetter >= 0.04, 1).otherwise(0), confidence_bins=bins, source_keys=_texts(SOURCE_KEYS), sample_count=n,
            metric_source=METRIC_SOURCE, thresholds=_constants(normalized_water_signal_high=0.67, min_polygon_area_m2=nothing.cast("double")),
        )
        vessel = _constants(candidate_id="procedural-maritime-0000", score=F.bround(signal / 100, 6), confidence="medium", evidence_level=EVIDENCE, claim_safety="presence_indicator_not_legal_assertion")
        coverage = _constants(valid_observation_count=F.when(n > 0, n), cloud_masked_count=0, glint_limited_count=nothing.cast("int"), no_observation_count=F.when(n > 0, 0), normalization="valid_observation_count")
        summary = _constants(kind="brief_context", dominant_sentinel_classes=P.dominant_classes(x["before"]), dominant_tim_classes=P.dominant_classes(after_), largest_deltas=named_changes(F.slice(changes, 1, 5)), confidence="procedural")
        sea = is_("oceanscout_ship_detection")
        return F.struct(
            profile.alias("profile"), F.lit("1.0").alias("schema_version"), (nothing.cast(SCENE) if scene is None else scene).alias("scene_provenance"), _constants(schema_version="1.0").alias("thresholds"),
            F.when(is_("land_use_change"), land).alias("land_transition"), F.when(is_("wildfire"), fire).alias("burn_change"), F.when(is_("flood_pulse"), flood).alias("water_change"),
            F.when(sea, F.array(vessel)).alias("vessel_candidates"), F.when(sea, coverage).alias("observation_coverage"),
            F.when(sea, _constants(sample_count=n, candidate_signal_pct=signal, metric_source=METRIC_SOURCE)).alias("detection_score_summary"), F.when(sea, EVIDENCE).alias("evidence_level"),
            F.when(sea, _constants(method="procedural_fraction_delta_v1", bins=bins)).alias("confidence"), F.when(sea, _texts(VESSEL_NOTICES)).alias("notices"), F.when(sea, _texts(VESSEL_LIMITS)).alias("limitations"),
            F.when(sea, _constants(**SHORELINE)).alias("shoreline_policy"), F.when(~profile.isin(*LOOKS_AT), summary).alias("summary"),
        )

    return T.let(F.struct(P.normalised_fractions(before).alias("before"), P.normalised_fractions(after).alias("after"), share_changes(before, after).alias("changes")), blocks)


def procedural_context(profile: Column, fractions: Column, *, lat: Column | None = None, lon: Column | None = None, scene: Column | None = None) -> Column:
    """struct(tim_modality_outputs, profile_analytics, inputs_meta) of a scene's shares, changed as its profile changes them.

    The outputs are LULC, tok_lulc@224 and, with both of lat and lon, Coordinates; scene is a struct of SCENE. Without shares the outputs are empty lists and maps. As a VARIANT
    (to_variant_object) it is what the scores and signals read.
    """
    number = lambda c: F.lit(None).cast("double") if c is None else c.cast("double")
    place = F.when(number(lat).isNotNull() & number(lon).isNotNull(), _constants(kind="coordinates_wgs84", latitude=number(lat), longitude=number(lon), confidence=0.9))
    given = F.lit(None).cast(SCENE) if scene is None else scene
    known = F.struct(given["stac_item_id"].alias("stac_item_id"), given["stac_datetime"].alias("stac_datetime"), F.coalesce(given["eo_cloud_cover"], F.lit(0.0)).alias("eo_cloud_cover"))
    shape = F.array(F.lit(224), F.lit(224))

    def context(after: Column) -> Column:
        def whole(sample: Column) -> Column:
            outputs = F.struct(
                _constants(internal_key="tok_lulc@224", kind="class_logits", shape=shape, class_fractions=named_shares(after), classes=F.struct(sample.alias("sample"))).alias("LULC"),
                _constants(kind="token_grid", sample=sample, shape=shape).alias("tok_lulc@224"),
                place.alias("Coordinates"),
            )
            return F.struct(outputs.alias("tim_modality_outputs"), profile_analytics(profile, fractions, after, sample, known).alias("profile_analytics"), F.struct(known.alias("s2_stac")).alias("inputs_meta"))

        return T.let(P.class_sample(after), whole)

    some = F.size(P.normalised_fractions(fractions)) > 0
    return T.let(F.when(some, P.profile_fractions(fractions, profile)).otherwise(F.create_map().cast("map<int,double>")), context)


def prompt_context(context: Column) -> Column:
    """A context as it goes into a prompt: without its inputs, where its scene came from, and what repeats the shares before."""
    plain = lambda rows: F.transform(rows, lambda r: r.dropFields("sentinel_fraction"))
    a = context["profile_analytics"]
    land = F.when(a["land_transition"].isNotNull(), a["land_transition"].withField("top_transitions", plain(a["land_transition"]["top_transitions"])))
    summary = F.when(a["summary"].isNotNull(), a["summary"].dropFields("dominant_sentinel_classes").withField("largest_deltas", plain(a["summary"]["largest_deltas"])))
    return F.struct(context["tim_modality_outputs"].alias("tim_modality_outputs"), a.dropFields("scene_provenance").withField("land_transition", land).withField("summary", summary).alias("profile_analytics"))


def percent(share: Column) -> Column:
    return F.when(share.isNotNull(), F.concat(F.bround(share * 100, 1).cast("string"), F.lit("%"))).otherwise("unknown")


def change_sentence(profile: Column, changes: Column) -> Column:
    """The change of the class that a profile looks at, or else the largest, from one share to the other; null without any."""
    wanted = _lookup(profile, LOOKS_AT, F.lit(None).cast("string"))
    row = F.coalesce(F.get(F.filter(changes, lambda r: r["label"] == wanted), F.lit(0)), F.get(changes, F.lit(0)))
    return T.let(row, lambda r: F.concat(F.replace(r["label"], F.lit("_"), F.lit(" ")), F.lit(" area is predicted to "), r["direction"], F.lit(" from "), percent(r["before"]), F.lit(" to "), percent(r["after"]), F.lit(".")))


def summary_lines(profile: Column, fractions: Column, changes: Column) -> Column:
    """The lines of a summary: the profile, the three largest classes, the change, and whether the class that the profile looks at grows."""
    top = F.array_join(F.transform(P.dominant_classes(fractions, 3), lambda e: F.concat(e["label"], F.lit(" ("), percent(e["fraction"]), F.lit(")"))), ", ")
    wanted = _lookup(profile, LOOKS_AT, F.lit(None).cast("string"))
    grows = F.exists(changes, lambda r: (r["label"] == wanted) & (r["delta"] > 0))
    found = F.when(grows, F.concat(F.lit("more "), F.replace(wanted, F.lit("_"), F.lit(" ")))).when(wanted.isNotNull(), F.concat(F.lit("no more "), F.replace(wanted, F.lit("_"), F.lit(" ")))).otherwise("a general brief")
    lines = [F.concat(F.lit("- Profile: "), profile), F.concat(F.lit("- Largest classes: "), F.when(top != "", top).otherwise("not available")), F.concat(F.lit("- Change: "), change_sentence(profile, changes)), F.concat(F.lit("- Finding: "), found)]
    return F.array_compact(F.array(*lines))


def image_spec(profile: Column, stem: Column, before: Column, after: Column, regions: Column) -> Column:
    """What an analysis image is drawn from: named shares before and after, their changes, and boxes in whole pixels."""
    boxes = F.transform(regions, lambda r: F.struct(*[r["box"][i].cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], r["label"].alias("label")))
    return F.struct(profile.alias("profile"), stem.alias("tile_stem"), F.lit(224).alias("size"), named_shares(before).alias("sentinel_class_fractions"), named_shares(after).alias("tim_class_fractions"), share_changes(before, after).alias("deltas"), boxes.alias("regions_px"))


def chosen_source(source: Column, *, generated: Column, health: Column, scene: Column, dynamic_world: Column, oracle: Column) -> Column:
    """struct(kind, label): which analytics a source resolves to (oracle, generated, dynamic_world, scene, or null) and the name under which they are counted.

    generated: whether there is any output, health: its health; scene, dynamic_world and oracle: whether there are shares.
    """
    good, state = generated & F.coalesce(health == "good", F.lit(False)), F.coalesce(F.nullif(health, F.lit("")), F.lit("unknown"))
    is_ = lambda name: source == name
    ladder = [
        (is_("none"), None, F.lit("none")),
        (is_("synthetic_oracle") & oracle, "oracle", F.lit("synthetic_oracle")),
        (is_("synthetic_oracle"), None, F.lit("synthetic_oracle_missing")),
        (source.isin("tim_generated", "procedural_or_tim", "procedural_or_dw") & good, "generated", F.lit("tim_generated")),
        (is_("tim_generated") & generated, "generated", F.concat(F.lit("tim_generated_health="), state)),
        (is_("tim_generated"), None, F.concat(F.lit("tim_generated_health="), state)),
        (is_("procedural_or_tim") & scene, "scene", F.concat(F.lit("procedural_fallback_tim_health="), state)),
        (is_("procedural_or_tim"), None, F.lit("procedural_or_tim_no_inputs")),
        (is_("procedural_or_dw") & dynamic_world, "dynamic_world", F.lit("procedural_or_dw_dynamic_world")),
        (is_("procedural_or_dw") & scene, "scene", F.lit("procedural_or_dw_scl")),
        (is_("procedural_or_dw"), None, F.lit("procedural_or_dw_no_inputs")),
        (is_("dynamic_world") & dynamic_world, "dynamic_world", F.lit("dynamic_world")),
        (is_("dynamic_world") & scene, "scene", F.lit("dynamic_world_fallback_scl")),
        (is_("dynamic_world"), None, F.lit("dynamic_world_no_inputs")),
        (is_("procedural") & scene, "scene", F.lit("procedural")),
        (is_("procedural"), None, F.lit("procedural_no_scl_fractions")),
    ]
    out = None
    for when, kind, label in ladder:
        value = F.struct(F.lit(kind).cast("string").alias("kind"), label.alias("label"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), F.concat(F.lit("unknown_source:"), F.coalesce(source, F.lit(""))).alias("label")))


def has_signal(outputs: Column) -> Column:
    """Whether any output (VARIANT object of objects) has a sample that isn't all zero or a positive share."""
    blocks = F.map_values(F.try_variant_get(outputs, "$", "map<string,variant>"))
    some = lambda v: F.exists(F.try_variant_get(v, "$.sample", "array<variant>"), lambda x: F.abs(F.try_variant_get(x, "$", "double")) > 1e-6)
    share = lambda v: F.exists(F.map_values(F.try_variant_get(v, "$.class_fractions", "map<string,variant>")), lambda x: F.try_variant_get(x, "$", "double") > 0)
    return F.coalesce(F.exists(blocks, lambda v: F.coalesce(some(v), F.lit(False)) | F.coalesce(share(v), F.lit(False))), F.lit(False))


def vessel_strength(analytics: Column) -> Column:
    """The best score of the vessel candidates of analytics (VARIANT), 0 without any."""
    found = F.transform(F.try_variant_get(analytics, "$.vessel_candidates", "array<variant>"), lambda v: F.try_variant_get(v, "$.score", "double"))
    return F.greatest(F.lit(0.0), F.coalesce(F.array_max(found), F.lit(0.0)))


def signal_strength(analytics: Column) -> Column:
    """How much there is in analytics (VARIANT): the strongest of its blocks."""
    listed = lambda path: F.coalesce(F.try_variant_get(analytics, path, "array<variant>"), F.array().cast("array<variant>"))
    count = lambda r: F.coalesce(F.try_variant_get(r, "$.count", "double").cast("int"), F.lit(0)) > 0
    name = lambda r, key: F.coalesce(F.try_variant_get(r, f"$.{key}", "string"), F.lit("None"))
    filled = lambda path: F.coalesce(F.size(F.try_variant_get(analytics, path, "map<string,variant>")) > 0, F.lit(False))
    there = {
        "land_transition": F.exists(listed("$.land_transition.transition_matrix"), count) | F.exists(listed("$.land_transition.top_transitions"), lambda r: count(r) & (name(r, "from") != name(r, "to"))),
        "vessel_candidates": F.size(listed("$.vessel_candidates")) > 0,
        "water_change": filled("$.water_change"),
        "burn_change": filled("$.burn_change"),
        "detection_score_summary": F.coalesce(F.try_variant_get(analytics, "$.detection_score_summary.sample_count", "double").cast("int") > 0, F.lit(False)),
    }
    return F.greatest(*[F.when(cond, STRENGTHS[block]).otherwise(0.0) for block, cond in there.items()])


def limitations(profile: Column) -> Column:
    return _lookup(profile, LIMITATIONS, OTHER_LIMITATIONS)


def recommended_actions(profile: Column) -> Column:
    return _lookup(profile, ACTIONS, OTHER_ACTIONS)


def brief_confidence(profile: Column, has_blob: Column, artifacts: Column) -> Column:
    """moderate with an output's blob and any artifact, but for maritime briefs without their coverage; else limited."""
    blind = (profile == "oceanscout_ship_detection") & ~F.array_contains(artifacts, "observation_coverage")
    return F.when(~F.coalesce(blind, F.lit(False)) & F.coalesce(has_blob, F.lit(False)) & (F.size(artifacts) > 0), "moderate").otherwise("limited")


def key_findings(profile: Column, keys: Column, artifacts: Column, jobs: Column) -> Column:
    """The findings that can be said of any brief: its profile, how many artifacts, which keys, how many jobs, and whether maritime coverage is there."""
    covered = F.array_contains(artifacts, "observation_coverage")
    coverage = F.when(covered, "Observation coverage artifact is available and should be shown before candidate claims.").otherwise("Observation coverage artifact is missing; maritime conclusions remain screening-only.")
    return F.array_compact(F.array(
        F.concat(F.lit("Profile: "), _lookup(profile, LABELS, profile), F.lit(".")),
        F.concat(F.lit("Artifacts available: "), F.size(artifacts).cast("string"), F.lit(".")),
        F.when(F.size(keys) > 0, F.concat(F.lit("TiM summary keys present: "), F.array_join(F.slice(F.array_sort(keys), 1, 8), ", "), F.lit("."))),
        F.when(jobs > 0, F.concat(F.lit("Composed from "), jobs.cast("string"), F.lit(" job(s)."))),
        F.when(profile == "oceanscout_ship_detection", coverage),
    ))


# What a brief's guard says of what it softened, and the confidences that it knows.
SUMMARY_NOTICE, FINDING_NOTICE, SECTION_NOTICE = "Certainty language was softened by the PRO brief guard.", "A key finding contained unsupported certainty language and was softened.", " was softened by the PRO brief guard."
CONFIDENCES = ("limited", "moderate", "high")


def section_confidence(value: Column) -> Column:
    """A known confidence in lower case, else limited."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*CONFIDENCES), low).otherwise("limited")


def guarded_brief(profile: Column, summary: Column, findings: Column, sections: Column, actions: Column, warnings: Column, confidence: Column, certain: list[tuple[str, str]]) -> Column:
    """struct(executive_summary, key_findings, sections, confidence, recommended_actions, limitations, warnings, notices): a brief with certain words softened in its summary, findings and sections.

    There are at most 8 findings, 6 sections, 6 actions and 8 warnings. sections: array<struct(title, body, confidence)>. Texts are trimmed before they are softened; a null one is empty, and null lists are.
    notices says, each once and in order, where something was softened, in what is cut off too.
    """
    listed = lambda c, kind="array<string>": F.coalesce(c, F.array().cast(kind))
    trimmed = lambda x: F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    soft = lambda x: T.replaced(trimmed(x), certain, any_case=True)
    cut = lambda x, most: F.substring(x, 1, most)
    title = lambda s, otherwise: F.coalesce(F.nullif(s["title"], F.lit("")), F.lit(otherwise))
    all_sections = listed(sections, "array<struct<title:string,body:string,confidence:string>>")
    first = F.array(F.when(soft(summary) != trimmed(summary), SUMMARY_NOTICE))
    told = F.transform(listed(findings), lambda f: F.when(soft(f) != trimmed(f), FINDING_NOTICE))
    said = F.transform(all_sections, lambda s: F.when(soft(s["body"]) != trimmed(s["body"]), F.concat(F.lit("Section "), title(s, "untitled"), F.lit(SECTION_NOTICE))))
    kept = F.transform(F.slice(all_sections, 1, 6), lambda s: F.struct(cut(title(s, "Section"), 128).alias("title"), cut(soft(s["body"]), 2000).alias("body"), section_confidence(s["confidence"]).alias("confidence")))
    return F.struct(
        soft(summary).alias("executive_summary"), F.transform(F.slice(listed(findings), 1, 8), soft).alias("key_findings"), kept.alias("sections"), section_confidence(confidence).alias("confidence"),
        F.transform(F.slice(listed(actions), 1, 6), lambda a: cut(a, 300)).alias("recommended_actions"), limitations(profile).alias("limitations"), F.transform(F.slice(listed(warnings), 1, 8), lambda w: cut(w, 300)).alias("warnings"),
        F.array_sort(F.array_distinct(F.array_compact(F.concat(first, told, said)))).alias("notices"),
    )


def on_device_payload(brief: Column, overlays: Column, artifacts: Column) -> Column:
    """struct(sections, overlays, images) for a device, or null if all are empty: five sections, overlays and images up to four.

    brief: struct(executive_summary, key_findings, recommended_actions, confidence); artifacts: array<struct(artifact_id, role, category, mime, url)>.
    """
    def section(title: str, body: Column, confidence: Column) -> Column:
        return F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.struct(F.lit(title).alias("title"), F.substring(body, 1, 2000).alias("body"), confidence.alias("confidence")))

    bullets = lambda items: F.array_join(F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, 5), lambda x: F.concat(F.lit("- "), F.substring(x, 1, 300))), "\n")
    sections = F.array_compact(F.array(
        section("Executive summary", brief["executive_summary"], brief["confidence"]),
        section("Key findings", bullets(brief["key_findings"]), brief["confidence"]),
        section("Recommended actions", bullets(brief["recommended_actions"]), F.lit(None).cast("string")),
    ))
    shown = F.filter(artifacts, lambda a: F.coalesce(a["category"] == "vlm_image", F.lit(False)) | F.coalesce(a["mime"].startswith("image/"), F.lit(False)))
    images = F.slice(F.transform(shown, lambda a: F.struct(F.coalesce(F.nullif(a["role"], F.lit("")), a["artifact_id"]).alias("role"), a["artifact_id"].alias("artifact_id"), a["mime"].alias("mime"), a["url"].alias("url"))), 1, 4)
    whole = T.let(F.struct(sections.alias("sections"), F.slice(overlays, 1, 4).alias("overlays"), images.alias("images")), lambda x: F.when(F.size(x["sections"]) + F.size(x["overlays"]) + F.size(x["images"]) > 0, x))
    return F.when(brief.isNotNull() | (F.size(artifacts) > 0), whole)


def picked(value: Column, keys: tuple[str, ...]) -> Column:
    """A VARIANT object's fields under these keys alone, as a map of VARIANTs; empty if it is no object."""
    have = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.map_filter(have, lambda k, v: k.isin(*keys))


# What is kept of a run's manifest, of a worker's answer and its artifacts, and of a brief.
EXCERPT_KEYS = ("bbox_wgs84", "scene_provenance", "temporal_slices", "mapbox_attribution", "vlm_canvas", "s2_asset_mapping_version")
MANIFEST_KEYS = ("mapbox_center_mode", "mapbox_attribution", "bbox_wgs84", "vlm_canvas", "s2_asset_mapping_version", "scene_provenance", "temporal_slices")
ARTIFACT_KEYS = ("role", "sha256", "mime", "width", "height")
BRIEF_KEYS = ("executive_summary", "key_findings", "confidence", "recommended_actions", "warnings", "limitations")


def manifest_excerpt(answer: Column) -> Column:
    """What a prompt is told of a run: the named fields of the run_manifest of a worker's answer (VARIANT), as a map of VARIANTs; empty without one."""
    return picked(F.try_variant_get(answer, "$.run_manifest", "variant"), EXCERPT_KEYS)


def brief_response(answer: Column) -> Column:
    """The fields of a brief (VARIANT) that are handed on, as a map of VARIANTs."""
    return picked(answer, BRIEF_KEYS)


def worker_response(answer: Column) -> Column:
    """A worker's answer (VARIANT) without what is large or its own: a struct whose JSON has the fields that are there.

    materialization_id, cache_key, run_manifest, vlm_artifacts (of which items that are no objects go), analysis_profile if it isn't blank, and of tim_payload its branch, keys, whether it had a blob,
    and outputs and analytics that aren't empty.
    """
    at = lambda path, kind="variant": F.try_variant_get(answer, f"$.{path}", kind)
    object_ = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    some = lambda v: F.when(object_(v) & (F.size(F.try_variant_get(v, "$", "map<string,variant>")) > 0), v)
    artifacts = F.transform(F.filter(F.coalesce(at("vlm_artifacts", "array<variant>"), F.array().cast("array<variant>")), object_), lambda v: picked(v, ARTIFACT_KEYS))
    blob = F.coalesce(at("tim_payload.npz_base64", "string"), F.lit("")) != ""
    payload = F.struct(at("tim_payload.branch").alias("branch"), at("tim_payload.modalities_keys").alias("modalities_keys"), blob.alias("has_npz"), some(at("tim_payload.tim_modality_outputs")).alias("tim_modality_outputs"), some(at("tim_payload.profile_analytics")).alias("profile_analytics"))
    return F.struct(
        at("materialization_id").alias("materialization_id"), at("cache_key").alias("cache_key"), picked(at("run_manifest"), MANIFEST_KEYS).alias("run_manifest"), artifacts.alias("vlm_artifacts"),
        F.nullif(F.trim(at("analysis_profile", "string")), F.lit("")).alias("analysis_profile"), F.when(object_(at("tim_payload")), payload).alias("tim_payload"),
    )


def output_entry(key: Column, value: Column, *, most: int = 2000, sample: int = 16) -> Column:
    """struct(internal_key, fields, text) of a model's output (VARIANT): of lists of numbers their statistics and first values, of all else its JSON, so many characters at most.

    fields: a map of struct(n, mean, std, min, max, sample, text); an output that is no object has a text alone.
    """
    def stats(v: Column) -> Column:
        numbers = F.schema_of_variant(v).rlike(r"^ARRAY<(BIGINT|DOUBLE|DECIMAL.*)>$")
        values = F.when(numbers, F.try_variant_get(v, "$", "array<double>"))

        def of(x: Column) -> Column:
            n = F.size(x)
            total = lambda y: F.aggregate(y, F.lit(0.0), lambda a, b: a + b)
            mean = F.when(n > 0, total(x) / n)
            spread = T.let(mean, lambda m: F.sqrt(total(F.transform(x, lambda b: (b - m) * (b - m))) / n))
            named = {"n": n, "mean": mean, "std": F.when(n > 0, spread), "min": F.array_min(x), "max": F.array_max(x), "sample": F.slice(x, 1, sample)}
            return F.struct(*[F.when(x.isNotNull(), c).alias(k) for k, c in named.items()], F.when(x.isNull(), F.substring(F.to_json(v), 1, most)).alias("text"))

        return T.let(values, of)

    is_object = F.schema_of_variant(value).startswith("OBJECT")
    fields = F.transform_values(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: stats(v))
    return F.struct(key.alias("internal_key"), F.when(is_object, fields).alias("fields"), F.when(~F.coalesce(is_object, F.lit(False)), F.substring(F.to_json(value), 1, most)).alias("text"))


def answer_text(sections: list[tuple[str, Column]]) -> Column:
    """An answer of titled sections, each with its lines (an array), an empty line between; sections without lines are left out."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(lines, "\n"))) for title, lines in sections])), "\n\n")


def judge_pack(**fields: Column) -> Column:
    """A result as it goes to a judge: its identity, and its scores under one struct. fields: the columns by the names below."""
    of = lambda name: fields.get(name, F.lit(None).cast("string"))
    identity = ("target_id", "model_name", "tim_injected", "analysis_profile", "caption", "error")
    scores = {"primary": "score", "lexical": "lexical", "grounding": "grounding", "output_contract": "structured", "faithfulness": "alignment", "composite": "composite", "ship_plausibility": "plausibility"}
    return F.struct(*[of(n).alias(n) for n in identity], F.struct(*[of(n).alias(k) for k, n in scores.items()]).alias("scores"))


def listed_artifacts(artifacts: Column) -> Column:
    """array<struct(role, sha256, size, mime)> of an array of (role, content binary, mime), by role."""
    return F.array_sort(F.transform(artifacts, lambda a: F.struct(a["role"].alias("role"), F.sha2(a["content"], 256).alias("sha256"), F.octet_length(a["content"]).alias("size"), a["mime"].alias("mime"))))


def job_record(row: dict[str, Column]) -> Column:
    """A stored job with its defaults: profile brief_only, progress 0, not cancelled, and JSON fields as VARIANT where they are of the kind they must be."""
    def parsed(name: str, kind: str) -> Column:
        v = F.try_parse_json(F.coalesce(F.nullif(row[name], F.lit("")), F.lit("{}" if kind == "OBJECT" else "[]")))
        return F.when(F.schema_of_variant(v).startswith(kind), v).otherwise(F.parse_json(F.lit("{}" if kind == "OBJECT" else "[]")))

    return F.struct(
        row["job_id"].cast("string").alias("job_id"), row["status"].alias("status"), F.coalesce(F.nullif(row["analysis_profile"], F.lit("")), F.lit("brief_only")).alias("analysis_profile"),
        parsed("request_params", "OBJECT").alias("request_params"), parsed("artifact_manifest", "ARRAY").alias("artifact_manifest"),
        F.coalesce(row["progress_pct"].cast("int"), F.lit(0)).alias("progress_pct"), F.coalesce(row["cancel_requested"].cast("boolean"), F.lit(False)).alias("cancel_requested"),
    )
