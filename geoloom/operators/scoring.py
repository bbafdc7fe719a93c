"""Scores of captions against what is known about their images, as Column expressions.

A score that isn't defined is null; the composite then leaves its weight out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T

# Weights of lexical, grounding, contract and faithfulness scores by what the prompt held.
WEIGHTS = {
    "default": (0.18, 0.42, 0.22, 0.18),
    "image_only": (0.22, 0.50, 0.28, 0.0),
    "procedural_analytics": (0.16, 0.40, 0.22, 0.22),
    "synthetic_oracle": (0.14, 0.36, 0.22, 0.28),
    "tim_generated": (0.16, 0.40, 0.22, 0.22),
    "optical_focus": (0.20, 0.50, 0.30, 0.0),
    "tim_integration": (0.16, 0.40, 0.22, 0.22),
}
# Other names of labels.
LABEL_ALIASES = {
    "water": ["water", "ocean", "sea", "marine", "fjord", "lake", "lago", "inundation", "channel"],
    "vegetation": ["vegetation", "veg", "forest", "trees", "woodland", "grass", "grassland", "crops", "crop", "cropland", "agriculture", "agricultural", "shrub", "shrubland", "scrub", "plant", "plants", "canopy"],
    "bare": ["bare", "soil", "bare_ground", "barren", "sand", "rock", "rocks", "scree"],
    "snow_ice": ["snow", "ice", "glacier", "cryosphere", "snow_ice", "frozen"],
    "built": ["built", "urban", "buildings", "infrastructure", "city", "town", "port", "harbor"],
}
# Words that claim a land-cover class.
CLASS_WORDS = {
    "water": ["water", "lake", "river", "ocean", "sea", "marine", "fjord", "lago", "open water", "channel"],
    "trees": ["trees", "forest", "woodland", "canopy"],
    "grass": ["grass", "grassland", "pasture", "meadow"],
    "flooded_vegetation": ["flooded vegetation", "wetland", "marsh", "inundated vegetation"],
    "crops": ["crop", "crops", "cropland", "farm", "farmland", "agriculture", "agricultural"],
    "shrub_and_scrub": ["shrub", "scrub", "shrubland", "shrub-and-scrub"],
    "built": ["built", "urban", "buildings", "infrastructure", "city", "town", "port", "harbor", "road", "roads"],
    "bare_ground": ["bare", "barren", "rock", "rocks", "scree", "sand", "soil", "bare ground"],
    "snow_and_ice": ["snow", "ice", "glacier", "cryosphere", "frozen", "snow-covered"],
}
# Words that hedge a claim.
HEDGES = ["limitation", "limitations", "confidence", "uncertain", "cannot verify", "not definitive", "approximate", "optical-only", "optical only", "pseudo-sar", "pseudo sar", "corroborat"]
# Traces of the prompt in an answer, as the answer's form is judged.
LEAKS = {
    "captions_marker": r"(?i)\[captions?\s*:",
    "boxes_marker": r"(?i)\[boxes\]",
    "xy_eq_zero_literal": r"(?i)\bx1\s*=\s*0\.0\s*,\s*y1\s*=\s*0\.0",
    "tim_style_analytics_label": r"(?i)tim[-\s]style\s+analytics\s+json\s*:?",
    "image_sequence_echo": r"(?im)^\s*-\s*image\s+sequence\s*:",
}
# The same, as its faithfulness is judged.
NARRATION_LEAKS = {
    "captions_marker": r"(?i)\[captions?\s*:",
    "boxes_marker": r"(?i)\[boxes\]",
    "xy_eq_zero": r"(?i)\bx1\s*=\s*0\.0",
    "tim_label_echo": r"(?i)tim[-\s]style\s+analytics\s+json\s*:?",
}
#: What every match of these patterns holds, in lower case.
LEAK_PARTS = {"captions_marker": "[caption", "boxes_marker": "[boxes]", "xy_eq_zero_literal": "x1", "xy_eq_zero": "x1", "tim_style_analytics_label": "analytics", "tim_label_echo": "analytics", "image_sequence_echo": "sequence"}
# The profile whose captions mustn't deny vessels, how they deny them, and words that soften it.
VESSEL_PROFILE = "oceanscout_ship_detection"
VESSEL_DENIALS, VESSEL_SOFTENERS = ("no ship", "no vessels", "no maritime"), ("tim", "model", "candidate")
NUMERIC_CLAIM = r"(?i)(\d+(?:\.\d+)?)\s*(%|percent|km2|km²|km|ha|m2|m²|°c|deg)"
FENCE = r"(?i)```(?:json)?\s*\n?([\s\S]*?)```"
#: Percentage points by which a claim may miss.
TOLERANCE = 15.0


def canonical_label(label: Column) -> Column:
    """The label that a name stands for: an exact one, an alias, or (in the fixed order) the first that has an alias of three letters or more in the name."""
    low = F.lower(F.trim(label))
    out = F.when(low.isin(*LABEL_ALIASES), low)
    for name, aliases in LABEL_ALIASES.items():
        longer = [a for a in aliases if len(a) >= 3]
        inside = F.lit(False)
        for a in longer:
            inside = inside | low.contains(a)
        out = out.when((low != "") & (low.isin(aliases) | inside), F.lit(name))
    return out


def class_claims(caption: Column) -> Column:
    """The land-cover classes that a caption mentions."""
    def found(low: Column) -> Column:
        names = []
        for name, words in CLASS_WORDS.items():
            said = F.lit(False)
            for w in words:
                said = said | low.contains(w)
            names.append(F.when(said, F.lit(name)))
        return F.array_compact(F.array(*names))

    return F.transform(F.array(F.lower(F.coalesce(caption, F.lit("")))), found)[0]


def hedged(caption: Column) -> Column:
    low = F.lower(F.coalesce(caption, F.lit("")))
    out = F.lit(False)
    for h in HEDGES:
        out = out | low.contains(h)
    return out


def leaks(caption: Column, patterns: dict[str, str] = LEAKS) -> Column:
    """Names of the traces of the prompt in a caption. A pattern is searched only where the text holds what each of its matches does."""
    whole = F.coalesce(caption, F.lit(""))
    found = lambda x: F.array_compact(F.array(*[F.when(x["low"].contains(LEAK_PARTS[name]) & x["t"].rlike(p), F.lit(name)) for name, p in patterns.items()]))
    return T.let(F.struct(whole.alias("t"), F.lower(whole).alias("low")), found)


def percent_claims(caption: Column) -> Column:
    """Numbers that a caption gives in percent."""
    t = F.coalesce(caption, F.lit(""))
    numbers, units = F.regexp_extract_all(t, F.lit(NUMERIC_CLAIM), F.lit(1)), F.regexp_extract_all(t, F.lit(NUMERIC_CLAIM), F.lit(2))
    return F.transform(F.filter(F.arrays_zip(numbers.alias("v"), units.alias("u")), lambda c: F.lower(c["u"]).isin("%", "percent")), lambda c: c["v"].cast("double"))


def lexical_score(caption: Column, groups: list[list[str]], forbidden: list[str], risky: list[str], least_words: int) -> Column:
    """struct(score, groups_hit, forbidden, risky, words): three quarters for expected ideas, the rest for length and care, less a quarter for each forbidden term."""
    low = F.lower(F.coalesce(caption, F.lit("")))
    hit = F.lit(0)
    for g in groups:
        hit = hit + (F.size(T.matched_terms(low, g)) > 0).cast("int")
    bad, claims, words = F.size(T.matched_terms(low, forbidden)), F.size(T.matched_terms(low, risky)), T.word_count(caption)
    score = hit / max(1, len(groups)) * 0.75 + F.least(F.lit(1.0), words / float(least_words)) * 0.15 + F.greatest(F.lit(0.0), 1.0 - claims * 0.25) * 0.10 - bad * 0.25
    return F.struct(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), hit.alias("groups_hit"), bad.alias("forbidden"), claims.alias("risky"), words.alias("words"))


def last_fence(caption: Column) -> Column:
    """struct(block, head): what the last fence of a caption holds (null without any), and the text before it (else all of it)."""
    def found(x: Column) -> Column:
        t, fence = x["t"], x["fence"]
        after = F.instr(F.reverse(t), F.reverse(fence)) - 1 + F.length(fence)
        block = F.regexp_replace(F.regexp_extract(fence, FENCE, 1), r"^\s+|\s+$", "")
        return F.struct(F.when(fence.isNotNull(), block).alias("block"), F.when(fence.isNotNull(), F.substring(t, F.lit(1), F.length(t) - after)).otherwise(t).alias("head"))

    t = F.coalesce(caption, F.lit(""))
    # The search is left out where no fence can be.
    fence = F.when(t.contains("```"), F.try_element_at(F.regexp_extract_all(t, F.lit(FENCE), F.lit(0)), F.lit(-1)))
    return T.let(F.struct(t.alias("t"), fence.alias("fence")), found)


def fenced_json(caption: Column) -> Column:
    """What the last fence of a caption holds, or null."""
    return last_fence(caption)["block"]


def preamble_words(caption: Column) -> Column:
    """Words before the last fence, or of all of a caption without any."""
    return T.word_count(last_fence(caption)["head"])


def contract_score(caption: Column, least_words: int = 12) -> Column:
    """struct(score, verdict, error): how well an answer keeps to its form, a text and then one fenced {"boxes": [...]}.

    leak 0, no fence 0, not a JSON object 0.4, wrong boxes 0.6, too short a text 0.8, else 1. error names the first wrong box.
    """
    def judged(x: Column) -> Column:
        verdict = (
            F.when(x["leaked"], "leak")
            .when(x["f"]["block"].isNull(), "no_fenced_block")
            .when(x["json"].isNull(), "json_parse_failed")
            .when(x["error"].isNotNull(), "schema_invalid")
            .when(T.word_count(x["f"]["head"]) < least_words, "preamble_too_short")
            .otherwise("ok")
        )
        return F.struct(verdict.alias("verdict"), x["error"].alias("error"))

    def scored(x: Column) -> Column:
        v = x["verdict"]
        points = F.when(v.isin("leak", "no_fenced_block"), 0.0).when(v == "json_parse_failed", 0.4).when(v == "schema_invalid", 0.6).when(v == "preamble_too_short", 0.8).otherwise(1.0)
        return F.struct(points.alias("score"), v.alias("verdict"), x["error"].alias("error"))

    # Each lambda's argument is computed once, however often its body names it.
    fence = T.let(last_fence(caption), lambda f: F.struct(f.alias("f"), F.when(f["block"].startswith("{"), F.try_parse_json(f["block"])).alias("json")))
    parts = T.let(fence, lambda x: F.struct(x["f"].alias("f"), x["json"].alias("json"), F.when(x["json"].isNotNull(), B.contract_error(x["json"])).alias("error"), (F.size(leaks(caption)) > 0).alias("leaked")))
    return T.let(T.let(parts, judged), scored)


def faithfulness_score(caption: Column, shares: Column, rich: Column, *, profile: Column | None = None, vessels: Column | None = None) -> Column:
    """How well a caption keeps to the analytics it was given, or null without any.

    shares: map of class name to percent. rich: whether the analytics say anything; if not, hedging is asked for. vessels: how many vessel
    candidates there are; under the profile that looks for them a caption loses 0.20 for denying them outright.
    """
    def scored(x: Column) -> Column:
        known = F.map_keys(shares)
        supported, invented = F.size(F.array_intersect(x["claims"], known)), F.size(F.array_except(x["claims"], known))
        told = F.when(supported >= 2, 0.28).when(supported == 1, 0.18).otherwise(-0.15) - F.least(F.lit(2), invented) * 0.1
        misses = F.size(F.filter(x["said"], lambda v: F.array_min(F.transform(F.map_values(shares), lambda s: F.abs(s - v))) > TOLERANCE))
        wide = F.when(F.size(shares) > 0, F.least(F.lit(0.20), misses * 0.10)).otherwise(0.0)
        score = F.when(rich, told).otherwise(F.when(x["hedged"], 0.15).otherwise(-0.30)) + 0.5 - wide
        if profile is not None and vessels is not None:
            holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: x["low"].contains(w))
            score = score - F.when((profile == VESSEL_PROFILE) & (vessels > 0) & holds(VESSEL_DENIALS) & ~holds(VESSEL_SOFTENERS), 0.20).otherwise(0.0)
        score = F.when(x["leaked"], F.least(score, F.lit(0.40))).otherwise(score)
        return F.when(F.trim(x["low"]) == "", 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))

    parts = F.struct(class_claims(caption).alias("claims"), percent_claims(caption).alias("said"), (F.size(leaks(caption, NARRATION_LEAKS)) > 0).alias("leaked"), hedged(caption).alias("hedged"), F.lower(F.coalesce(caption, F.lit(""))).alias("low"))
    return F.when(shares.isNotNull(), T.let(parts, scored))


def supported_shares(analytics: Column) -> Column:
    """map of class name to percent that analytics (VARIANT) support: positive shares of the LULC output, then of the listed classes of each block that it lacks."""
    listed = []
    for block in ("land_transition", "summary", "burn_change", "water_change"):
        for key in ("class_distribution", "dominant_tim_classes", "dominant_sentinel_classes"):
            listed.append(F.try_variant_get(analytics, f"$.profile_analytics.{block}.{key}", "array<variant>"))
    groups = [F.coalesce(*[F.when(F.size(x) > 0, x) for x in listed[i : i + 3]], F.array().cast("array<variant>")) for i in range(0, len(listed), 3)]
    label, share = (lambda x: F.try_variant_get(x, "$.label", "string")), (lambda x: F.try_variant_get(x, "$.fraction", "double"))
    rows = F.transform(F.filter(F.concat(*groups), lambda x: label(x).isNotNull() & (share(x) > 0)), lambda x: F.struct(label(x).alias("key"), (share(x) * 100).alias("value")))
    first = F.coalesce(F.map_filter(F.try_variant_get(analytics, "$.tim_modality_outputs.LULC.class_fractions", "map<string,double>"), lambda k, v: v > 0), F.create_map().cast("map<string,double>"))
    own = F.transform(F.map_entries(first), lambda e: F.struct(e["key"].alias("key"), (e["value"] * 100).alias("value")))
    return T.let(F.concat(own, rows), lambda r: F.map_from_entries(F.filter(r, lambda e, i: F.array_position(F.transform(r, lambda y: y["key"]), e["key"]) == i + 1)))


def body_is_rich(analytics: Column, profile: Column, *, samples: bool = True) -> Column:
    """Whether the analytics (VARIANT) say anything under a profile: a changed or second class, something found, candidates, or a summary.

    For fire and flood there must be samples too, as the score of faithfulness has it; without samples it is the rule by which a provider's health is told.
    """
    at = lambda path, kind: F.try_variant_get(analytics, f"$.profile_analytics.{path}", kind)
    size = lambda path: F.coalesce(F.size(at(path, "array<variant>")), F.lit(0))
    some = lambda path: F.coalesce(at(path, "double"), F.lit(0.0)) != 0
    counted = lambda path: some(path) if samples else F.lit(True)
    text = lambda x, key: F.coalesce(F.try_variant_get(x, f"$.{key}", "string"), F.lit("None"))
    changed = F.exists(F.coalesce(at("land_transition.top_transitions", "array<variant>"), F.array().cast("array<variant>")), lambda x: (F.try_variant_get(x, "$.count", "double") > 0) & (text(x, "from") != text(x, "to")))
    return (
        F.when(profile == "land_use_change", F.coalesce(changed, F.lit(False)) | (size("land_transition.class_distribution") >= 2))
        .when(profile == "wildfire", counted("burn_change.sample_count") & (some("burn_change.hotspot_count") | some("burn_change.changed_area_pct")))
        .when(profile == "flood_pulse", counted("water_change.sample_count") & (some("water_change.inundation_polygon_count") | some("water_change.expanded_area_pct")))
        .when(profile == VESSEL_PROFILE, (size("vessel_candidates") > 0) | (F.coalesce(at("detection_score_summary.sample_count", "double"), F.lit(0.0)) > 0))
        .when(profile == "brief_only", (size("summary.dominant_tim_classes") > 0) | (size("summary.largest_deltas") > 0))
        .otherwise(F.lit(False))
    )


def preset_label(asked: Column, injected: Column, source: Column, *, explicit: Column | None = None) -> Column:
    """The preset that a result's weights come from: explicit_cli where weights are given, the one asked for (default, if there is none of that name), or with auto the one of what the prompt held.

    source is the analytics that were found, or asked for; without any, or where nothing was injected, only the image counts.
    """
    want = F.coalesce(F.nullif(F.lower(F.trim(asked)), F.lit("")), F.lit("auto"))
    src = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    by_source = F.when(~F.coalesce(injected, F.lit(False)) | (src == "none"), "image_only").when(src == "synthetic_oracle", "synthetic_oracle").when(src.startswith("tim_generated"), "tim_generated").otherwise("procedural_analytics")
    chosen = F.when(want == "auto", by_source).when(want.isin(*WEIGHTS), want).otherwise("default")
    return chosen if explicit is None else F.when(F.size(explicit) == 3, "explicit_cli").otherwise(chosen)


def preset_weights(label: Column, *, explicit: Column | None = None) -> Column:
    """struct(lexical, grounding, contract, faithfulness) of a preset; of explicit weights (three numbers) these, and none for faithfulness."""
    names = ("lexical", "grounding", "contract", "faithfulness")
    value = lambda w: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, w, strict=True)])
    out = F.when(F.lit(False), value(WEIGHTS["default"]))
    for name, w in WEIGHTS.items():
        out = out.when(label == name, value(w))
    known = out.otherwise(value(WEIGHTS["default"]))
    own = None if explicit is None else F.struct(*[explicit[i].cast("double").alias(n) for i, n in enumerate(names[:3])], F.lit(0.0).alias("faithfulness"))
    return known if own is None else F.when(label == "explicit_cli", own).otherwise(known)


def composite(lexical: Column, grounding: Column, contract: Column, faithfulness: Column, *, plausibility: Column | None = None, forbidden: Column | None = None, risky: Column | None = None, found_boxes: Column | None = None, leaked: Column | None = None, preset: str = "default") -> Column:
    """The weighted mean of the scores that are defined, times a guard for bad claims, under caps.

    An answer without boxes where there are some to find scores 0.42 at most, one that leaks its prompt 0.35.
    """
    w = WEIGHTS[preset]
    ground = grounding if plausibility is None else grounding * F.coalesce(plausibility, F.lit(1.0))
    parts = list(zip((lexical, ground, contract, faithfulness), w, strict=True))
    total = sum((F.when(c.isNotNull(), F.lit(x)).otherwise(0.0) for c, x in parts), F.lit(0.0))
    value = sum((F.coalesce(c * x, F.lit(0.0)) for c, x in parts), F.lit(0.0)) / F.when(total > 1e-9, total).otherwise(1.0)
    guard = F.greatest(F.lit(0.0), 1.0 - (F.lit(0) if forbidden is None else forbidden) * 0.25 - (F.lit(0) if risky is None else risky) * 0.08)
    out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value * guard))
    if found_boxes is not None:
        out = F.when(grounding.isNotNull() & (found_boxes == 0), F.least(out, F.lit(0.42))).otherwise(out)
    if leaked is not None:
        out = F.when(leaked, F.least(out, F.lit(0.35))).otherwise(out)
    return F.bround(out, 4)


def iou_matches(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, gold_id, best): for each true box the best overlap with a box found of the same label; 0 without any."""
    g = gold.select(key, "gold_id", "label", F.col("box").alias("__g"))
    pairs = g.join(found.select(key, "label", F.col("box").alias("__f")), [key, "label"], "left")
    return pairs.groupBy(key, "gold_id").agg(F.bround(F.coalesce(F.max(B.iou(F.col("__g"), F.col("__f"))), F.lit(0.0)), 6).alias("best"))


def row_health(drift_km: Column, has_body: Column, strength: Column, far_km: float = 300.0) -> Column:
    """good, borderline, degenerate or missing, by how far decoded coordinates drift and whether there is a signal."""
    return (
        F.when(has_body.isNull() & drift_km.isNull(), "missing")
        .when((drift_km > far_km) | ~F.coalesce(has_body, F.lit(False)), "degenerate")
        .when((drift_km > far_km / 2) | (F.coalesce(strength, F.lit(0.0)) <= 0), "borderline")
        .otherwise("good")
    )


def alignment_score(said: Column, expected: Column, drift_km: Column) -> Column:
    """Share of expected terms that are said, times 0.52 where coordinates drift beyond 300 km; null without expectations."""
    share = F.size(F.array_intersect(said, expected)) / F.size(expected)
    return F.when(F.size(expected) > 0, F.bround(share * F.when(drift_km > 300, 0.52).otherwise(1.0), 4))


def disagreement(claims: Column, true_shares: Column, wrong_shares: Column) -> Column:
    """Share of percent claims that are nearer to a true share than to any wrong one; null without claims."""
    near = lambda v, shares: F.array_min(F.transform(F.map_values(shares), lambda s: F.abs(s - v)))
    return F.when(F.size(claims) > 0, F.bround(F.size(F.filter(claims, lambda v: near(v, true_shares) < near(v, wrong_shares))) / F.size(claims), 4))


def swapped_shares(shares: Column) -> Column:
    """A map with its shares dealt out in reverse rank: the largest class gets the least share."""
    entries = F.array_sort(F.transform(F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("k"))))
    keys, values = F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: -e["o"])
    return F.map_from_arrays(keys, F.reverse(values))


def flipped(samples: Column) -> Column:
    return F.transform(samples, lambda x: -x)


def responsiveness(a: Column, b: Column, width: int = 3) -> Column:
    """1 less the overlap of two texts' word windows: shared distinct windows of width words to all of them; 0 for two texts without words.

    Linear in the texts' lengths; a text of fewer words is one window.
    """
    def windows(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
        own = lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - width)), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)])))
        )
        return T.let(words, own)

    def share(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return T.let(both, lambda n: F.bround(1 - F.coalesce(F.try_divide(n, F.size(x["a"]) + F.size(x["b"]) - n), F.lit(1.0)), 6))

    return T.let(F.struct(windows(a).alias("a"), windows(b).alias("b")), share)
