"""Queries over catalogs: lint, hints, manifests, packs, scenes and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import yaml
from ..operators import catalog, dedup, joins
from . import tables as t


def lint_locations(spark: SparkSession, d: str) -> DataFrame:
    x = t.locations(spark, d)
    return catalog.lint_locations(x.unionByName(x.where("k % 50 = 0")))


def lint_references(spark: SparkSession, d: str) -> DataFrame:
    return catalog.lint_references(t.maps(spark, d), t.locations(spark, d).where("map_id is not null"))


def lint_maps(spark: SparkSession, d: str) -> DataFrame:
    m = t.maps(spark, d)
    return catalog.lint_maps(m.withColumn("title", F.when(F.col("ranked_pool"), F.col("title"))))


def yaml_locations(spark: SparkSession, d: str) -> DataFrame:
    """Locations through YAML files' text: nested values, lists, block and flow scalars, and some that can't be read."""
    c = t.table(spark, d, "customer")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    k = F.col("c_custkey").cast("string")
    body = F.concat(
        line("# a location"), line("location_id: ", yaml.quoted(F.col("c_name"))), line("segment: ", yaml.quoted(F.concat(F.col("c_mktsegment"), F.lit(": #"), k))), line("truth:"), line("  lat: ", (F.col("c_custkey") % 80).cast("string"), ".25"),
        line("  ranked: ", F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("off")), line("hints:"), line("- first ", k), line("-  second: {deep: [1, ", k, ", 'x']}"), line("notes: >-"), line("  folded"), line("  ", F.col("c_mktsegment")), line(""), line("  end"),
        F.when(F.col("c_custkey") % 10 == 0, line("bad: &anchor 1")).otherwise(line("last: ~")),
    )
    docs = t.spread(c).select("c_custkey", yaml.document(body).alias("d"))
    of = lambda path, kind="string": F.try_variant_get("d.value", path, kind)
    return docs.select(
        "c_custkey", of("$.location_id").alias("location_id"), of("$.segment").alias("segment"), of("$.truth.lat", "double").alias("lat"), of("$.truth.ranked", "boolean").alias("ranked"), of("$.hints[0]").alias("hint"),
        of("$.hints[1].second.deep[1]", "bigint").alias("deep"), of("$.notes").alias("notes"), F.col("d.error").isNotNull().alias("unread"),
    )


def _hints(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text dealt to six tiers, a sixth of its length each."""
    x = t.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sixth = F.ceil(F.length("text") / 6).cast("int")
    pairs = [(f"tier_{i}", F.when(F.col("doc_id") % (i + 7) != 0, F.substring(F.col("text"), 1 + (i - 1) * sixth, sixth))) for i in range(1, 7)]
    hints = F.map_filter(F.create_map(*[v for k, c in pairs for v in (F.lit(k), c)]), lambda k, v: v.isNotNull())
    return x.select("doc_id", hints.alias("hints"), F.when(F.col("doc_id") % 6 == 0, "none").otherwise("full").alias("assist_level"))


def hint_violations(spark: SparkSession, d: str) -> DataFrame:
    return catalog.hint_violations(_hints(spark, d), "doc_id", banned=["the", "secret"])


def clean_hints(spark: SparkSession, d: str) -> DataFrame:
    h = _hints(spark, d).select("doc_id", catalog.clean_tiers(F.col("hints")).alias("h"))
    return h.select("doc_id", F.size("h").cast("long").alias("n"), F.coalesce(F.try_element_at("h", F.lit("tier_4")), F.lit("-")).alias("tier_4"))


def _sides(spark: SparkSession, d: str):
    x = t.locations(spark, d)
    stills = x.where("k % 41 != 0").select("location_id", F.concat(F.lit("still_"), "k").alias("still_id"), F.lit("satellite").alias("style"))
    tier = F.when(F.col("k") % 6 == 0, "").otherwise("look north")
    hints = x.where("k % 3 != 0").select("location_id", F.create_map(F.lit("tier_1"), tier).alias("hints"), (F.col("k") % 11 != 0).alias("valid"))
    streets = x.where("k % 4 = 0").select("location_id", F.array(F.lit("a"), F.lit("b")).alias("pack"), F.concat(F.lit("near "), "k").alias("narrative"))
    return x, stills, hints, streets


def manifest(spark: SparkSession, d: str) -> DataFrame:
    m = catalog.assembled(*_sides(spark, d))
    return m.select("location_id", "map_id", "still_id", "hint_status", F.try_element_at("useful_hints", F.lit("tier_1")).alias("tier_1"), F.coalesce(F.size("pack"), F.lit(0)).cast("long").alias("n_pack"), "narrative", "problem")


def map_summaries(spark: SparkSession, d: str) -> DataFrame:
    return catalog.map_summaries(t.maps(spark, d).withColumn("title", F.when(F.col("ranked_pool"), F.col("title")))).select("map_id", "title", "content_version")


def ranked_clues(spark: SparkSession, d: str) -> DataFrame:
    x = t.locations(spark, d)
    clues, _ = catalog.ranked_pack(x, t.maps(spark, d), x.select("map_id", "location_id"))
    return catalog.no_leak(clues).select("map_id", "location_id", "assist_level")


def ranked_guesses(spark: SparkSession, d: str) -> DataFrame:
    x = t.locations(spark, d)
    g = x.where("k % 2 = 0").select("map_id", "location_id", (F.col("truth_lat") / 2).alias("ai_lat"))
    return catalog.ranked_pack(x, t.maps(spark, d), g)[1].select("map_id", "location_id")


def imported_locations(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer").select(F.col("c_name").alias("poi_id"), F.format_string("%d.25", F.col("c_custkey") % 100).alias("latitude"), F.lit("12.5").alias("longitude"), F.when(F.col("c_custkey") % 3 == 0, F.repeat("c_mktsegment", 15)).alias("address"), F.lit(" no ").alias("country"), F.lit(2.0).alias("half_km"))
    return catalog.imported_locations(c).select("location_id", "truth_lat", "truth_lon", "title", "country")


def registry_gaps(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").select(F.col("o_custkey").alias("bundle"))
    return catalog.registry_gaps(o, t.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("bundle")), "bundle")


def hint_coverage(spark: SparkSession, d: str) -> DataFrame:
    x, _, hints, _ = _sides(spark, d)
    return catalog.hint_coverage(x, hints, F.col("assist_level") == "none")


def violation_report(spark: SparkSession, d: str) -> DataFrame:
    return catalog.violation_report(lint_locations(spark, d))


def shipped_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    local = c.select("id", F.when(F.col("id") % 2 == 0, F.array("id")).otherwise(F.array().cast("array<bigint>")).alias("xs"))
    shipped = c.where("id % 3 = 0").select("id", F.array(F.col("id") * 10).alias("xs"))
    return catalog.overlaid(local, shipped, "id", ["xs"]).select("id", F.get("xs", F.lit(0)).alias("x"), "outcome")


def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "documents").select("doc_id", F.concat(F.format_string("poi_%06d_g%03d_t%04d", F.col("doc_id") % 50, F.col("doc_id") % 4, F.col("doc_id") % 9)).alias("stem"))
    keys = spark.range(50).select(F.when(F.col("id") % 3 == 0, F.format_string("poi_%06d", "id")).otherwise(F.format_string("poi_%06d_g%03d", "id", F.lit(1))).alias("k"), F.concat(F.lit("still_"), "id").alias("rel"))
    return joins.fallback_lookup(x, keys, [T.lookup_stem(F.col("stem")), T.base_id(F.col("stem"))], "k", "rel")


def wildcard_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = t.guesses(spark, d).select("id", "map_id", "session_id")
    exact = g.select("map_id", "session_id").distinct().where("cast(session_id as int) % 2 = 0").withColumn("style", F.concat_ws("-", "map_id", "session_id"))
    wild = g.select("map_id").distinct().where("map_id < 'p'").select("map_id", F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("any-"), "map_id").alias("style"))
    return joins.wildcard_lookup(g, exact.unionByName(wild), ["map_id", "session_id"], "session_id", "style")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 40).alias("site"), F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("scene_ts"), F.when(F.col("o_orderkey") % 23 != 0, (F.col("o_orderkey") % 60).cast("double")).alias("cloud"))


def _site_events(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("event_id"), (F.col("c_custkey") % 40).alias("site"), F.timestamp_seconds(F.lit(820454400) + F.col("c_custkey") * 70000 % 60000000).alias("event_ts"))


def scene_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.scene_pairs(_site_events(spark, d), _scenes(spark, d), key="site")


def bitemporal_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _scenes(spark, d).withColumn("site", F.col("scene_id") % 997)
    return joins.bitemporal(s, "site").select("site", "early_id", "late_id", F.col("days").cast("long").alias("days"), "reason")


def first_seen_maps(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(t.locations(spark, d).where("map_id is not null"), ["map_id"], F.col("k")).select("map_id", "location_id")


def seed_inserts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.sql_inserts(t.maps(spark, d).withColumn("title", F.concat(F.col("title"), F.lit("'s"))), "maps", ["map_id", "title", "ranked_pool"])


def place_features(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d).select("id", F.floor("lat").alias("lat"), F.floor("lon").alias("lon"), "map_id")
    return catalog.geo_features(p, "lat", "lon", ["id", "map_id"])


QUERIES = {f.__name__: f for f in (
    lint_locations, lint_references, lint_maps, yaml_locations, hint_violations, clean_hints, manifest, map_summaries, ranked_clues, ranked_guesses, imported_locations, registry_gaps, hint_coverage, violation_report,
    shipped_overlay, fallback_lookup, wildcard_lookup, scene_pairs, bitemporal_pairs, first_seen_maps, seed_inserts, place_features,
)}

_L, _M = f"({t.LOCATIONS_SQL})", f"({t.MAPS_SQL})"
_LINT = f"""(WITH x AS (SELECT * FROM {_L} UNION ALL SELECT * FROM {_L} WHERE k % 50 = 0)
  SELECT 'missing_map_id' AS code, location_id AS key, 'map_id' AS path FROM x WHERE map_id IS NULL UNION ALL SELECT 'range_lat', location_id, 'truth_lat' FROM x WHERE truth_lat > 90 OR truth_lat < -90
  UNION ALL SELECT 'range_lon', location_id, 'truth_lon' FROM x WHERE truth_lon NOT BETWEEN -180 AND 180 UNION ALL SELECT 'duplicate_location_id', location_id, 'location_id' FROM x GROUP BY location_id HAVING count(*) > 1)"""
_TIERS = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, {m} AS most, doc_id % {i + 7} != 0 AS has, CASE WHEN doc_id % {i + 7} != 0 THEN substr(text, 1 + {i - 1} * n, n) ELSE '' END AS v FROM (SELECT doc_id, coalesce(text, '') AS text, ceil(length(coalesce(text, '')) / 6)::BIGINT AS n FROM documents)" for i, m in enumerate(T.TIER_LENGTHS, 1))
_SIDE = f"""(SELECT x.*, k % 41 != 0 AS s, k % 3 != 0 AS h, k % 11 != 0 AS valid, k % 6 != 0 AS filled FROM {_L} x)"""
SQL = {
    "lint_locations": f"SELECT * FROM {_LINT}",
    "violation_report": f"SELECT code, count(*) AS n, min(key) AS example FROM {_LINT} GROUP BY code",
    "lint_references": f"SELECT 'map_without_location' AS code, map_id AS key, 'map_id' AS path FROM {_M} WHERE map_id NOT IN (SELECT map_id FROM {_L} WHERE map_id IS NOT NULL) UNION ALL SELECT 'unknown_map', location_id, 'map_id' FROM {_L} WHERE map_id IS NOT NULL AND map_id NOT IN (SELECT map_id FROM {_M})",
    "lint_maps": f"SELECT 'missing_title' AS code, map_id AS key, 'title' AS path FROM {_M} WHERE NOT ranked_pool",
    "yaml_locations": """WITH x AS (SELECT *, c_custkey % 10 = 0 AS bad FROM customer) SELECT c_custkey, CASE WHEN NOT bad THEN c_name END AS location_id, CASE WHEN NOT bad THEN c_mktsegment || ': #' || c_custkey END AS segment, CASE WHEN NOT bad THEN c_custkey % 80 + 0.25::DOUBLE END AS lat,
      CASE WHEN NOT bad THEN c_custkey % 2 = 0 END AS ranked, CASE WHEN NOT bad THEN 'first ' || c_custkey END AS hint, CASE WHEN NOT bad THEN c_custkey::BIGINT END AS deep, CASE WHEN NOT bad THEN 'folded ' || c_mktsegment || chr(10) || 'end' END AS notes, bad AS unread FROM x""",
    "hint_violations": rf"""WITH t AS ({_TIERS}) SELECT 'missing_tier_key' AS code, doc_id::VARCHAR AS key, 'tier_' || i AS path FROM t WHERE NOT has UNION ALL SELECT 'length_cap', doc_id::VARCHAR, 'tier_' || i FROM t WHERE length(v) > most
      UNION ALL SELECT 'coordinate_literal', doc_id::VARCHAR, 'tier_' || i FROM t WHERE regexp_matches(v, '-?\d{{1,3}}\.\d{{4,}}\s*,\s*-?\d{{1,3}}\.\d{{4,}}') UNION ALL SELECT 'empty_tier', doc_id::VARCHAR, 'tier_' || i FROM t WHERE doc_id % 6 != 0 AND trim(v, ' ') = ''
      UNION ALL SELECT 'banned_substring', doc_id::VARCHAR, 'tier_' || i FROM t WHERE contains(lower(v), 'the') OR contains(lower(v), 'secret')""",
    "clean_hints": f"WITH t AS ({_TIERS}) SELECT doc_id, count(*) FILTER (has AND (i < 4 OR trim(v, ' ') != '')) AS n, coalesce(max(trim(v, ' ')) FILTER (i = 4 AND has AND trim(v, ' ') != ''), '-') AS tier_4 FROM t GROUP BY doc_id",
    "manifest": f"""SELECT location_id, map_id, CASE WHEN s THEN 'still_' || k END AS still_id, CASE WHEN assist_level = 'none' THEN 'assist_none' WHEN NOT h THEN 'missing_file' WHEN NOT valid THEN 'invalid_wrapper' WHEN NOT filled THEN 'empty_tiers' ELSE 'ok' END AS hint_status,
      CASE WHEN assist_level != 'none' AND h AND valid AND filled THEN 'look north' END AS tier_1, CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS n_pack, CASE WHEN k % 4 = 0 THEN 'near ' || k END AS narrative, CASE WHEN NOT s THEN 'missing_still' END AS problem FROM {_SIDE}""",
    "map_summaries": f"SELECT map_id, title, NULL::VARCHAR AS content_version FROM {_M} WHERE ranked_pool",
    "ranked_clues": f"SELECT map_id, location_id, assist_level FROM {_L} WHERE map_id IN (SELECT map_id FROM {_M} WHERE ranked_pool)",
    "ranked_guesses": f"SELECT map_id, location_id FROM {_L} WHERE k % 2 = 0 AND map_id IN (SELECT map_id FROM {_M} WHERE ranked_pool)",
    "imported_locations": "SELECT c_name AS location_id, (c_custkey % 100) + 0.25::DOUBLE AS truth_lat, 12.5::DOUBLE AS truth_lon, CASE WHEN c_custkey % 3 != 0 THEN 'POI ' || c_name WHEN length(repeat(c_mktsegment, 15)) > 120 THEN substr(repeat(c_mktsegment, 15), 1, 117) || '...' ELSE repeat(c_mktsegment, 15) END AS title, 'NO' AS country FROM customer WHERE (c_custkey % 100) + 0.25 <= 90",
    "registry_gaps": "SELECT DISTINCT o_custkey AS bundle FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    "hint_coverage": f"SELECT location_id, CASE WHEN assist_level = 'none' THEN 'skipped' WHEN h THEN 'present' ELSE 'absent' END AS coverage FROM {_SIDE}",
    "shipped_overlay": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey WHEN c_custkey % 3 = 0 THEN c_custkey * 10 END AS x, CASE WHEN c_custkey % 2 = 0 THEN 'kept' WHEN c_custkey % 3 = 0 THEN 'filled' ELSE 'absent' END AS outcome FROM customer",
    "fallback_lookup": "SELECT doc_id, printf('poi_%06d_g%03d_t%04d', doc_id % 50, doc_id % 4, doc_id % 9) AS stem, CASE WHEN doc_id % 50 % 3 = 0 OR doc_id % 4 = 1 THEN 'still_' || doc_id % 50 END AS rel FROM documents",
    "wildcard_lookup": f"SELECT id, map_id, session_id, CASE WHEN session_id::INT % 2 = 0 THEN map_id || '-' || session_id WHEN map_id < 'p' THEN 'any-' || map_id END AS style, CASE WHEN session_id::INT % 2 = 0 THEN 'exact' WHEN map_id < 'p' THEN 'wildcard' ELSE 'none' END AS matched FROM ({t.GUESSES_SQL})",
    "scene_pairs": """WITH e AS (SELECT c_custkey AS event_id, c_custkey % 40 AS site, make_timestamp((820454400 + c_custkey * 70000 % 60000000) * 1000000) AS ts FROM customer), s AS (SELECT o_custkey % 40 AS site, o_orderkey AS scene_id, o_orderdate AS st, coalesce(CASE WHEN o_orderkey % 23 != 0 THEN (o_orderkey % 60)::DOUBLE END, 100.0::DOUBLE) AS cloud FROM orders),
      p AS (SELECT event_id, scene_id, abs(epoch_us(st) - epoch_us(ts)) AS gap, cloud, epoch_us(st) AS us, datediff('day', ts, st) AS days FROM e JOIN s USING (site) WHERE cloud < 30)
      SELECT event_id, (SELECT scene_id FROM p WHERE p.event_id = e.event_id AND days BETWEEN -90 AND 0 ORDER BY gap, cloud, -us, scene_id LIMIT 1) AS before_id, (SELECT scene_id FROM p WHERE p.event_id = e.event_id AND days BETWEEN 0 AND 60 ORDER BY gap, cloud, us, scene_id LIMIT 1) AS after_id FROM e""",
    "bitemporal_pairs": """WITH x AS (SELECT o_orderkey % 997 AS site, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS lo, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hi, datediff('day', min(o_orderdate), max(o_orderdate)) AS days FROM orders GROUP BY 1)
      SELECT site, CASE WHEN lo != hi AND days >= 21 THEN lo END AS early_id, CASE WHEN lo != hi AND days >= 21 THEN hi END AS late_id, days, CASE WHEN lo = hi THEN 'no_scene_pair' WHEN days < 21 THEN 'interval_too_short' END AS reason FROM x""",
    "first_seen_maps": f"SELECT map_id, arg_min(location_id, k) AS location_id FROM {_L} WHERE map_id IS NOT NULL GROUP BY map_id",
    "seed_inserts": f"SELECT 'INSERT INTO maps (map_id, title, ranked_pool) VALUES (''' || map_id || ''', ''' || title || '''''s'', ' || ranked_pool || ');' AS statement FROM {_M}",
    "place_features": f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || floor(lon)::BIGINT || ',' || floor(lat)::BIGINT || ']}},"properties":{{"id":' || id || ',"map_id":' || map_id || '}}}}' AS feature FROM ({t.PLACES_SQL})""",
}
