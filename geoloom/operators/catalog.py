"""Catalogs of maps and locations: lint, hints, manifests, packs and imports.

Locations have location_id, map_id, truth_lat, truth_lon and assist_level; maps have map_id, title and flags.
Violations are rows (code, key, path), so a catalog's lint is one union of filters over one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def violations(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(code, key, path) for each rule (code, path, broken) that a row breaks; one pass, whatever the number of rules."""
    found = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, broken in rules]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("v")).select("v.code", "key", "v.path")


def lint_locations(locations: DataFrame) -> DataFrame:
    """Missing keys, coordinates out of range, ids unlike file names, and ids that occur again."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules = [(f"missing_{c}", c, blank(c)) for c in ("location_id", "map_id", "truth_lat", "truth_lon")]
    rules += [("range_lat", "truth_lat", ~F.col("truth_lat").between(-90, 90)), ("range_lon", "truth_lon", ~F.col("truth_lon").between(-180, 180))]
    if "file_stem" in locations.columns:
        rules.append(("filename_mismatch", "location_id", F.col("file_stem") != F.col("location_id").cast("string")))
    again = locations.groupBy("location_id").agg(F.count("*").alias("n")).where("n > 1 and location_id is not null")
    return violations(locations, "location_id", rules).unionByName(again.select(F.lit("duplicate_location_id").alias("code"), F.col("location_id").cast("string").alias("key"), F.lit("location_id").alias("path")))


def lint_references(maps: DataFrame, locations: DataFrame) -> DataFrame:
    """Maps without a location, and locations of maps that aren't listed."""
    lonely = maps.join(locations, "map_id", "left_anti").select(F.lit("map_without_location").alias("code"), F.col("map_id").cast("string").alias("key"), F.lit("map_id").alias("path"))
    unknown = locations.join(maps, "map_id", "left_anti").select(F.lit("unknown_map").alias("code"), F.col("location_id").cast("string").alias("key"), F.lit("map_id").alias("path"))
    return lonely.unionByName(unknown)


def lint_maps(maps: DataFrame) -> DataFrame:
    """Maps without an id or a title, and ids that occur again."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    again = maps.groupBy("map_id").agg(F.count("*").alias("n")).where("n > 1 and map_id is not null")
    return violations(maps, "map_id", [("missing_map_id", "map_id", blank("map_id")), ("missing_title", "title", blank("title"))]).unionByName(again.select(F.lit("duplicate_map_id").alias("code"), F.col("map_id").cast("string").alias("key"), F.lit("map_id").alias("path")))


def hint_violations(hints: DataFrame, key: str, *, lengths: list[int] | None = None, banned: list[str] | None = None, name: str | None = None) -> DataFrame:
    """Violations of hints in a map column, by tier.

    A tier may lack its key, be too long, hold coordinates or a banned string, or be blank while the row's
    assist_level asks for hints; with a name column the last tier must hold that name.
    """
    rules = []
    tiers = lengths or T.TIER_LENGTHS
    required = F.lower(F.trim(F.coalesce("assist_level", F.lit("")))) != "none"
    for i, most in enumerate(tiers, 1):
        tier, raw = f"tier_{i}", F.try_element_at("hints", F.lit(f"tier_{i}"))
        value = F.coalesce(raw, F.lit(""))
        rules += [
            ("missing_tier_key", tier, ~F.coalesce(F.map_contains_key("hints", tier), F.lit(False))),
            ("length_cap", tier, F.length(value) > most),
            ("coordinate_literal", tier, T.has_coordinates(value)),
            ("empty_tier", tier, required & (F.trim(value) == "")),
        ]
        if banned:
            rules.append(("banned_substring", tier, T.first_banned(value, banned).isNotNull()))
    if name:
        last = F.coalesce(F.try_element_at("hints", F.lit(f"tier_{len(tiers)}")), F.lit(""))
        rules.append(("max_tier_admin0", f"tier_{len(tiers)}", (F.trim(F.col(name)) != "") & ~F.lower(last).contains(F.lower(F.col(name)))))
    return violations(hints, key, rules)


def clean_tiers(hints: Column, tiers: int = 6) -> Column:
    """A map of trimmed hints: null tiers go, and blank ones from the fourth on."""
    wanted = F.array(*[F.lit(f"tier_{i}") for i in range(1, tiers + 1)])
    late = F.array(*[F.lit(f"tier_{i}") for i in range(4, tiers + 1)])
    kept = F.map_filter(hints, lambda k, v: F.array_contains(wanted, k) & v.isNotNull() & ~(F.array_contains(late, k) & (F.trim(v) == "")))
    return F.transform_values(kept, lambda k, v: F.trim(v))


def map_summaries(maps: DataFrame) -> DataFrame:
    """(map_id, title, content_version, engine_version) of the maps that have an id and a title."""
    have = set(maps.columns)
    extra = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("content_version", "engine_version")]
    return maps.where((F.trim(F.col("map_id").cast("string")) != "") & (F.trim("title") != "")).select("map_id", "title", *extra)


def assembled(locations: DataFrame, stills: DataFrame, hints: DataFrame, streets: DataFrame) -> DataFrame:
    """Locations with their stills, hints and street data.

    stills (location_id, still_id, style) must have every location: what lacks one gets status missing_still, which
    `must_have_stills` turns into an error. hints (location_id, hints, valid) may lack it: hint_status tells assist_none,
    missing_file, invalid_wrapper, empty_tiers or ok. streets (location_id, pack, narrative) is optional.
    """
    s = stills.select("location_id", "still_id", "style")
    h = hints.select("location_id", "hints", "valid", F.lit(True).alias("__h"))
    joined = locations.join(s, "location_id", "left").join(h, "location_id", "left").join(streets.select("location_id", "pack", "narrative"), "location_id", "left")
    tiers = clean_tiers(F.col("hints"))
    off = F.lower(F.trim(F.coalesce("assist_level", F.lit("")))) == "none"
    some = F.size(F.filter(F.map_values(tiers), lambda v: v != "")) > 0
    status = F.when(off, "assist_none").when(F.col("__h").isNull(), "missing_file").when(~F.coalesce("valid", F.lit(False)), "invalid_wrapper").when(~F.coalesce(some, F.lit(False)), "empty_tiers").otherwise("ok")
    return joined.select(
        *locations.columns, "still_id", "style", status.alias("hint_status"), F.when(status == "ok", tiers).alias("useful_hints"), "pack", "narrative",
        F.when(F.col("still_id").isNull(), "missing_still").alias("problem"),
    )


def must_have_stills(manifest: DataFrame) -> DataFrame:
    """The manifest; reading a location without a still is an error."""
    told = F.raise_error(F.concat(F.lit("no still for "), F.col("location_id").cast("string")))
    return manifest.withColumn("still_id", F.when(F.col("problem").isNotNull(), told.cast("string")).otherwise(F.col("still_id").cast("string"))).drop("problem")


def shipped_guesses(guesses: DataFrame, locations: DataFrame) -> DataFrame:
    """Guesses of shipped locations."""
    return guesses.join(locations.select("map_id", "location_id"), ["map_id", "location_id"], "left_semi")


def ranked_pack(locations: DataFrame, maps: DataFrame, guesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clues (locations of ranked maps, without their true places) and the guesses for them."""
    ranked = maps.where(F.coalesce("ranked_pool", F.lit(False))).select("map_id")
    clues = locations.join(ranked, "map_id", "left_semi").drop("truth_lat", "truth_lon")
    return clues, shipped_guesses(guesses, clues)


def no_leak(df: DataFrame, banned: tuple[str, ...] = ("truth_lat", "truth_lon")) -> DataFrame:
    """df; a banned name anywhere in its schema is an error."""
    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", []):
            if f.name in banned:
                raise ValueError(f"{path}.{f.name} must not be here")
            walk(f.dataType, f"{path}.{f.name}")
        for part in ("elementType", "valueType", "keyType"):
            if hasattr(kind, part):
                walk(getattr(kind, part), path)

    walk(df.schema, "$")
    return df


def imported_locations(points: DataFrame) -> DataFrame:
    """Catalog rows from places (poi_id, latitude, longitude, address, half_km, country)."""
    from ..functions import geo

    lat, lon = geo.parse_coordinate(F.col("latitude")), geo.parse_coordinate(F.col("longitude"))
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return points.where(good).select(
        F.col("poi_id").alias("location_id"), F.col("poi_id").alias("map_id"), lat.alias("truth_lat"), lon.alias("truth_lon"),
        F.lit("tiers").alias("assist_level"), T.titled(F.col("address"), F.concat(F.lit("POI "), F.col("poi_id"))).alias("title"),
        F.upper(F.trim("country")).alias("country"), geo.box_around(lat, lon, F.col("half_km")).alias("bbox"),
    )


def registry_gaps(references: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Ids that are referred to and not registered."""
    return references.select(key).where(F.col(key).isNotNull()).distinct().join(registry.select(key), key, "left_anti")


def overlaid(local: DataFrame, shipped: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """local, with its empty lists replaced by the shipped ones, and an outcome: kept, filled or absent."""
    s = shipped.select(key, *[F.col(c).alias(f"__{c}") for c in lists])
    joined = local.join(s, key, "left")
    empty = {c: F.coalesce(F.size(F.col(c)) <= 0, F.lit(True)) for c in lists}
    take = {c: empty[c] & (F.coalesce(F.size(F.col(f"__{c}")), F.lit(0)) > 0) for c in lists}
    filled = reduce(lambda a, b: a | b, take.values())
    bare = reduce(lambda a, b: a & b, [empty[c] & ~take[c] for c in lists])
    return joined.select(key, *[F.when(take[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in lists], F.when(filled, "filled").when(bare, "absent").otherwise("kept").alias("outcome"))


def hint_coverage(locations: DataFrame, hints: DataFrame, skipped: Column) -> DataFrame:
    """Each location with skipped, present or absent."""
    have = hints.select("location_id").distinct().withColumn("__h", F.lit(True))
    return locations.join(have, "location_id", "left").select("location_id", F.when(skipped, "skipped").when(F.col("__h"), "present").otherwise("absent").alias("coverage"))


def violation_report(found: DataFrame) -> DataFrame:
    """(code, n, example): how often each code occurs, and the least key it occurs at."""
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("key").alias("example"))


def seed_rows(template: dict[str, str], rows: DataFrame) -> DataFrame:
    """rows with columns of a template: those that rows lack are added, and fill the gaps of those it has."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(template[c])).alias(c) if c in template else F.col(c) for c in rows.columns], *[F.lit(v).alias(c) for c, v in template.items() if c not in rows.columns])


def geo_features(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature as text for each row: a point and its properties."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def sql_inserts(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """An INSERT statement for each row, with texts quoted."""
    kinds = dict(df.dtypes)

    def literal(c: str) -> Column:
        value = F.col(c).cast("string")
        shown = F.concat(F.lit("'"), T.sql_literal(value), F.lit("'")) if kinds[c] == "string" else value
        return F.coalesce(shown, F.lit("NULL"))

    values = F.array_join(F.array(*[literal(c) for c in columns]), ", ")
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), values, F.lit(");")).alias("statement"))
