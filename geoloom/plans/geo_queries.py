"""Queries over places: distances, boxes, bands, scores and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import areas, joins, lines, pairs, sampling
from . import tables as t


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d)
    return p.withColumn("lat2", t.lat_of(F.col("id") * 3 + 11)).withColumn("lon2", t.lon_of(F.col("id") * 3 + 11))


PAIRS = f"(SELECT p.*, {t.lat_sql('(id * 3 + 11)')} AS lat2, {t.lon_sql('(id * 3 + 11)')} AS lon2 FROM ({t.PLACES_SQL}) p)"
R6 = lambda c: F.round(c, 6)


def geo_distances(spark: SparkSession, d: str) -> DataFrame:
    a = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    return _pairs(spark, d).select("id", R6(geo.haversine_km(*a)).alias("km"), R6(geo.haversine_km(*a, geo.RADIUS_RANKED_KM)).alias("km_ranked"), F.round(geo.haversine_m(*a), 3).alias("metres"), R6(geo.clamp_distance(geo.haversine_km(*a), 5000.0)).alias("km_clamped"))


def geo_bearing(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("id", R6(geo.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("bearing"))


def geo_destination(spark: SparkSession, d: str) -> DataFrame:
    at = geo.destination(F.col("lat"), F.col("lon"), (F.col("id") % 360).cast("double"), (F.col("id") % 900).cast("double"))
    return t.places(spark, d).select("id", at.alias("p")).select("id", R6(F.col("p.lat")).alias("lat"), R6(F.col("p.lon")).alias("lon"))


def geo_boxes(spark: SparkSession, d: str) -> DataFrame:
    a, b = geo.box_around(F.col("lat"), F.col("lon"), 2.5), geo.box_around_flat(F.col("lat"), F.col("lon"), 2.5)
    return t.places(spark, d).select("id", a.alias("a"), b.alias("b")).select("id", *[R6(F.col(f"a.{s}")).alias(f"sphere_{s}") for s in ("west", "south", "east", "north")], *[R6(F.col(f"b.{s}")).alias(f"flat_{s}") for s in ("west", "south", "east", "north")])


def geo_bands(spark: SparkSession, d: str) -> DataFrame:
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    near = F.round(km, 6) / 100
    return _pairs(spark, d).select(
        "id", geo.utm_epsg(F.col("lat"), F.col("lon")).cast("long").alias("utm"), geo.projected_epsg(F.col("lat"), F.col("lon")).cast("long").alias("projected"), geo.hemisphere(F.col("lat")).alias("hemisphere"), geo.latitude_band(F.col("lat")).alias("band"),
        geo.feature_proximity(near, F.col("id") % 7 != 0).alias("proximity"), geo.coast_proximity(F.when(F.col("id") % 11 != 0, near * 4)).alias("coast"), geo.search_radius_m(F.when(F.col("id") % 3 != 0, (F.col("id") % 40).cast("double")), 50.0, 3.0).alias("radius_m"),
    )


def geo_scores(spark: SparkSession, d: str) -> DataFrame:
    km = F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), geo.RADIUS_RANKED_KM), 6)
    return _pairs(spark, d).withColumn("km", km).select("id", geo.score_ranked(F.col("km")).cast("long").alias("ranked"), geo.score_casual(F.col("km")).cast("long").alias("casual"), geo.hotspot_confidence(F.col("km") / 20000).alias("hotspot"), geo.candidate_confidence(F.col("km") / 20000).alias("candidate"))


def geo_web_mercator(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d).withColumn("m", geo.web_mercator(F.col("lat"), F.col("lon")))
    return p.select("id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


def geo_chip_transform(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d).withColumn("t", geo.chip_transform(geo.box_around_flat(F.col("lat"), F.col("lon"), 2.5), 512, 512))
    return p.select("id", *[F.round(F.col("t")[i], 4).alias(n) for i, n in ((0, "a"), (2, "c"), (4, "e"), (5, "f"))])


def geo_hash_uniform(spark: SparkSession, d: str) -> DataFrame:
    return t.places(spark, d).select("id", R6(geo.hash_uniform(F.lit("seed"), F.col("id"))).alias("u"))


def geo_jitter(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.jitter_variants(t.places(spark, d).select("id", "lat", "lon"), "id", 3, 1500.0, "jitter")
    return out.select("id", R6(F.col("lat")).alias("lat"), R6(F.col("lon")).alias("lon"))


def geo_decoys(spark: SparkSession, d: str) -> DataFrame:
    return sampling.decoys(t.places(spark, d), 25.0, 45.0).select("id", R6(F.col("ai_lat")).alias("ai_lat"), R6(F.col("ai_lon")).alias("ai_lon"))


def geo_random_guesses(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.random_guesses(t.places(spark, d), "id", 5.0, 400.0, "guess")
    return out.select("id", R6(F.col("ai_lat")).alias("ai_lat"), R6(F.col("ai_lon")).alias("ai_lon"))


def geo_guess_range(spark: SparkSession, d: str) -> DataFrame:
    g = sampling.random_guesses(t.places(spark, d), "id", 5.0, 400.0, "guess")
    return sampling.out_of_range(g, 50.0, 350.0).select("id", R6(F.col("km")).alias("km"))


def geo_sane_coordinates(spark: SparkSession, d: str) -> DataFrame:
    out = geo.sane_coordinates(F.when(F.col("id") % 9 != 0, F.col("lat2")), F.col("lon2"), F.col("lat"), F.col("lon"), 2500.0)
    return _pairs(spark, d).select("id", out.alias("s")).select("id", R6(F.col("s.lat")).alias("lat"), R6(F.col("s.lon")).alias("lon"), F.col("s.replaced").alias("replaced"))


def geo_parse_coordinates(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("id") % 5 == 0, F.lit("n/a")).when(F.col("id") % 7 == 0, F.lit(" 91.5 ")).otherwise(F.format_string("%d.5", (F.col("id") % 80)))
    return t.places(spark, d).select("id", geo.parse_lat_lon([raw], [F.col("lon")]).alias("p")).select("id", R6(F.col("p.lat")).alias("lat"), R6(F.col("p.lon")).alias("lon"))


def geo_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    near = joins.near_pairs(t.places(spark, d), t.features(spark, d), 250.0, id_b="feature_id")
    return near.select("id_a", "id_b", R6(F.col("km")).alias("km"))


def geo_nearest_feature(spark: SparkSession, d: str) -> DataFrame:
    near = joins.nearest(t.places(spark, d), t.features(spark, d), start_km=300.0)
    return near.select("id", "feature_id", R6(F.col("km")).alias("km"))


def geo_closest_pair(spark: SparkSession, d: str) -> DataFrame:
    km = pairs.closest_pair_km(t.features(spark, d), place="feature_id")
    return spark.createDataFrame([(None if km is None else round(km, 6),)], "km double")


def geo_first_far_pair(spark: SparkSession, d: str) -> DataFrame:
    s = t.features(spark, d).select((F.col("feature_id") % 20).alias("job"), F.col("feature_id").alias("pos"), "lat", "lon")
    return pairs.first_far_pair(s, "job", 4000.0).select("job", "pos_a", "pos_b", R6(F.col("km")).alias("km"))


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """Diamonds with a hole and a second part beside them; codes are shared."""
    n = t.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("polygon_id"))
    x, y, h = t.lon_of(F.col("polygon_id") * 11) * 0.8, t.lat_of(F.col("polygon_id") * 29) * 0.8, (F.col("polygon_id") % 5 + 3).cast("double")

    def diamond(east, size, way: int):
        corners = [(size, 0.0), (0.0, size), (-size, 0.0), (0.0, -size)][::way]
        return F.array(*[F.struct((x + east + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])

    rings = F.array(diamond(0.0, h, 1), diamond(0.0, h / 2, -1), diamond(h * 2, h / 3, 1))
    return n.select("polygon_id", (h * h * 2).alias("area"), rings.alias("rings"), F.concat(F.lit("c"), (F.col("polygon_id") % 10).cast("string")).alias("code"))


def geo_points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return joins.points_in_polygons(t.places(spark, d), _polygons(spark, d))


def geo_country_of(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d).withColumn("code", F.when(F.col("id") % 13 != 0, F.concat(F.lit(" C"), (F.col("id") % 12).cast("string"))))
    return areas.with_code(p, _polygons(spark, d))


def _rivers(spark: SparkSession, d: str) -> DataFrame:
    """Lines of five points from suppliers."""
    k = F.col("s_suppkey")
    step = lambda i: F.struct((t.lon_of(k) * 0.9 + 1.5 * i).alias("x"), (t.lat_of(k * 7 + 3) * 0.9 + ((k * 13 + 7 * i) % 5 - 2) * 0.8).alias("y"))
    return t.table(spark, d, "supplier").select(k.alias("line_id"), F.array(*[step(i) for i in range(5)]).alias("path"))


def _coasts(spark: SparkSession, d: str) -> DataFrame:
    """Long lines around the world from nations."""
    k = F.col("n_nationkey").cast("long")
    step = lambda i: F.struct(F.lit(-170.0 + 42.5 * i).alias("x"), (t.lat_of(k * 29) * 0.8 + ((k + i) % 3) * 4.0).alias("y"))
    return t.table(spark, d, "nation").select(k.alias("line_id"), F.array(*[step(i) for i in range(9)]).alias("path"))


def geo_nearest_line(spark: SparkSession, d: str) -> DataFrame:
    return lines.nearest_line(t.places(spark, d), _rivers(spark, d)).select("id", "line_id", R6(F.col("km")).alias("km"))


def geo_coast_distance(spark: SparkSession, d: str) -> DataFrame:
    return lines.nearest_line(t.places(spark, d), _coasts(spark, d)).select("id", R6(F.col("km")).alias("km"))


def geo_location_context(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a place: the area that holds it, the nearest line and the coast, with their bands."""
    p = t.places(spark, d)
    held = joins.points_in_polygons(p, _polygons(spark, d))
    river = lines.nearest_line(p, _rivers(spark, d)).select("id", F.col("line_id").alias("river_id"), F.col("km").alias("river_km"))
    coast = lines.nearest_line(p, _coasts(spark, d)).select("id", F.col("km").alias("coast_km"))
    all_ = p.select("id", "lat").join(held, "id", "left").join(river, "id", "left").join(coast, "id", "left")
    return all_.select(
        "id", "polygon_id", "river_id", F.round("river_km", 3).alias("river_km"), F.round("coast_km", 3).alias("coast_km"), geo.latitude_band(F.col("lat")).alias("band"),
        geo.feature_proximity(F.col("river_km"), F.col("river_id").isNotNull()).alias("river"), geo.coast_proximity(F.col("coast_km")).alias("coast"),
    )


def geo_spread_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spread(t.places(spark, d), "id", 8, 500.0, "spread").select("id", "lat", "lon", F.col("pick").cast("long").alias("pick"))


def geo_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.spaced(t.places(spark, d), "id", 150.0, "spaced").select("id", "lat", "lon")


def geo_merged_guesses(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d).withColumnRenamed("id", "location_id")
    base = p.where("location_id % 3 != 0").select("map_id", "location_id", "lat", "lon")
    over = p.where("location_id % 4 = 0").select("map_id", "location_id", (F.col("lat") + (F.col("location_id") % 3)).alias("lat"), "lon")
    return joins.merged_guesses(p, base, over, prefer_overlay=False, tolerance_km=100.0).select("map_id", "location_id", R6(F.col("lat")).alias("lat"), R6(F.col("lon")).alias("lon"), "status")


QUERIES = {f.__name__: f for f in (
    geo_distances, geo_bearing, geo_destination, geo_boxes, geo_bands, geo_scores, geo_web_mercator, geo_chip_transform, geo_hash_uniform, geo_jitter, geo_decoys, geo_random_guesses, geo_guess_range,
    geo_sane_coordinates, geo_parse_coordinates, geo_near_pairs, geo_nearest_feature, geo_closest_pair, geo_first_far_pair, geo_points_in_polygons, geo_country_of, geo_nearest_line, geo_coast_distance, geo_location_context, geo_spread_sample, geo_spaced_sample, geo_merged_guesses,
)}

_KM = t.haversine_sql("lat", "lon", "lat2", "lon2")
_KMR = t.haversine_sql("lat", "lon", "lat2", "lon2", 6371.0088)


def _dest(lat: str, lon: str, course: str, km: str) -> tuple[str, str]:
    far = f"(({km}) / 6371.0::DOUBLE)"
    phi = f"asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sin(radians({lat})) * cos({far}) + cos(radians({lat})) * sin({far}) * cos(radians({course})))))"
    turn = f"atan2(sin(radians({course})) * sin({far}) * cos(radians({lat})), cos({far}) - sin(radians({lat})) * sin({phi}))"
    return f"degrees({phi})", f"(((degrees(radians({lon}) + {turn}) + 540.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE)"


def _u(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


_RG_LAT, _RG_LON = _dest("lat", "lon", f"{_u(chr(39) + 'guess' + chr(39), 'id', chr(39) + 'course' + chr(39))} * 360.0", f"{_u(chr(39) + 'guess' + chr(39), 'id', chr(39) + 'km' + chr(39))} * 395.0 + 5.0")
_DC_LAT, _DC_LON = _dest("lat", "lon", "45.0::DOUBLE", "25.0::DOUBLE")
_DS_LAT, _DS_LON = _dest("lat", "lon", "(id % 360)::DOUBLE", "(id % 900)::DOUBLE")
_FLAT_W = "2500.0::DOUBLE / (greatest(cos(radians(lat)), 1e-6) * 111320.0::DOUBLE)"
_MX, _MY = (lambda lon: f"(radians({lon}) * 6378137.0::DOUBLE)"), (lambda lat: f"(ln(tan(radians({lat}) / 2 + 0.7853981633974483::DOUBLE)) * 6378137.0::DOUBLE)")

# Diamonds with a hole and a second part, and the points that each holds.
_DIAMONDS = f"SELECT n_nationkey::BIGINT AS polygon_id, {t.lon_sql('(n_nationkey::BIGINT * 11)')} * 0.8::DOUBLE AS x, {t.lat_sql('(n_nationkey::BIGINT * 29)')} * 0.8::DOUBLE AS y, (n_nationkey % 5 + 3)::DOUBLE AS h, 'C' || (n_nationkey % 10) AS code FROM nation"
_HELD = f"""SELECT q.id, g.polygon_id, h * h * 2 AS area FROM ({t.PLACES_SQL}) q JOIN g ON (abs(q.lon - g.x) + abs(q.lat - g.y) <= g.h + 1e-12 AND abs(q.lon - g.x) + abs(q.lat - g.y) >= g.h / 2 - 1e-12)
        OR abs(q.lon - g.x - 2 * g.h) + abs(q.lat - g.y) <= g.h / 3 + 1e-12"""
_RIVERS = f"SELECT s_suppkey AS line_id, {t.lon_sql('s_suppkey')} * 0.9::DOUBLE + 1.5::DOUBLE * i AS x, {t.lat_sql('(s_suppkey * 7 + 3)')} * 0.9::DOUBLE + ((s_suppkey * 13 + 7 * i) % 5 - 2) * 0.8::DOUBLE AS y, i FROM supplier, range(0, 5) r(i)"
_COASTS = f"SELECT n_nationkey::BIGINT AS line_id, -170.0::DOUBLE + 42.5::DOUBLE * i AS x, {t.lat_sql('(n_nationkey::BIGINT * 29)')} * 0.8::DOUBLE + ((n_nationkey + i) % 3) * 4.0::DOUBLE AS y, i FROM nation, range(0, 9) r(i)"


def _arcs(name: str, points: str) -> str:
    """CTEs, the last one {name}_km: the distance from each place of p to each arc of each line."""
    cross = lambda a, b: [f"({a}y * {b}z - {a}z * {b}y)", f"({a}z * {b}x - {a}x * {b}z)", f"({a}x * {b}y - {a}y * {b}x)"]
    named = lambda n, xs: ", ".join(f"{x} AS {n}{c}" for c, x in zip("xyz", xs, strict=True))
    unit = lambda lat, lon: [f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"]
    dot = lambda a: f"(px * {a}x + py * {a}y + pz * {a}z)"
    return f"""{name}_v AS (SELECT *, {named('u', unit('y', 'x'))}, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ({points}) WINDOW w AS (PARTITION BY line_id ORDER BY i)),
      {name}_b AS (SELECT *, {named('v', unit('y2', 'x2'))} FROM {name}_v WHERE x2 IS NOT NULL), {name}_n AS (SELECT *, {named('n', cross('u', 'v'))} FROM {name}_b),
      {name}_e AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS ns, {named('m', cross('n', 'u'))}, {named('k', cross('v', 'n'))} FROM {name}_n), {name}_p AS (SELECT *, {named('p', unit('lat', 'lon'))} FROM p),
      {name}_km AS (SELECT id, line_id, CASE WHEN ns > 1e-14 AND {dot('m')} >= 0 AND {dot('k')} >= 0 THEN abs(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot('n')} / ns)))) * 6371.0::DOUBLE
        ELSE least({t.haversine_sql('lat', 'lon', 'y', 'x')}, {t.haversine_sql('lat', 'lon', 'y2', 'x2')}) END AS km FROM {name}_p, {name}_e)"""


def _spread_sql(k: int, apart: float) -> str:
    """Picks one after the other, each over all places and all picks before it."""
    ctes = [f"p AS ({t.PLACES_SQL})", "p0 AS (SELECT id, lat, lon, 0 AS pick FROM p ORDER BY sha256('spread|' || id), id LIMIT 1)"]
    for i in range(1, k):
        before = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(i))
        km = t.haversine_sql("b.lat", "b.lon", "p.lat", "p.lon")
        ctes.append(f"p{i} AS (SELECT id, lat, lon, {i} AS pick FROM (SELECT p.id, any_value(p.lat) AS lat, any_value(p.lon) AS lon, min({km}) AS km FROM p, ({before}) b GROUP BY p.id) WHERE km >= {apart} ORDER BY km DESC, id LIMIT 1)")
    return f"WITH {', '.join(ctes)} SELECT id, lat, lon, pick::BIGINT AS pick FROM (" + " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(k)) + ")"


SQL = {
    "geo_distances": f"SELECT id, round({_KM}, 6) AS km, round({_KMR}, 6) AS km_ranked, round({_KM} * 1000, 3) AS metres, round(least({_KM}, 5000.0), 6) AS km_clamped FROM {PAIRS}",
    "geo_bearing": f"""SELECT id, round((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360.0::DOUBLE) % 360.0::DOUBLE, 6) AS bearing FROM {PAIRS}""",
    "geo_destination": f"SELECT id, round({_DS_LAT}, 6) AS lat, round({_DS_LON}, 6) AS lon FROM ({t.PLACES_SQL})",
    "geo_boxes": f"""SELECT id, round(lon - degrees(2.5 / (cos(radians(lat)) * 6371.0::DOUBLE)), 6) AS sphere_west, round(lat - degrees(2.5 / 6371.0::DOUBLE), 6) AS sphere_south, round(lon + degrees(2.5 / (cos(radians(lat)) * 6371.0::DOUBLE)), 6) AS sphere_east, round(lat + degrees(2.5 / 6371.0::DOUBLE), 6) AS sphere_north,
      round(greatest(lon - {_FLAT_W}, -180.0), 6) AS flat_west, round(greatest(lat - 2500.0::DOUBLE / 111320.0::DOUBLE, -90.0), 6) AS flat_south, round(least(lon + {_FLAT_W}, 180.0), 6) AS flat_east, round(least(lat + 2500.0::DOUBLE / 111320.0::DOUBLE, 90.0), 6) AS flat_north FROM ({t.PLACES_SQL})""",
    "geo_bands": f"""WITH p AS (SELECT *, round({_KM}, 6) / 100 AS near, least(60, greatest(1, floor((lon + 180.0) / 6.0)::BIGINT + 1)) AS zone FROM {PAIRS})
      SELECT id, CASE WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS utm, CASE WHEN abs(lat) > 84 THEN 3857 WHEN lat >= 0 THEN 32600 + zone ELSE 32700 + zone END AS projected, CASE WHEN lat >= 0 THEN 'Northern' ELSE 'Southern' END AS hemisphere,
      CASE WHEN abs(lat) < 23.5 THEN 'low_latitudes_tropical_subtropical' WHEN abs(lat) < 50 THEN 'mid_latitudes_temperate' WHEN abs(lat) < 66.5 THEN 'high_mid_latitudes_cool_temperate' ELSE 'polar_subpolar' END AS band,
      CASE WHEN id % 7 = 0 THEN 'none' WHEN near < 3 THEN 'immediate' WHEN near < 15 THEN 'near' WHEN near < 60 THEN 'regional' ELSE 'distant' END AS proximity,
      CASE WHEN id % 11 = 0 THEN 'unknown' WHEN near * 4 < 25 THEN 'sea_adjacent' WHEN near * 4 < 100 THEN 'near_coast' WHEN near * 4 < 400 THEN 'midcontinent' ELSE 'distant_maritime' END AS coast,
      greatest(1000.0, CASE WHEN id % 3 != 0 AND id % 40 > 0 THEN least(50.0, 3.0 * (id % 40)) ELSE 50.0 END * 1000.0)::DOUBLE AS radius_m FROM p""",
    "geo_scores": f"""WITH p AS (SELECT *, round({_KMR}, 6) AS km FROM {PAIRS}) SELECT id, CASE WHEN km <= 0 THEN 1000000 ELSE trunc(1000000 / (1.0::DOUBLE + km))::BIGINT END AS ranked, floor(greatest(0.0::DOUBLE, 5000.0::DOUBLE - km * 2.8::DOUBLE) + 0.5)::BIGINT AS casual,
      CASE WHEN km / 20000 >= 0.35 THEN 'high' WHEN km / 20000 >= 0.18 THEN 'medium' ELSE 'low' END AS hotspot, CASE WHEN km / 20000 >= 0.82 THEN 'high' WHEN km / 20000 >= 0.55 THEN 'medium' ELSE 'low' END AS candidate FROM p""",
    "geo_web_mercator": f"SELECT id, round({_MX('lon')}, 3) AS x, round({_MY('lat')}, 3) AS y FROM ({t.PLACES_SQL})",
    "geo_chip_transform": f"""WITH p AS (SELECT id, greatest(lon - {_FLAT_W}, -180.0) AS w, greatest(lat - 2500.0::DOUBLE / 111320.0::DOUBLE, -90.0) AS s, least(lon + {_FLAT_W}, 180.0) AS e, least(lat + 2500.0::DOUBLE / 111320.0::DOUBLE, 90.0) AS n FROM ({t.PLACES_SQL}))
      SELECT id, round(({_MX('e')} - {_MX('w')}) / 512, 4) AS a, round({_MX('w')}, 4) AS c, round(({_MY('s')} - {_MY('n')}) / 512, 4) AS e, round({_MY('n')}, 4) AS f FROM p""",
    "geo_hash_uniform": f"SELECT id, round({_u(chr(39) + 'seed' + chr(39), 'id')}, 6) AS u FROM ({t.PLACES_SQL})",
    "geo_jitter": f"""WITH p AS (SELECT id, lat, lon, v, sqrt({_u("'jitter'", 'id', 'v', "'u'")}) * 1500.0 AS far, {_u("'jitter'", 'id', 'v', "'v'")} * 6.283185307179586::DOUBLE AS a FROM ({t.PLACES_SQL}), (SELECT unnest(range(0, 4)) AS v))
      SELECT CASE WHEN v = 0 THEN id::VARCHAR ELSE id || '_g' || lpad(v::VARCHAR, 3, '0') END AS id, round(CASE WHEN v = 0 THEN lat ELSE greatest(-89.0, least(89.0, lat + far * sin(a) / 111320.0::DOUBLE)) END, 6) AS lat,
      round(CASE WHEN v = 0 THEN lon ELSE greatest(-180.0, least(180.0, lon + far * cos(a) / (greatest(cos(radians(lat)), 1e-6) * 111320.0::DOUBLE))) END, 6) AS lon FROM p""",
    "geo_decoys": f"SELECT id, round({_DC_LAT}, 6) AS ai_lat, round({_DC_LON}, 6) AS ai_lon FROM ({t.PLACES_SQL})",
    "geo_random_guesses": f"SELECT id, round({_RG_LAT}, 6) AS ai_lat, round({_RG_LON}, 6) AS ai_lon FROM ({t.PLACES_SQL})",
    "geo_guess_range": f"WITH g AS (SELECT id, lat, lon, {_RG_LAT} AS lat2, {_RG_LON} AS lon2 FROM ({t.PLACES_SQL})) SELECT id, round({_KM}, 6) AS km FROM g WHERE {_KM} < 50 OR {_KM} > 350",
    "geo_sane_coordinates": f"WITH p AS (SELECT *, id % 9 = 0 OR {_KM} > 2500 AS bad FROM {PAIRS}) SELECT id, round(CASE WHEN bad THEN lat ELSE lat2 END, 6) AS lat, round(CASE WHEN bad THEN lon ELSE lon2 END, 6) AS lon, bad AS replaced FROM p",
    "geo_parse_coordinates": f"SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE (id % 80) + 0.5::DOUBLE END AS lat, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL ELSE round(lon, 6) END AS lon FROM ({t.PLACES_SQL})",
    "geo_near_pairs": f"WITH x AS (SELECT p.id AS id_a, f.feature_id AS id_b, {t.haversine_sql('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km FROM ({t.PLACES_SQL}) p, ({t.FEATURES_SQL}) f) SELECT id_a, id_b, round(km, 6) AS km FROM x WHERE km <= 250",
    "geo_nearest_feature": f"WITH x AS (SELECT p.id, f.feature_id, {t.haversine_sql('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km FROM ({t.PLACES_SQL}) p, ({t.FEATURES_SQL}) f) SELECT id, arg_min(feature_id, (km, feature_id)) AS feature_id, round(min(km), 6) AS km FROM x GROUP BY id",
    "geo_closest_pair": f"SELECT round(min({t.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 6) AS km FROM ({t.FEATURES_SQL}) a, ({t.FEATURES_SQL}) b WHERE a.feature_id < b.feature_id",
    "geo_first_far_pair": f"""WITH x AS (SELECT a.feature_id % 20 AS job, a.feature_id AS pos_a, b.feature_id AS pos_b, {t.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM ({t.FEATURES_SQL}) a, ({t.FEATURES_SQL}) b WHERE a.feature_id % 20 = b.feature_id % 20 AND a.feature_id < b.feature_id)
      SELECT job, pos_a, pos_b, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos_a, pos_b) AS r FROM x WHERE km > 4000) WHERE r = 1""",
    "geo_points_in_polygons": f"WITH g AS ({_DIAMONDS}), hit AS ({_HELD}) SELECT id, arg_min(polygon_id, (area, polygon_id)) AS polygon_id FROM hit GROUP BY id",
    "geo_country_of": f"""WITH g AS ({_DIAMONDS}), hit AS ({_HELD}), p AS ({t.PLACES_SQL}), i AS (SELECT id, arg_min(polygon_id, (area, polygon_id)) AS polygon_id, 'inside' AS how FROM hit GROUP BY id),
      far AS (SELECT p.id, g.polygon_id, {t.haversine_sql('p.lat', 'p.lon', 'g.y', '(g.x + (4.0::DOUBLE / 9) / (1.5::DOUBLE + 2.0::DOUBLE / 9) * g.h)')} AS km FROM p ANTI JOIN i ON p.id = i.id JOIN g ON p.id % 13 != 0 AND g.code = 'C' || (p.id % 12))
      SELECT * FROM i UNION ALL SELECT id, arg_min(polygon_id, (km, polygon_id)), 'nearest' FROM far GROUP BY id""",
    "geo_nearest_line": f"WITH p AS ({t.PLACES_SQL}), {_arcs('l', _RIVERS)} SELECT id, arg_min(line_id, (km, line_id)) AS line_id, round(min(km), 6) AS km FROM l_km GROUP BY id",
    "geo_coast_distance": f"WITH p AS ({t.PLACES_SQL}), {_arcs('l', _COASTS)} SELECT id, round(min(km), 6) AS km FROM l_km GROUP BY id",
    "geo_location_context": f"""WITH p AS ({t.PLACES_SQL}), {_arcs('r', _RIVERS)}, {_arcs('c', _COASTS)}, g AS ({_DIAMONDS}), hit AS ({_HELD}),
      i AS (SELECT id, arg_min(polygon_id, (area, polygon_id)) AS polygon_id FROM hit GROUP BY id), r AS (SELECT id, arg_min(line_id, (km, line_id)) AS river_id, min(km) AS river_km FROM r_km GROUP BY id),
      c AS (SELECT id, min(km) AS coast_km FROM c_km GROUP BY id)
      SELECT id, polygon_id, river_id, round(river_km, 3) AS river_km, round(coast_km, 3) AS coast_km,
      CASE WHEN abs(lat) < 23.5 THEN 'low_latitudes_tropical_subtropical' WHEN abs(lat) < 50 THEN 'mid_latitudes_temperate' WHEN abs(lat) < 66.5 THEN 'high_mid_latitudes_cool_temperate' ELSE 'polar_subpolar' END AS band,
      CASE WHEN river_km < 3 THEN 'immediate' WHEN river_km < 15 THEN 'near' WHEN river_km < 60 THEN 'regional' ELSE 'distant' END AS river,
      CASE WHEN coast_km < 25 THEN 'sea_adjacent' WHEN coast_km < 100 THEN 'near_coast' WHEN coast_km < 400 THEN 'midcontinent' ELSE 'distant_maritime' END AS coast
      FROM p LEFT JOIN i USING (id) LEFT JOIN r USING (id) LEFT JOIN c USING (id)""",
    "geo_spread_sample": _spread_sql(8, 500.0),
    "geo_spaced_sample": f"""WITH o AS (SELECT list({{'id': id, 'lat': lat, 'lon': lon}} ORDER BY sha256('spaced|' || id), id) AS l FROM ({t.PLACES_SQL})),
      k AS (SELECT list_reduce(list_transform(l, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: {t.haversine_sql('y.lat', 'y.lon', 'x[1].lat', 'x[1].lon')} < 150)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM o)
      SELECT s.id, s.lat, s.lon FROM (SELECT unnest(kept) AS s FROM k)""",
    "geo_merged_guesses": f"""WITH p AS (SELECT map_id, id AS location_id, lat, lon FROM ({t.PLACES_SQL})), j AS (SELECT p.*, b.lat AS b_lat, o.lat AS o_lat, {t.haversine_sql('b.lat', 'p.lon', 'o.lat', 'p.lon')} AS km FROM p
      LEFT JOIN (SELECT * FROM p WHERE location_id % 3 != 0) b USING (location_id) LEFT JOIN (SELECT location_id, lat + location_id % 3 AS lat FROM p WHERE location_id % 4 = 0) o USING (location_id))
      SELECT map_id, location_id, round(coalesce(b_lat, o_lat), 6) AS lat, CASE WHEN b_lat IS NULL AND o_lat IS NULL THEN NULL ELSE round(lon, 6) END AS lon, CASE WHEN b_lat IS NULL AND o_lat IS NOT NULL THEN 'overlay' WHEN b_lat IS NULL THEN 'missing' WHEN o_lat IS NOT NULL AND km > 100 THEN 'conflict' ELSE 'base' END AS status FROM j""",
}
