"""Spherical geodesy as Column expressions: all of it stays in generated JVM code.

Angles are degrees and arguments come as (lat, lon). Any null argument gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in use (km), and metres per degree of latitude of the flat approximation.
RADIUS_KM = 6371.0
RADIUS_RANKED_KM = 6371.0088
METRES_PER_DEGREE = 111_320.0


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """value within bounds; null stays null, which least() and greatest() would pass over."""
    out = F.when(F.lit(False), value)
    if low is not None:
        out = out.when(value < low, F.lit(low))
    if high is not None:
        out = out.when(value > high, F.lit(high))
    return out.otherwise(value)


def _chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The haversine of the central angle."""
    dlat, dlon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = RADIUS_KM) -> Column:
    """Great-circle distance; the arcsine form, whose argument never exceeds 1."""
    return F.asin(clip(F.sqrt(_chord(lat1, lon1, lat2, lon2)), high=1.0)) * (2 * radius_km)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_m: float = RADIUS_KM * 1000) -> Column:
    """Great-circle distance in metres; the arctangent form, exact near antipodes."""
    h = _chord(lat1, lon1, lat2, lon2)
    return F.atan2(F.sqrt(h), F.sqrt(clip(1 - h, low=0.0))) * (2 * radius_m)


def clamp_distance(distance: Column, most: float | None) -> Column:
    """distance, at most so much; without a bound distance itself."""
    return distance if most is None else clip(distance, high=float(most))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point to the second, clockwise from north, in [0, 360)."""
    turn = F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, course: Column, distance_km: Column, radius_km: float = RADIUS_KM) -> Column:
    """struct(lat, lon) after so many km along a course; a negative distance is an error."""
    far = F.when(distance_km < 0, F.raise_error(F.lit("distance_km must not be negative")).cast("double")).otherwise(distance_km) / radius_km
    up = F.sin(F.radians(lat)) * F.cos(far) + F.cos(F.radians(lat)) * F.sin(far) * F.cos(F.radians(course))
    to_lat = F.asin(clip(up, -1.0, 1.0))
    turn = F.atan2(F.sin(F.radians(course)) * F.sin(far) * F.cos(F.radians(lat)), F.cos(far) - F.sin(F.radians(lat)) * F.sin(to_lat))
    return F.struct(
        clip(F.degrees(to_lat), -90.0, 90.0).alias("lat"),
        (F.pmod(F.degrees(F.radians(lon) + turn) + 540.0, F.lit(360.0)) - 180.0).alias("lon"),
    )


def box_around(lat: Column, lon: Column, half_km: Column | float, radius_km: float = RADIUS_KM) -> Column:
    """struct(west, south, east, north) so many km to each side, on the sphere, not clipped."""
    half = half_km if isinstance(half_km, Column) else F.lit(float(half_km))
    tall = F.degrees(half / radius_km)
    shrink = F.cos(F.radians(lat))
    wide = F.when(F.abs(shrink) > 1e-9, F.degrees(half / (shrink * radius_km))).otherwise(tall)
    return F.struct((lon - wide).alias("west"), (lat - tall).alias("south"), (lon + wide).alias("east"), (lat + tall).alias("north"))


def box_around_flat(lat: Column, lon: Column, half_km: float) -> Column:
    """struct(west, south, east, north) by metres per degree, clipped to the world."""
    if half_km <= 0:
        raise ValueError("half_km must be positive")
    tall = F.lit(half_km * 1000.0 / METRES_PER_DEGREE)
    wide = half_km * 1000.0 / (clip(F.cos(F.radians(lat)), low=1e-6) * METRES_PER_DEGREE)
    return F.struct(
        clip(lon - wide, low=-180.0).alias("west"),
        clip(lat - tall, low=-90.0).alias("south"),
        clip(lon + wide, high=180.0).alias("east"),
        clip(lat + tall, high=90.0).alias("north"),
    )


def in_box(lat: Column, lon: Column, box: Column, margin: float = 0.0) -> Column:
    return lat.between(box["south"] - margin, box["north"] + margin) & lon.between(box["west"] - margin, box["east"] + margin)


def utm_epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone; zones stay within 1 and 60."""
    zone = clip((F.floor((lon + 180.0) / 6.0) + 1).cast("int"), 1, 60)
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def projected_epsg(lat: Column, lon: Column) -> Column:
    """UTM where it is defined, else (beyond 84 degrees) Web Mercator."""
    return F.when(F.abs(lat) > 84.0, F.lit(3857)).otherwise(utm_epsg(lat, lon))


def web_mercator(lat: Column, lon: Column) -> Column:
    """struct(x, y) in metres, EPSG:3857."""
    r = 6378137.0
    return F.struct((F.radians(lon) * r).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * r).alias("y"))


def chip_transform(box: Column, width: int, height: int) -> Column:
    """Affine coefficients (a, b, c, d, e, f) from pixels of a chip to Web Mercator metres over a box."""
    low, high = web_mercator(box["south"], box["west"]), web_mercator(box["north"], box["east"])
    zero = F.lit(0.0)
    return F.array((high["x"] - low["x"]) / width, zero, low["x"], zero, (low["y"] - high["y"]) / height, high["y"])


def reference_grid(lat: Column, lon: Column, box: Column, resolution_m: float) -> Column:
    """struct(epsg, width, height) of a pixel grid over a box, in metres near its anchor (flat approximation)."""
    wide = (box["east"] - box["west"]) * METRES_PER_DEGREE * F.cos(F.radians(lat))
    tall = (box["north"] - box["south"]) * METRES_PER_DEGREE
    return F.struct(
        utm_epsg(lat, lon).alias("epsg"),
        clip(F.ceil(wide / resolution_m).cast("int"), low=1).alias("width"),
        clip(F.ceil(tall / resolution_m).cast("int"), low=1).alias("height"),
    )


def offset_in_disk(lat: Column, lon: Column, radius_m: float, u: Column, v: Column) -> Column:
    """struct(lat, lon, east_m, north_m): a point uniform in a disk, from two uniform numbers in [0, 1)."""
    far, angle = F.sqrt(u) * radius_m, v * 6.283185307179586
    east, north = far * F.cos(angle), far * F.sin(angle)
    shrink = clip(F.cos(F.radians(lat)), low=1e-6)
    return F.struct(
        clip(lat + north / METRES_PER_DEGREE, -89.0, 89.0).alias("lat"),
        clip(lon + east / (shrink * METRES_PER_DEGREE), -180.0, 180.0).alias("lon"),
        east.alias("east_m"),
        north.alias("north_m"),
    )


def street_offset(lat: Column, lon: Column, radius_m: float, u: Column, v: Column) -> Column:
    """struct(lat, lon): the same by course and distance on the sphere."""
    return destination(lat, lon, v * 360.0, F.sqrt(u) * (radius_m / 1000.0))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) set by the parts: the first 32 bits of the SHA-256 of their texts, joined by bars."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def score_ranked(distance_km: Column) -> Column:
    """Whole points, a million at no distance and falling with its inverse."""
    return F.when(distance_km <= 0, F.lit(1_000_000)).otherwise(clip((1_000_000 / (distance_km + 1.0)).cast("int"), 0, 1_000_000))


def score_casual(distance_km: Column) -> Column:
    """Whole points, 5000 at no distance and 2.8 fewer a km, halves up."""
    return F.floor(clip(5000.0 - distance_km * 2.8, low=0.0) + 0.5).cast("int")


def hemisphere(lat: Column) -> Column:
    return F.when(lat >= 0, F.lit("Northern")).when(lat < 0, F.lit("Southern"))


def _ladder(value: Column, steps: list[tuple[float, str]], beyond: str) -> Column:
    out = F.when(value < steps[0][0], F.lit(steps[0][1]))
    for bound, name in steps[1:]:
        out = out.when(value < bound, F.lit(name))
    return out.when(value.isNotNull(), F.lit(beyond))


# Names and bounds of the bands.
LATITUDE_BANDS = [(23.5, "low_latitudes_tropical_subtropical"), (50.0, "mid_latitudes_temperate"), (66.5, "high_mid_latitudes_cool_temperate")]
FEATURE_BANDS = [(3.0, "immediate"), (15.0, "near"), (60.0, "regional")]
COAST_BANDS = [(25.0, "sea_adjacent"), (100.0, "near_coast"), (400.0, "midcontinent")]


def latitude_band(lat: Column) -> Column:
    return _ladder(F.abs(lat), LATITUDE_BANDS, "polar_subpolar")


def feature_proximity(distance_km: Column, has_name: Column) -> Column:
    return F.when(has_name & distance_km.isNotNull(), _ladder(distance_km, FEATURE_BANDS, "distant")).otherwise("none")


def coast_proximity(distance_km: Column) -> Column:
    return F.coalesce(_ladder(distance_km, COAST_BANDS, "distant_maritime"), F.lit("unknown"))


def search_radius_m(half_km: Column, most_km: float, scale: float) -> Column:
    """Metres around a place to search: scale times its half extent, at most most_km, at least 1 km; without an extent most_km."""
    km = F.when(half_km > 0, F.least(F.lit(float(most_km)), half_km * scale)).otherwise(F.lit(float(most_km)))
    return F.greatest(F.lit(1000.0), km * 1000.0)


def three_levels(score: Column, high: float, medium: float) -> Column:
    """high, medium or low by two bounds."""
    return F.when(score >= high, F.lit("high")).when(score >= medium, F.lit("medium")).when(score.isNotNull(), F.lit("low"))


def hotspot_confidence(score: Column) -> Column:
    return three_levels(score, 0.35, 0.18)


def candidate_confidence(score: Column) -> Column:
    return three_levels(score, 0.82, 0.55)


def parse_coordinate(value: Column) -> Column:
    """A finite number from a number or a text, else null."""
    number = F.trim(value.cast("string")).try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")), number)


def parse_lat_lon(lats: list[Column], lons: list[Column]) -> Column:
    """struct(lat, lon) from the first of several columns that holds a number, or null when it is out of range."""
    lat, lon = F.coalesce(*[parse_coordinate(c) for c in lats]), F.coalesce(*[parse_coordinate(c) for c in lons])
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def sane_coordinates(lat: Column, lon: Column, asked_lat: Column, asked_lon: Column, most_km: float = 250.0) -> Column:
    """struct(lat, lon, replaced): decoded coordinates, or those asked for where the former drift too far or are missing."""
    drift = haversine_km(lat, lon, asked_lat, asked_lon)
    bad = F.coalesce(drift > most_km, F.lit(True))
    return F.struct(F.when(bad, asked_lat).otherwise(lat).alias("lat"), F.when(bad, asked_lon).otherwise(lon).alias("lon"), bad.alias("replaced"))
