"""Distances from places to lines (rivers, lake shores, coasts), on the sphere.

A line is a path of great-circle arcs. Points sampled from the arcs stand for them: by these each position that places share finds the few arcs that may be the
nearest (close.candidates), and only those are measured. The step between samples follows from the length of all arcs, so they are a few for each arc, however many the positions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .close import candidates
from .frames import checkpointed, dealt

#: The least step between samples in kilometres; samples for each arc, about. Results don't depend on these.
SMALLEST_KM, SAMPLES = 0.01, 8


def _vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A point of the unit sphere."""
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def _cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def arc_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance from a point to the arc between two others, which is less than half a circle.

    Where the point lies beside the arc it is the distance to the arc's circle, else to the nearer end. Arcs of no length are points.
    """
    p, a, b = _vector(lat, lon), _vector(lat1, lon1), _vector(lat2, lon2)
    n = _cross(a, b)
    size = F.sqrt(_dot(n, n))
    beside = (size > 1e-14) & (_dot(p, _cross(n, a)) >= 0) & (_dot(p, _cross(b, n)) >= 0)
    ends = F.least(geo.haversine_km(lat, lon, lat1, lon1), geo.haversine_km(lat, lon, lat2, lon2))
    return F.when(beside, F.abs(F.asin(geo.clip(_dot(p, n) / size, -1.0, 1.0))) * geo.RADIUS_KM).otherwise(ends)


def arcs(lines: DataFrame, *, line: str = "line_id", path: str = "path") -> DataFrame:
    """(line_id, arc): the arcs of lines, whose path is an array of struct(x, y), x the longitude; arc has lat1, lon1, lat2, lon2.

    Points with a null are left out; a path of one point is one arc of no length; an empty or null path has none.
    """
    points = F.filter(F.coalesce(F.col(path), F.array().cast("array<struct<x:double,y:double>>")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    known = lines.select(F.col(line).alias("line_id"), points.alias("p")).where(F.size("p") > 0)
    arc = lambda a, b: F.struct(a["y"].alias("lat1"), a["x"].alias("lon1"), b["y"].alias("lat2"), b["x"].alias("lon2"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("p") - 2)), lambda i: arc(F.col("p")[i], F.coalesce(F.get("p", i + 1), F.col("p")[i])))
    return known.select("line_id", F.explode(pairs).alias("arc"))


def sampled(arcs_: DataFrame, every_km: float) -> DataFrame:
    """arcs with lat and lon of points on them, the ends included, none farther than every_km from the next, and half the way between an arc's, half_km."""
    c = lambda n: F.col(f"arc.{n}")
    a, b = _vector(c("lat1"), c("lon1")), _vector(c("lat2"), c("lon2"))
    angle = geo.haversine_km(c("lat1"), c("lon1"), c("lat2"), c("lon2")) / geo.RADIUS_KM
    steps = F.ceil(angle * geo.RADIUS_KM / every_km).cast("int")
    rows = arcs_.withColumn("__angle", angle).withColumn("__n", steps).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    t = F.coalesce(F.try_divide(F.col("__i"), F.col("__n")), F.lit(0.0))
    # Even steps along the arc; ones without length stand still.
    wide = F.sin("__angle")
    wa = F.when(wide > 1e-14, F.sin((1 - t) * F.col("__angle")) / wide).otherwise(1 - t)
    wb = F.when(wide > 1e-14, F.sin(t * F.col("__angle")) / wide).otherwise(t)
    x, y, z = (wa * i + wb * j for i, j in zip(a, b, strict=True))
    return rows.withColumn("__v", F.struct(x.alias("x"), y.alias("y"), z.alias("z"))).select(*arcs_.columns, F.degrees(F.atan2(F.col("__v.z"), F.hypot("__v.x", "__v.y"))).alias("lat"), F.degrees(F.atan2(F.col("__v.y"), F.col("__v.x"))).alias("lon"), F.coalesce(F.try_divide(F.col("__angle") * (geo.RADIUS_KM / 2), F.col("__n")), F.lit(0.0)).alias("half_km"))


def nearest_line(places: DataFrame, lines: DataFrame, *, place: str = "id", line: str = "line_id", path: str = "path", degrees: float = 0.1) -> DataFrame:
    """(place, line, km): the nearest line of each place and the distance to it; ties go to the lesser line.

    Places without coordinates have no row, and where there are no lines no place has. Other columns aren't read. degrees is the size of
    cells that bounded places before and isn't used any more; results don't depend on it.
    """
    all_arcs = checkpointed(dealt(arcs(lines, line=line, path=path), "arc"))
    rows = places.select(F.col(place).alias("id"), "lat", "lon").where("lat is not null and lon is not null")
    positions = checkpointed(rows.select("lat", "lon").distinct())
    c = lambda n: F.col(f"arc.{n}")
    n_arcs, length = all_arcs.agg(F.count("*"), F.sum(geo.haversine_km(c("lat1"), c("lon1"), c("lat2"), c("lon2")))).first()
    if not n_arcs:
        return rows.select(F.col("id").alias(place), F.lit(None).cast(dict(all_arcs.dtypes)["line_id"]).alias(line), F.lit(None).cast("double").alias("km")).limit(0)
    # An arc's nearest point is within half a step of one of its samples; a short arc's steps are shorter.
    points = sampled(all_arcs, max(SMALLEST_KM, length / (SAMPLES * n_arcs)))
    close = candidates(positions, points.select(F.struct("line_id", "arc").alias("at"), "lat", "lon", "half_km"), F.col("half_km"))
    at = [F.col(f"at.arc.{n}") for n in ("lat1", "lon1", "lat2", "lon2")]
    best = close.groupBy("lat", "lon").agg(F.min(F.struct(arc_km(F.col("lat"), F.col("lon"), *at).alias("km"), F.col("at.line_id").alias("line"))).alias("d"))
    own = rows.join(best, ["lat", "lon"]).groupBy("id").agg(F.min("d").alias("d"))
    return own.select(F.col("id").alias(place), F.col("d.line").alias(line), F.col("d.km").alias("km"))
