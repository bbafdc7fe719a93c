"""Polygons with holes and many parts: which of them hold a place.

A polygon is cut into a quadtree of cells. A cell that no edge touches lies inside or outside as a whole and needs no test; any other keeps
the edges that touch it and whether its lower left corner is inside, so a place in it crosses a few edges on its way from that corner. A
country's outline is thus dealt to many rows, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .frames import checkpointed

#: Degrees of the largest cells; halvings of them at most; edges up to which a cell isn't cut further. Results don't depend on these.
LARGEST, HALVINGS, FEW_EDGES = 8.0, 8, 12

#: Fixed value: degrees from an edge within which a point lies on it.
NEAR = 1e-12

_EDGE = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def edges_of(rings: Column) -> Column:
    """All edges of an array of rings (arrays of struct(x, y), closed or not), without ones of no length and ones with a null."""
    def of(ring: Column) -> Column:
        return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))["x"].alias("bx"), F.coalesce(F.get(ring, i + 1), F.get(ring, F.lit(0)))["y"].alias("by")))

    usable = lambda ring: F.filter(F.coalesce(ring, F.array().cast("array<struct<x:double,y:double>>")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    all_ = F.flatten(F.transform(F.transform(rings, usable), of))
    return F.filter(all_, lambda e: (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))


def _side(e: Column, x: Column, y: Column) -> Column:
    """Twice the area between an edge and a point: negative right of the way from a to b, in degrees squared."""
    return (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])


def _above(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge that passes a point's longitude passes above the point.

    Where its bounds hold the point, this and _beyond() follow from the same sign, so a way that bends on the edge itself crosses it twice or not at all however _side() is rounded.
    """
    a, b = e["ay"] > y, e["by"] > y
    return F.when(a == b, a).otherwise((_side(e, x, y) >= 0) == (e["bx"] < e["ax"]))


def _beyond(e: Column, x: Column, y: Column) -> Column:
    """Whether an edge that passes a point's latitude passes to the right of the point."""
    a, b = e["ax"] > x, e["bx"] > x
    return F.when(a == b, a).otherwise((_side(e, x, y) >= 0) == (e["by"] > e["ay"]))


def _odd(edges: Column, crosses) -> Column:
    return F.size(F.filter(edges, crosses)) % 2 == 1


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule by a ray to the right over all edges."""
    return _odd(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & _beyond(e, x, y))


def changed_between(edges: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """Whether inside() differs between two points, by the edges crossed on a way up or down and then across.

    Points are taken a hair to the right and above of where they are, as the ray's rule has it, so corners and level edges count once.
    """
    up = _odd(edges, lambda e: ((e["ax"] > x0) != (e["bx"] > x0)) & (_above(e, x0, y0) != _above(e, x0, y)))
    across = _odd(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (_beyond(e, x0, y) != _beyond(e, x, y)))
    return up != across


def touches(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge, within the rounding of degrees: NEAR of it, up or across."""
    def on(e: Column) -> Column:
        level = F.abs(_side(e, x, y)) <= F.greatest(F.abs(e["bx"] - e["ax"]), F.abs(e["by"] - e["ay"])) * NEAR
        return level & x.between(F.least(e["ax"], e["bx"]) - NEAR, F.greatest(e["ax"], e["bx"]) + NEAR) & y.between(F.least(e["ay"], e["by"]) - NEAR, F.greatest(e["ay"], e["by"]) + NEAR)

    return F.exists(edges, on)


def _touching(edges: Column, x0: Column, y0: Column, size: float) -> Column:
    """The edges that may touch a cell: their bounds meet it and its corners aren't all on one side of them."""
    hair = 1e-9
    x1, y1 = x0 + (size + hair), y0 + (size + hair)
    x0, y0 = x0 - hair, y0 - hair

    def meets(e: Column) -> Column:
        bounds = (F.least(e["ax"], e["bx"]) <= x1) & (F.greatest(e["ax"], e["bx"]) >= x0) & (F.least(e["ay"], e["by"]) <= y1) & (F.greatest(e["ay"], e["by"]) >= y0)
        corners = [_side(e, x, y) for x in (x0, x1) for y in (y0, y1)]
        return bounds & (F.least(*corners) <= hair) & (F.greatest(*corners) >= -hair)

    return F.filter(edges, meets)


def cover(polygons: DataFrame, *, largest: float = LARGEST, halvings: int = HALVINGS, few: int = FEW_EDGES) -> DataFrame:
    """(polygon_id, area, level, ix, iy, corner_in, edges): the cells of polygons (polygon_id, area, rings) that hold some of them.

    A cell without edges is inside as a whole. Polygons of no edges have no cells.
    """
    at = lambda v, shift: F.floor((v + shift) / largest).cast("long")
    start = polygons.select("polygon_id", "area", edges_of(F.col("rings")).alias("edges")).where(F.size("edges") > 0)
    ends = lambda a, b, f: f(F.flatten(F.transform("edges", lambda e: F.array(e[a], e[b]))))
    start = start.withColumn("ix", F.explode(F.sequence(at(ends("ax", "bx", F.array_min), 180.0), at(ends("ax", "bx", F.array_max), 180.0)))).withColumn("iy", F.explode(F.sequence(at(ends("ay", "by", F.array_min), 90.0), at(ends("ay", "by", F.array_max), 90.0))))
    x0, y0 = lambda size: F.col("ix") * size - 180.0, lambda size: F.col("iy") * size - 90.0
    cells = start.select("polygon_id", "area", F.lit(0).alias("level"), "ix", "iy", inside(F.col("edges"), x0(largest), y0(largest)).alias("corner_in"), _touching(F.col("edges"), x0(largest), y0(largest), largest).alias("edges"))
    some = (F.size("edges") > 0) | F.col("corner_in")
    cells, done = checkpointed(cells.where(some)), None
    for level in range(1, halvings + 1):
        if cells.where(F.size("edges") > few).isEmpty():
            break
        leaves = cells.where(F.size("edges") <= few)
        done = leaves if done is None else done.unionByName(leaves)
        size = largest / 2**level
        half = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        cut = cells.where(F.size("edges") > few).withColumn("half", half).withColumn("from_x", x0(2 * size)).withColumn("from_y", y0(2 * size))
        cut = cut.withColumn("ix", 2 * F.col("ix") + F.col("half.i")).withColumn("iy", 2 * F.col("iy") + F.col("half.j"))
        corner = F.col("corner_in") != changed_between(F.col("edges"), F.col("from_x"), F.col("from_y"), x0(size), y0(size))
        cells = checkpointed(cut.select("polygon_id", "area", F.lit(level).alias("level"), "ix", "iy", corner.alias("corner_in"), _touching(F.col("edges"), x0(size), y0(size), size).alias("edges")).where(some))
    return cells if done is None else done.unionByName(cells)


def holding(points: DataFrame, polygons: DataFrame, *, largest: float = LARGEST, halvings: int = HALVINGS, few: int = FEW_EDGES) -> DataFrame:
    """(id, polygon_id) for all points (id, lat, lon) and the polygons (polygon_id, area, rings) that hold them or on whose edge they lie, with the area.

    Points without coordinates are in none.
    """
    cells = cover(polygons, largest=largest, halvings=halvings, few=few)  # a union of checkpoints
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # at most halvings + 1
    known = points.select("id", "lat", "lon").where("lat is not null and lon is not null")
    if not levels:
        return known.join(cells.select("polygon_id", "area").limit(0), F.lit(True)).select("id", "polygon_id", "area").limit(0)
    at = lambda v, shift, level: F.floor((v + shift) / (largest / 2**level)).cast("long")
    places = F.array(*[F.struct(F.lit(v).alias("level"), at(F.col("lon"), 180.0, v).alias("ix"), at(F.col("lat"), 90.0, v).alias("iy")) for v in levels])
    dealt = known.select("id", "lat", "lon", F.explode(places).alias("c")).select("id", "lat", "lon", "c.*")
    size = F.lit(largest) / F.pow(F.lit(2.0), F.col("level"))
    x, y = F.col("lon"), F.col("lat")
    held = (F.col("corner_in") != changed_between(F.col("edges"), F.col("ix") * size - 180.0, F.col("iy") * size - 90.0, x, y)) | touches(F.col("edges"), x, y)
    return dealt.join(cells, ["level", "ix", "iy"]).where((F.size("edges") == 0) | held).select("id", "polygon_id", "area")


def centroid(rings: Column) -> Column:
    """struct(lat, lon) of the middle of rings in degrees, by their signed areas: the first ring's way round is a part's, the other a hole's."""
    edges = edges_of(rings)
    sums = F.aggregate(
        edges,
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, e: F.struct(
            (s["a"] + e["ax"] * e["by"] - e["bx"] * e["ay"]).alias("a"),
            (s["x"] + (e["ax"] + e["bx"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("x"),
            (s["y"] + (e["ay"] + e["by"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"])).alias("y"),
        ),
        lambda s: F.struct(F.try_divide(s["y"], 3 * s["a"]).alias("lat"), F.try_divide(s["x"], 3 * s["a"]).alias("lon")),
    )
    return sums


def with_code(points: DataFrame, polygons: DataFrame, **how) -> DataFrame:
    """(id, polygon_id, how): the smallest polygon that holds a point (how: inside), or for points in none the one of the point's code whose middle is nearest (nearest).

    points: id, lat, lon, code. polygons: polygon_id, area, rings, code. Codes are compared without spaces around and in upper case; a point in no polygon whose code no polygon has
    isn't in the result. Ties go to the lesser id.
    """
    best = F.min_by("polygon_id", F.struct("area", "polygon_id"))
    inside_ = checkpointed(holding(points, polygons, **how).groupBy("id").agg(best.alias("polygon_id")).withColumn("how", F.lit("inside")))
    code = F.nullif(F.upper(F.trim("code")), F.lit(""))
    rest = points.where("lat is not null and lon is not null").join(inside_.select("id"), "id", "left_anti").select("id", "lat", "lon", code.alias("code"))
    middles = polygons.select("polygon_id", code.alias("code"), centroid(F.col("rings")).alias("m")).where("m.lat is not null")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("m.lat"), F.col("m.lon"))
    near = rest.join(middles, "code").groupBy("id").agg(F.min_by("polygon_id", F.struct(km, F.col("polygon_id"))).alias("polygon_id")).withColumn("how", F.lit("nearest"))
    return inside_.unionByName(near)
