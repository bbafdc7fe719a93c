"""Joins beyond plain equality: as-of pairs, near neighbours, points in polygons and lookups with fallbacks.

Places are joined through a grid of cells, so that only rows of neighbouring cells meet. Where many rows share
a cell, the side that is looked up is spread by the cells it covers and Spark splits the other side itself.
"""

from __future__ import annotations

from math import pi, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def fallback_lookup(df: DataFrame, table: DataFrame, keys: list[Column], key: str, value: str) -> DataFrame:
    """df with the value of the first of several keys that the table has; the table's keys are unique."""
    found = []
    for i, k in enumerate(keys):
        t = table.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        df = df.join(t, k == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return df.withColumn(value, F.coalesce(*found)).drop(*[f"__v{i}" for i in range(len(keys))])


def wildcard_lookup(df: DataFrame, table: DataFrame, exact: list[str], wild: str, value: str) -> DataFrame:
    """df with the table's value for its exact keys, or else for the same keys with a null in column wild, and which of the two it was."""
    t = table.select(*exact, value)
    full = t.where(F.col(wild).isNotNull()).withColumnRenamed(value, "__exact")
    some = t.where(F.col(wild).isNull()).drop(wild).withColumnRenamed(value, "__wild")
    out = df.join(full, exact, "left").join(some, [k for k in exact if k != wild], "left")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__wild").isNotNull(), "wildcard").otherwise("none")
    return out.withColumn(value, F.coalesce("__exact", "__wild")).withColumn("matched", how).drop("__exact", "__wild")


def scene_pairs(events: DataFrame, scenes: DataFrame, *, key: str, before_days: int = 90, after_days: int = 60, most_cloud: float = 30.0, cloud_zero_is_missing: bool = False) -> DataFrame:
    """For each event the best scene before and after it.

    events have event_id, a key of the place and event_ts; scenes have scene_id, the key, scene_ts and cloud.
    A scene must be less cloudy than most_cloud and lie within the windows, by days. The best is the nearest in
    time, then the least cloudy, then (before the event) the later, (after it) the earlier, then the lesser id.
    Only the last scene up to an event and the first one from it on can be the best, of equal times the least cloudy. They are
    looked for among the scenes of the event's own day, and then in one row for each place and day; no event meets all scenes near it.
    cloud_zero_is_missing counts a cover of 0 as 100, as one source does.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cloud = F.when((F.col("cloud") == 0) & F.lit(cloud_zero_is_missing), 100.0).otherwise(F.coalesce("cloud", F.lit(100.0)))
    clear = scenes.where((F.coalesce("cloud", F.lit(100.0)) < most_cloud) & F.col(key).isNotNull() & F.col("scene_ts").isNotNull())
    s = clear.select(F.col(key).alias("k"), day("scene_ts").alias("d"), at("scene_ts").alias("at"), F.struct(cloud.alias("cloud"), F.col("scene_id").alias("id")).alias("x"))
    s = s.groupBy("k", "d", "at").agg(F.min("x").alias("x")).select("k", "d", "at", F.lit(None).cast(dict(events.dtypes)["event_id"]).alias("event_id"), F.struct("at", "d", "x.cloud", "x.id").alias("s"))
    e = events.where(F.col(key).isNotNull() & F.col("event_ts").isNotNull() & F.col("event_id").isNotNull())
    e = e.select(F.col(key).alias("k"), day("event_ts").alias("d"), at("event_ts").alias("at"), "event_id", F.lit(None).cast(dict(s.dtypes)["s"]).alias("s"))
    both = s.unionByName(e)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    up_to = lambda *order: Window.partitionBy("k", "d").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    beyond = lambda *order: Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("k", "d").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    days = days.select("k", "d", last("hi", beyond("d")).alias("day_before"), last("lo", beyond(F.desc("d"))).alias("day_after"))
    found = both.select("k", "d", "at", "event_id", last("s", up_to("at")).alias("p"), last("s", up_to(F.desc("at"))).alias("n")).where("event_id is not null").join(days, ["k", "d"])
    found = found.select("event_id", "d", "at", F.coalesce("p", "day_before").alias("p"), F.coalesce("n", "day_after").alias("n"))
    rank = lambda c, sign, low, high: F.when(F.col(f"{c}.d").between(F.col("d") - low, F.col("d") + high), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")), F.col(f"{c}.cloud"), sign * F.col(f"{c}.at"), F.col(f"{c}.id").alias("scene_id")))
    best = found.groupBy("event_id").agg(
        F.min(F.least(*[rank(c, -1, before_days, 0) for c in "pn"])).alias("b"),
        F.min(F.least(*[rank(c, 1, 0, after_days) for c in "pn"])).alias("a"),
    )
    return events.select("event_id").join(best, "event_id", "left").select("event_id", F.col("b.scene_id").alias("before_id"), F.col("a.scene_id").alias("after_id"))


def bitemporal(scenes: DataFrame, key: str, least_days: int = 21) -> DataFrame:
    """The earliest and the latest scene of each place, or why there is no pair: no_scene_pair or interval_too_short."""
    by = F.struct("scene_ts", "scene_id")
    ends = scenes.where(F.col("scene_ts").isNotNull()).groupBy(key).agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    days = F.datediff(F.col("hi.scene_ts"), F.col("lo.scene_ts"))
    reason = F.when(F.col("lo") == F.col("hi"), "no_scene_pair").when(days < least_days, "interval_too_short")
    return ends.select(key, F.when(reason.isNull(), F.col("lo.scene_id")).alias("early_id"), F.when(reason.isNull(), F.col("hi.scene_id")).alias("late_id"), days.alias("days"), reason.alias("reason"))


def cell_of(lat: Column, lon: Column, degrees: float) -> Column:
    """The id of a point's cell in a grid of so many degrees."""
    columns = int(360 // degrees) + 2
    return (F.floor((lat + 90.0) / degrees) * columns + F.floor((lon + 180.0) / degrees)).cast("long")


def cells_near(lat: Column, lon: Column, km: float, degrees: float) -> Column:
    """The cells that hold all points within so many km of a point, across the date line too; all columns near a pole."""
    rows, columns = int(180 // degrees) + 1, int(360 // degrees) + 2
    around = int(360 / degrees)
    reach = km / 111.0
    low = F.greatest(F.lit(0), F.floor((lat + 90.0 - reach) / degrees).cast("int"))
    high = F.least(F.lit(rows), F.floor((lat + 90.0 + reach) / degrees).cast("int"))
    shrink = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + reach)))
    wide = F.when(shrink * 180.0 > reach, F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.lit(reach * 0.0174532925) / shrink))) + 1e-6)).otherwise(180.0)
    left, right = F.floor((lon + 180.0 - wide) / degrees).cast("int"), F.floor((lon + 180.0 + wide) / degrees).cast("int")
    across = F.transform(F.sequence(left, F.least(right, left + around)), lambda x: F.pmod(x, F.lit(around)))
    # The last column, of longitude 180 itself, belongs to both sides.
    across = F.array_distinct(F.when(F.exists(across, lambda x: x == 0) | F.exists(across, lambda x: x == around - 1), F.concat(across, F.array(F.lit(around)))).otherwise(across))
    return F.flatten(F.transform(F.sequence(low, high), lambda r: F.transform(across, lambda c: (r * columns + c).cast("long"))))


def within_km(a: DataFrame, b: DataFrame, km: float, *, id_a: str = "id", id_b: str = "id", degrees: float | None = None) -> DataFrame:
    """(id_a, id_b, km) for all pairs of places within so many km. Both sides have lat and lon; ids are renamed to id_a and id_b."""
    size = degrees or max(0.05, min(10.0, km / 55.0))
    left = a.select(F.col(id_a).alias("id_a"), F.col("lat").alias("__la"), F.col("lon").alias("__oa")).withColumn("__cell", F.explode(cells_near(F.col("__la"), F.col("__oa"), km, size)))
    right = b.select(F.col(id_b).alias("id_b"), F.col("lat").alias("__lb"), F.col("lon").alias("__ob")).withColumn("__cell", cell_of(F.col("__lb"), F.col("__ob"), size))
    far = geo.haversine_km(F.col("__la"), F.col("__oa"), F.col("__lb"), F.col("__ob"))
    return left.join(right, "__cell").withColumn("km", far).where(F.col("km") <= km).select("id_a", "id_b", "km")


#: Ids of one position in a row, and of a cell's side in a tile, at most; pairs of ids that may be near for each task, about. Results don't depend on these.
TILE, TASK_PAIRS = 4096, 16_000_000


def _positions(df: DataFrame, key: str) -> DataFrame:
    """(lat, lon, x, y, z, ids, n): the positions of places, on the unit sphere too, with their n ids; a position of very many has several rows."""
    from .frames import checkpointed

    rows = df.select(F.struct(F.col(key).alias("id")).alias("id"), "lat", "lon").where("lat is not null and lon is not null")
    crowded = rows.groupBy("lat", "lon").agg(F.ceil(F.count("*") / TILE).alias("of")).where("of > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("of", F.lit(1)))
    made = rows.join(F.broadcast(crowded), ["lat", "lon"], "left").groupBy("lat", "lon", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    a, o = F.radians("lat"), F.radians("lon")
    return checkpointed(made.select("lat", "lon", (F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"), "ids", F.size("ids").alias("n")))


def near_pairs(a: DataFrame, b: DataFrame, km: float, *, id_a: str = "id", id_b: str = "id", degrees: float | None = None) -> DataFrame:
    """within_km for many places: as many tasks as there are pairs to make, however these are spread, and one distance for each two positions.

    The pairs that come out can grow with the product of both sides; a task's share of them doesn't. Cells with many places on both sides are cut into tiles.
    """
    from .frames import checkpointed

    size = degrees or max(0.05, min(10.0, km / 110.0))
    sides = {"a": _positions(a, id_a), "b": _positions(b, id_b)}
    # The side of fewer positions goes to all cells around each.
    around = min(sides, key=lambda s: sides[s].count())
    in_cells = {s: rows.withColumn("cell", F.explode(cells_near(F.col("lat"), F.col("lon"), km, size)) if s == around else cell_of(F.col("lat"), F.col("lon"), size)) for s, rows in sides.items()}
    held = {s: rows.groupBy("cell").agg(F.sum("n").alias(f"n_{s}")) for s, rows in in_cells.items()}
    cells = checkpointed(held["a"].join(held["b"], "cell"))
    pairs = cells.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0.0
    context, conf = a.sparkSession.sparkContext, a.sparkSession.conf
    tasks = max(context.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")), int(pairs / TASK_PAIRS))

    def tiled(own: str, other: str) -> DataFrame:
        """The rows of a side, in each tile that they belong to."""
        tiles = lambda s: F.ceil(F.col(f"n_{s}") / TILE).cast("int")
        at = {own: F.pmod(F.xxhash64("lat", "lon", "ids"), tiles(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), tiles(other) - 1))}
        rows = in_cells[own].join(cells, "cell").select("cell", at["a"].alias("tile_a"), at["b"].alias("tile_b"), F.struct("lat", "lon", "x", "y", "z", "ids").alias(own))
        return rows.repartition(tasks, "cell", "tile_a", "tile_b")

    # Straight through the globe first, which is cheap: a little too much stays.
    straight = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz"), F.lit(0.0))
    most = (2 * sin(min(km / (2 * geo.RADIUS_KM), pi / 2))) ** 2 + 1e-9
    met = tiled("a", "b").join(tiled("b", "a"), ["cell", "tile_a", "tile_b"]).where(straight <= most)
    far = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    near = met.select(F.col("a.ids").alias("a"), F.col("b.ids").alias("b"), far.alias("km")).where(F.col("km") <= km)
    return near.select(F.explode("a").alias("a"), "b", "km").select("a", F.explode("b").alias("b"), "km").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "km")


def nearest(places: DataFrame, features: DataFrame, *, place: str = "id", feature: str = "feature_id", start_km: float = 50.0) -> DataFrame:
    """(place, feature, km): the nearest feature of each place. Ties go to the lesser feature id.

    Each position that places share finds the few features that may be nearest by pairs of cubes (close.candidates), so a place far from all features doesn't meet all of them.
    Places without coordinates have no row. start_km was the first radius of a search by rings; it has no effect.
    """
    from .close import candidates
    from .frames import checkpointed

    rows = places.select(F.col(place).alias("__p"), "lat", "lon").where("lat is not null and lon is not null")
    # Of features at one point only the least can win.
    points = features.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min(feature).alias("id")).select(F.struct("id", F.col("lat").alias("y"), F.col("lon").alias("x")).alias("at"), "lat", "lon")
    met = candidates(rows.select("lat", "lon").distinct(), points, 0.0)
    far = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("at.y"), F.col("at.x"))
    best = checkpointed(met.groupBy("lat", "lon").agg(F.min(F.struct(far.alias("km"), F.col("at.id").alias("id"))).alias("d")))
    own = rows.join(best, ["lat", "lon"]).groupBy("__p").agg(F.min("d").alias("d"))
    return own.select(F.col("__p").alias(place), F.col("d.id").alias(feature), F.col("d.km").alias("km"))


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(id, polygon_id): for each point the smallest polygon that holds it or whose edge it lies on; no row without one.

    points: id, lat, lon. polygons: polygon_id, area and rings (array of rings of struct(x, y), x the longitude; holes and parts by the even-odd rule), or one ring alone.
    """
    from .areas import holding

    whole = polygons if "rings" in polygons.columns else polygons.withColumn("rings", F.array("ring"))
    return holding(points, whole).groupBy("id").agg(F.min_by("polygon_id", F.struct("area", "polygon_id")).alias("polygon_id"))


def merged_guesses(locations: DataFrame, base: DataFrame, overlay: DataFrame, *, prefer_overlay: bool, tolerance_km: float) -> DataFrame:
    """One guess for each location (map_id, location_id): from base, overlay or both.

    Where both have one, the overlay wins if preferred; else the base stays, and a conflict is told if they differ
    by more than the tolerance. A location in neither has status missing.
    """
    keys = ["map_id", "location_id"]
    b = base.select(*keys, F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    o = overlay.select(*keys, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    both = locations.select(*keys).join(b, keys, "left").join(o, keys, "left")
    apart = geo.haversine_km(F.col("b_lat"), F.col("b_lon"), F.col("o_lat"), F.col("o_lon"))
    use = F.col("o_lat").isNotNull() & (F.lit(prefer_overlay) | F.col("b_lat").isNull())
    status = F.when(use, "overlay").when(F.col("b_lat").isNull(), "missing").when(apart > tolerance_km, "conflict").otherwise("base")
    return both.select(*keys, F.when(use, F.col("o_lat")).otherwise(F.col("b_lat")).alias("lat"), F.when(use, F.col("o_lon")).otherwise(F.col("b_lon")).alias("lon"), status.alias("status"))
