"""Samples of places that keep a distance from each other, and seeded choices, without a random state.

An order by a hash of seed and id takes the place of a shuffle, so results are the same however rows are dealt.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .frames import checkpointed, dealt, stored
from .joins import cell_of, within_km


def seeded(identifier: Column, seed: str) -> Column:
    """A text that orders ids like a shuffle by a seed."""
    return F.sha2(F.concat_ws("|", F.lit(seed), identifier.cast("string")), 256)


def shuffled_head(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in an order set by the seed: a top-k, which sends n rows a task at most."""
    return df.withColumn("__o", seeded(F.col(key), seed)).orderBy("__o", key).limit(n).drop("__o")


def selected(df: DataFrame, key: str, *, allow: DataFrame | None = None, seed: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key is in a list, in order of the key or of the seed, so many at most."""
    out = df if allow is None else df.join(allow.select(key), key, "left_semi")
    if limit is None:
        return out
    return shuffled_head(out, key, limit, seed) if seed is not None else out.orderBy(key).limit(limit)


#: Places of the first part of the walk, and how many times as long each next part is, about. Results don't depend on these.
FIRST_PART, LONGER = 4096, 8
#: Kept places of a part up to which they are sent to all tasks.
SENT = 20_000


def _walked(part: DataFrame, apart_km: float) -> DataFrame:
    """The ids that a walk keeps of a part's places (id, lat, lon, o), in rounds over all of them at once."""
    near = within_km(part, part, apart_km).where((F.col("id_a") != F.col("id_b")) & (F.col("km") < apart_km)).select("id_a", "id_b")
    orders = part.select("id", "o")
    # Only the edge from the later place to the earlier matters: the earlier may rule the later out.
    edges = checkpointed(near.join(orders.withColumnRenamed("id", "id_a").withColumnRenamed("o", "oa"), "id_a").join(orders.withColumnRenamed("id", "id_b").withColumnRenamed("o", "ob"), "id_b").where("ob < oa").select(F.col("id_a").alias("later"), F.col("id_b").alias("earlier")))
    undecided, kept = orders.select("id"), None
    while True:
        blocked = edges.select(F.col("later").alias("id")).distinct()
        now = undecided.join(blocked, "id", "left_anti")
        now = checkpointed(now)
        kept = now if kept is None else kept.unionByName(now)
        gone = checkpointed(edges.join(now.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct())
        undecided = checkpointed(undecided.join(now, "id", "left_anti").join(gone, "id", "left_anti"))
        if undecided.isEmpty():
            return kept
        rest = edges.join(gone.withColumnRenamed("id", "later"), "later", "left_anti").join(gone.withColumnRenamed("id", "earlier"), "earlier", "left_anti")
        edges = checkpointed(rest.join(now.withColumnRenamed("id", "earlier"), "earlier", "left_anti"))


def spaced(places: DataFrame, key: str, apart_km: float, seed: str) -> DataFrame:
    """The places (key, lat, lon) that a walk in seeded order keeps: each that is at least so far from all kept before.

    The walk is done in parts that grow, by the beginning of the seeded hash. Within a part a place is kept when no undecided place nearby comes before it, and what lies near
    a kept place goes, in rounds over all its places at once. Then all later places that lie near those kept go too. So crowded places never meet each other as pairs: the more
    of the walk is done, the fewer places of a neighbourhood are left. That gives the same places as the walk.
    """
    ordered = dealt(places.select(F.col(key).alias("id"), "lat", "lon")).withColumn("o", F.struct(seeded(F.col(key), seed).alias("h"), F.col(key).alias("k")))
    # The hash's first digits tell how far in the walk a place comes.
    undecided = checkpointed(ordered.withColumn("u", F.conv(F.substring("o.h", 1, 12), 16, 10).cast("double") / 2.0**48))
    share, kept = FIRST_PART / max(undecided.count(), 1), None
    while True:
        part = checkpointed(undecided.where(F.col("u") < share).drop("u"))
        now = checkpointed(_walked(part, apart_km))
        kept = now if kept is None else kept.unionByName(now)
        if share >= 1:
            break
        rest, by = undecided.where(F.col("u") >= share), part.join(now, "id", "left_semi")
        by = F.broadcast(by) if now.count() <= SENT else by
        gone = within_km(by, rest, apart_km).where((F.col("id_a") != F.col("id_b")) & (F.col("km") < apart_km)).select(F.col("id_b").alias("id")).distinct()
        undecided, share = checkpointed(rest.join(gone, "id", "left_anti")), share * LONGER
        if undecided.isEmpty():
            break
    return places.join(kept.withColumnRenamed("id", key), key, "left_semi")


def spaced_head(places: DataFrame, key: str, n: int, apart_km: float, seed: str) -> DataFrame:
    """The first n places that the walk keeps."""
    return shuffled_head(spaced(places, key, apart_km, seed), key, n, seed)


#: Degrees of the cells in which places are bounded together, and cells that are looked through at once. Results don't depend on these.
SPREAD_DEGREES, SPREAD_CELLS = 2.0, 16


def _km_on_driver(lat, lon, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    h = np.sin(np.radians(lats - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * geo.RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def spread(places: DataFrame, key: str, k: int, apart_km: float, seed: str) -> DataFrame:
    """k places (key, lat, lon, pick) picked one by one: the first by the seed, then always the one farthest from all picked, while it is at least so far.

    Places are written once, sorted by cell. The driver keeps for each cell, of which the grid has a fixed number, how far any of its places can be from all picks; that only
    falls. A pick reads the cells whose bound is highest until the best place found is above all other bounds, so it touches a few cells and not the rest. Ties go to the lesser key; places without coordinates
    are never picked; places of the same key or at a picked place end the picking where nothing else is left. The picks themselves, k rows, are held on the driver.
    """
    columns = int(360 // SPREAD_DEGREES) + 2
    half = SPREAD_DEGREES * 79.0 + 1e-3
    kinds = dict(places.dtypes)
    result = f"{key} {kinds[key]}, lat double, lon double, pick int"
    known = places.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat is not null and lon is not null")
    with stored(known.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), SPREAD_DEGREES)).repartitionByRange("cell").sortWithinPartitions("cell")) as rows:
        cells = np.array(sorted(r["cell"] for r in rows.select("cell").distinct().collect()), dtype=np.int64)  # at most as many as the grid has
        first = rows.agg(F.min_by(F.struct(key, "lat", "lon"), F.struct(seeded(F.col(key), seed), F.col(key))).alias("p")).first()["p"]
        picks = [] if first is None or k < 1 else [first]
        lats = np.minimum(90.0, (cells // columns + 0.5) * SPREAD_DEGREES - 90.0)
        lons = np.minimum(180.0, (cells % columns + 0.5) * SPREAD_DEGREES - 180.0)
        bound = np.full(len(cells), np.inf)
        best: list[tuple | None] = [None] * len(cells)  # of each cell its farthest place and how far that is, if that is known for all picks
        middles = np.empty((0, len(cells)))
        while picks and len(picks) < k:
            p = picks[-1]
            away = _km_on_driver(p["lat"], p["lon"], lats, lons)
            middles = np.vstack([middles, away])
            bound = np.minimum(bound, away + half)
            for i, b in enumerate(best):
                # A farthest place that the new pick isn't nearer to stays what it is.
                if b is not None and _km_on_driver(p["lat"], p["lon"], np.array([b[2]]), np.array([b[3]]))[0] <= b[0] + 1e-6:
                    best[i] = None
            while True:
                top = max((b[0] for b in best if b is not None), default=-1.0)
                stale = [i for i in np.argsort(-bound, kind="stable") if best[i] is None and bound[i] >= top][:SPREAD_CELLS]
                if not stale:
                    break
                # Only picks that may be the nearest to some place of a cell are measured there.
                near = [(int(cells[i]), [(float(picks[j]["lat"]), float(picks[j]["lon"])) for j in np.flatnonzero(middles[:, i] <= middles[:, i].min() + 2 * half)]) for i in stale]
                asked = F.broadcast(rows.sparkSession.createDataFrame(near, "cell long, picks array<struct<lat:double,lon:double>>"))
                km = F.array_min(F.transform("picks", lambda q: geo.haversine_km(q["lat"], q["lon"], F.col("lat"), F.col("lon"))))
                read = rows.where(F.col("cell").isin([c for c, _ in near])).join(asked, "cell").select("cell", F.struct((-km).alias("o"), F.col(key).alias("k"), "lat", "lon").alias("b"))
                for r in read.groupBy("cell").agg(F.min("b").alias("b")).collect():
                    i = int(np.searchsorted(cells, r["cell"]))
                    best[i] = (-r["b"]["o"], r["b"]["k"], r["b"]["lat"], r["b"]["lon"])
                    bound[i] = best[i][0]
            farthest = min((b for b in best if b is not None), key=lambda b: (-b[0], b[1]))
            if farthest[0] < apart_km or any(p[key] == farthest[1] for p in picks):
                break
            picks.append({key: farthest[1], "lat": farthest[2], "lon": farthest[3]})
    return places.sparkSession.createDataFrame([(p[key], float(p["lat"]), float(p["lon"]), i) for i, p in enumerate(picks)], result)


def select_places(places: DataFrame, key: str, k: int, apart_km: float, seed: str) -> DataFrame:
    """k places: the head of the seeded order without a distance to keep, else a spread."""
    return shuffled_head(places, key, k, seed) if apart_km <= 0 else spread(places, key, k, apart_km, seed)


def widest_separation(places: DataFrame, key: str, k: int, seed: str, high_km: float = 20_000.0, steps: int = 36) -> float:
    """The greatest distance, by bisection, at which k places can still be spread.

    The spread of k places without a bound falls from pick to pick, so its last distance is the answer for the
    greedy order; the bisection needs no further scans.
    """
    picks = spread(places, key, k, 0.0, seed).orderBy("pick").collect()
    if len(picks) < k:
        return 0.0
    from math import asin, cos, radians, sin, sqrt

    def km(a, b) -> float:
        h = sin(radians(b["lat"] - a["lat"]) / 2) ** 2 + cos(radians(a["lat"])) * cos(radians(b["lat"])) * sin(radians(b["lon"] - a["lon"]) / 2) ** 2
        return 2 * geo.RADIUS_KM * asin(min(1.0, sqrt(h)))

    least = min((min(km(picks[i], picks[j]) for j in range(i)) for i in range(1, k)), default=high_km)
    low, high = 0.0, high_km
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if least >= mid else (low, mid)
    return low


def jitter_variants(places: DataFrame, key: str, variants: int, radius_m: float, seed: str) -> DataFrame:
    """Each place and so many copies moved at random within a radius, with ids ending in _gNNN."""
    copies = places.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants))))
    u, v = (geo.hash_uniform(F.lit(seed), F.col(key), F.col("variant"), F.lit(t)) for t in ("u", "v"))
    at = geo.offset_in_disk(F.col("lat"), F.col("lon"), radius_m, u, v)
    moved = F.col("variant") > 0
    keep = [c for c in places.columns if c not in (key, "lat", "lon")]
    name = F.when(moved, F.concat(F.col(key).cast("string"), F.format_string("_g%03d", "variant"))).otherwise(F.col(key).cast("string"))
    return copies.select(name.alias(key), F.when(moved, at["lat"]).otherwise(F.col("lat")).alias("lat"), F.when(moved, at["lon"]).otherwise(F.col("lon")).alias("lon"), *keep)


def decoys(locations: DataFrame, km: float, course: float) -> DataFrame:
    """locations with a guess so far away on a fixed course."""
    at = geo.destination(F.col("lat"), F.col("lon"), F.lit(float(course)), F.lit(float(km)))
    return locations.withColumn("__g", at).select(*locations.columns, F.col("__g.lat").alias("ai_lat"), F.col("__g.lon").alias("ai_lon"))


def random_guesses(locations: DataFrame, key: str, least_km: float, most_km: float, seed: str) -> DataFrame:
    """locations with a guess at a random course and distance, set by a seed and the key."""
    u, v = (geo.hash_uniform(F.lit(seed), F.col(key), F.lit(t)) for t in ("km", "course"))
    at = geo.destination(F.col("lat"), F.col("lon"), v * 360.0, u * (most_km - least_km) + least_km)
    return locations.withColumn("__g", at).select(*locations.columns, F.col("__g.lat").alias("ai_lat"), F.col("__g.lon").alias("ai_lon"))


def out_of_range(guesses: DataFrame, least_km: float | None, most_km: float | None) -> DataFrame:
    """guesses with their distance whose distance from the truth is out of bounds."""
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("ai_lat"), F.col("ai_lon"))
    bad = F.lit(False)
    if least_km is not None:
        bad = bad | (F.col("km") < least_km)
    if most_km is not None:
        bad = bad | (F.col("km") > most_km)
    return guesses.withColumn("km", km).where(bad)
