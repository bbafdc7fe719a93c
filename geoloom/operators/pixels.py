"""Rasters as tables (tile, y, x and values by pixel): fractions, transitions, zones and regions.

All counts are aggregates that combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import raster


def class_fractions(pixels: DataFrame, tile: str, klass: str, *, nothing: int = raster.NOTHING, classes: int = 9) -> DataFrame:
    """(tile, class_id, n, fraction): the share of each class among a tile's pixels that hold something."""
    valid = pixels.where((F.col(klass) != nothing) & F.col(klass).between(0, classes - 1))
    counts = valid.groupBy(tile, F.col(klass).alias("class_id")).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(tile)), 6))


def scene_fractions(pixels: DataFrame, tile: str, scene_class: str) -> DataFrame:
    """The same from scene classes, over those that count as valid."""
    return class_fractions(pixels.withColumn("__c", raster.scene_land_cover(F.col(scene_class))).where("__c is not null"), tile, "__c")


def with_water_prior(tiles: DataFrame, fractions: DataFrame, tile: str, category: str) -> DataFrame:
    """(tile, class_id, fraction, tag): a tile's fractions (strict), all water for open-sea tiles without any (marine_water_prior), or a row of nulls (empty)."""
    joined = tiles.join(fractions.select(tile, "class_id", "fraction"), tile, "left")
    sea = F.lower(F.trim(F.col(category))).isin(raster.OPEN_WATER)
    none = F.col("class_id").isNull()
    return joined.select(tile, F.when(none & sea, 0).otherwise(F.col("class_id")).alias("class_id"), F.when(none & sea, 1.0).otherwise(F.col("fraction")).alias("fraction"), F.when(~none, "strict").when(sea, "marine_water_prior").otherwise("empty").alias("tag"))


def normalised_fractions(fractions: Column) -> Column:
    """A map of class id to share: below 0 counts as 0, shares sum to 1, zero shares go."""
    positive = F.map_filter(fractions, lambda k, v: k.between(0, len(raster.LAND_COVER) - 1) & (v > 0))
    total = F.aggregate(F.map_values(positive), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(positive, lambda k, v: F.bround(v / total, 6))


def dominant_classes(fractions: Column, most: int = 4) -> Column:
    """The classes of the greatest shares as structs (class_id, label, fraction), ties by id."""
    entries = F.transform(F.map_entries(normalised_fractions(fractions)), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("class_id")))
    return F.transform(F.slice(F.array_sort(entries), 1, most), lambda e: F.struct(e["class_id"].alias("class_id"), raster.land_cover_name(e["class_id"]).alias("label"), (-e["o"]).alias("fraction")))


def fraction_deltas(before: DataFrame, after: DataFrame, tile: str, least: float = 0.005) -> DataFrame:
    """(tile, class_id, before, after, delta, direction, magnitude) of classes whose share changed by so much; a missing class is 0."""
    b, a = (df.select(tile, "class_id", F.col("fraction").alias(n)) for df, n in ((before, "before"), (after, "after")))
    both = b.join(a, [tile, "class_id"], "full_outer").select(tile, "class_id", F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    delta = F.bround(F.col("after") - F.col("before"), 6)
    size = F.abs(F.col("delta"))
    out = both.withColumn("delta", delta).where(size >= least)
    return out.withColumn("direction", F.when(F.col("delta") > 0, "increase").otherwise("decrease")).withColumn("magnitude", F.when(size >= 0.12, "high").when(size >= 0.04, "medium").otherwise("low"))


def shifted(fractions: Column, raised: int, by: float, donors: tuple[int, ...]) -> Column:
    """A map of shares with one class raised by so much, taken from donors in order as far as they go."""
    base = normalised_fractions(fractions)
    start = F.struct(base.alias("m"), F.lit(float(by)).alias("rest"))

    def take(acc: Column, donor: Column) -> Column:
        have = F.coalesce(F.try_element_at(acc["m"], donor), F.lit(0.0))
        part = F.least(have, acc["rest"])
        return F.struct(F.transform_values(acc["m"], lambda k, v: F.when(k == donor, v - part).otherwise(v)).alias("m"), (acc["rest"] - part).alias("rest"))

    reduced = F.aggregate(F.array(*[F.lit(d) for d in donors]), start, take)["m"]
    others = F.map_filter(reduced, lambda k, v: k != raised)
    lifted = F.map_concat(others, F.create_map(F.lit(raised), F.coalesce(F.try_element_at(reduced, F.lit(raised)), F.lit(0.0)) + by))
    return F.when(F.size(base) > 0, normalised_fractions(lifted)).otherwise(normalised_fractions(F.create_map(F.lit(raised), F.lit(float(by)))))


# The class each analysis profile raises, by how much, and the classes that give.
PROFILE_SHIFTS = {
    "land_use_change": (6, 0.12, (1, 2, 5, 7, 4, 0, 8)),
    "wildfire": (7, 0.10, (1, 5, 2, 4, 6, 0, 8)),
    "flood_pulse": (0, 0.15, (2, 4, 5, 7, 6, 1, 8)),
    "oceanscout_ship_detection": (0, 0.06, (7, 2, 5, 6, 1, 4, 8)),
}


def profile_fractions(fractions: Column, profile: Column) -> Column:
    """Shares as an analysis profile changes them; other profiles leave them."""
    out = F.when(F.lit(False), fractions)
    for name, (raised, by, donors) in PROFILE_SHIFTS.items():
        out = out.when(profile == name, shifted(fractions, raised, by, donors))
    return out.otherwise(normalised_fractions(fractions))


def class_sample(fractions: Column, size: int = 32) -> Column:
    """Class ids in proportion to their shares, so many in all: rounded counts of at least one, the largest taking up what is missing, the smallest giving what is too many."""
    entries = F.array_sort(F.transform(F.map_entries(normalised_fractions(fractions)), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("id"))))
    counts = F.transform(entries, lambda e: F.struct(e["id"].alias("id"), F.greatest(F.lit(1), F.bround(-e["o"] * size, 0).cast("int")).alias("n")))

    def fixed(c: Column) -> Column:
        used = F.aggregate(c, F.lit(0), lambda s, x: s + x["n"])
        return F.transform(c, lambda x, i: F.array_repeat(x["id"].cast("double"), F.when((used < size) & (i == 0), x["n"] + size - used).when((used > size) & (i == F.size(c) - 1), F.greatest(F.lit(1), x["n"] - (used - size))).otherwise(x["n"])))

    return F.slice(F.flatten(F.transform(F.array(counts), fixed)[0]), 1, size)


def picked_class(fractions: Column, u: Column) -> Column:
    """The class at which the cumulated shares, in order of ids, exceed a number in [0, 1)."""
    entries = F.array_sort(F.transform(F.map_entries(normalised_fractions(fractions)), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("v"))))
    total = F.aggregate(entries, F.lit(0.0), lambda s, x: s + x["v"])
    start = F.struct(F.lit(0.0).alias("t"), F.lit(None).cast("int").alias("id"))
    walked = F.aggregate(entries, start, lambda acc, x: F.struct((acc["t"] + x["v"] / total).alias("t"), F.coalesce(acc["id"], F.when(u < acc["t"] + x["v"] / total, x["id"].cast("int"))).alias("id")))
    return F.coalesce(walked["id"], F.lit(len(raster.LAND_COVER) - 1))


def transitions(pixels: DataFrame, group: str, before: str, after: str, classes: int = 4) -> DataFrame:
    """(group, from_id, to_id, n, pct): the full matrix of class changes of each group, zeros too."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    counts = pixels.groupBy(group, F.col(before).alias("from_id"), F.col(after).alias("to_id")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("__t"))
    grid = totals.withColumn("from_id", ids).withColumn("to_id", ids)
    filled = grid.join(counts, [group, "from_id", "to_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return filled.select(group, "from_id", "to_id", "n", raster.percentage(F.col("n"), F.col("__t")).alias("pct"))


def top_changes(matrix: DataFrame, group: str, most: int = 8) -> DataFrame:
    """The most frequent changes of class of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "from_id", "to_id"))
    return matrix.where((F.col("from_id") != F.col("to_id")) & (F.col("n") > 0)).withColumn("place", place).where(F.col("place") <= most)


def sample_transitions(df: DataFrame, key: str, samples: str) -> DataFrame:
    """(key, from_id, to_id, n, pct): changes between neighbours at even and odd places of an array of numbers."""
    clean = F.transform(F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: F.bround(x, 0).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__s") / 2).cast("int") - 1), lambda i: F.struct(F.get("__s", i * 2).alias("from_id"), F.get("__s", i * 2 + 1).alias("to_id")))
    counts = df.select(key, clean.alias("__s")).where(F.size("__s") > 1).select(key, F.explode(pairs).alias("p")).groupBy(key, "p.from_id", "p.to_id").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", raster.percentage(F.col("n"), F.sum("n").over(Window.partitionBy(key))))


def sample_histogram(df: DataFrame, key: str, samples: str, most: int = 8) -> DataFrame:
    """(key, value, n, pct): the most common rounded values of an array of numbers, ties by value."""
    values = df.select(key, F.explode(samples).alias("v")).where(~F.isnan("v")).groupBy(key, F.bround("v", 0).cast("int").alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    return values.withColumn("pct", raster.percentage(F.col("n"), F.sum("n").over(w))).withColumn("__p", F.row_number().over(w.orderBy(F.desc("n"), "value"))).where(F.col("__p") <= most).drop("__p")


def confidence_bins(samples: Column) -> Column:
    """struct(low, medium, high): numbers by their size against the largest."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    top = F.when(top > 0, top).otherwise(1.0)
    share = F.transform(samples, lambda x: F.abs(x) / top)
    high, medium = F.size(F.filter(share, lambda s: s >= 0.67)), F.size(F.filter(share, lambda s: (s >= 0.33) & (s < 0.67)))
    return F.struct((F.size(samples) - high - medium).alias("low"), medium.alias("medium"), high.alias("high"))


def sample_candidates(samples: Column, least: float, most: int) -> Column:
    """The strongest samples as structs (sample_index, score, confidence), scores against the largest, from a least score, so many at most."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    top = F.when(top > 0, top).otherwise(1.0)
    scored = F.filter(F.transform(samples, lambda x, i: F.struct((-F.bround(F.abs(x) / top, 6)).alias("o"), i.alias("i"))), lambda e: -e["o"] >= least)
    return F.transform(F.slice(F.array_sort(scored), 1, most), lambda e: F.struct(e["i"].alias("sample_index"), (-e["o"]).alias("score"), F.when(-e["o"] >= 0.67, "high").otherwise("medium").alias("confidence")))


def vector_stats(values: Column, sample: int = 16) -> Column:
    """struct(numel, mean, std, min, max, sample) of an array: population deviation, and every so many-th value as a sample."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    step = F.greatest(F.lit(1), F.floor(n / sample).cast("int"))
    picked = F.slice(F.filter(values, lambda x, i: i % step == 0), 1, sample)
    return F.struct(n.alias("numel"), F.bround(F.when(n > 0, mean).otherwise(0.0), 6).alias("mean"), F.bround(F.when(n > 0, spread).otherwise(0.0), 6).alias("std"), F.array_min(values).alias("min"), F.array_max(values).alias("max"), picked.alias("sample"))


def mean_place(rows: DataFrame, group: str) -> DataFrame:
    """(group, lat, lon): means over rows in which both are numbers."""
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    return rows.groupBy(group).agg(F.avg(F.when(both, F.col("lat"))).alias("lat"), F.avg(F.when(both, F.col("lon"))).alias("lon"))


def change_metrics(pixels: DataFrame, tile: str, delta: str) -> DataFrame:
    """By tile: thresholds at the 85th and 97th percentile of the positive deltas (0.1 and 0.2 at least), shares beyond them, mean of what is positive, and the largest.

    Percentiles are exact and interpolated; Spark keeps counts by distinct value of a tile, and a tile is bounded.
    """
    d = F.col(delta)
    up = F.when(d > 0, d)
    at = pixels.groupBy(tile).agg(F.percentile(up, F.lit(0.85)).alias("a"), F.percentile(up, F.lit(0.97)).alias("b"))
    at = at.select(tile, F.greatest(F.coalesce("a", F.lit(0.1)), F.lit(0.1)).alias("changed_at"), F.col("b").alias("b"))
    at = at.select(tile, "changed_at", F.greatest(F.coalesce("b", F.lit(0.2)), F.col("changed_at"), F.lit(0.2)).alias("high_at"))
    joined = pixels.join(at, tile)
    n = F.count("*")
    return joined.groupBy(tile, "changed_at", "high_at").agg(
        raster.percentage(F.sum((d >= F.col("changed_at")).cast("int")), n).alias("changed_pct"),
        raster.percentage(F.sum((d >= F.col("high_at")).cast("int")), n).alias("high_pct"),
        F.bround(F.avg(F.greatest(d, F.lit(0.0))), 6).alias("mean_signal"),
        F.bround(F.max(d), 6).alias("max_signal"),
    )


def zones(pixels: DataFrame, tile: str, height: int, width: int, cells: int, value: Column) -> DataFrame:
    """(tile, gy, gx, score): an aggregate of the pixels of each cell of a grid over a tile."""
    gy, gx = raster.grid_cell(F.col("y"), height, cells), raster.grid_cell(F.col("x"), width, cells)
    return pixels.groupBy(tile, gy.alias("gy"), gx.alias("gx")).agg(value.alias("score"))


def best_zones(zones_: DataFrame, tile: str, most: int) -> DataFrame:
    """The zones of the greatest positive scores of each tile, ties by place."""
    place = F.row_number().over(Window.partitionBy(tile).orderBy(F.desc("score"), "gy", "gx"))
    return zones_.where("score > 0").withColumn("place", place).where(F.col("place") <= most)


def zone_centre(gy: Column, gx: Column, cells: int, box: Column) -> Column:
    """struct(lat, lon) of a zone's middle within a tile's box."""
    lon = box["west"] + (gx + 0.5) / cells * (box["east"] - box["west"])
    lat = box["north"] - (gy + 0.5) / cells * (box["north"] - box["south"])
    return F.struct(F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon"))


def zone_box(gy: Column, gx: Column, cells: int, box: Column) -> Column:
    """struct(west, south, east, north) of a zone within a tile's box."""
    wide, tall = (box["east"] - box["west"]) / cells, (box["north"] - box["south"]) / cells
    return F.struct((box["west"] + gx * wide).alias("west"), (box["north"] - (gy + 1) * tall).alias("south"), (box["west"] + (gx + 1) * wide).alias("east"), (box["north"] - gy * tall).alias("north"))


def signal_candidates(pixels: DataFrame, tile: str, signal: str, height: int, width: int, cells: int = 10, most: int = 20) -> DataFrame:
    """Zones whose greatest signal reaches the tile's 94th percentile (0.15 at least), as shares of the tile's greatest."""
    limits = pixels.groupBy(tile).agg(F.greatest(F.percentile(F.col(signal), F.lit(0.94)), F.lit(0.15)).alias("__at"), F.greatest(F.max(signal), F.lit(1e-6)).alias("__top"))
    found = zones(pixels, tile, height, width, cells, F.max(signal)).join(limits, tile).where(F.col("score") >= F.col("__at"))
    return best_zones(found.select(tile, "gy", "gx", F.bround(F.col("score") / F.col("__top"), 6).alias("score")), tile, most)


def coverage(pixels: DataFrame, tile: str, cloud_pct: str) -> DataFrame:
    """(tile, total, cloud_masked, valid): how many pixels the mean cloud cover of its scenes leaves."""
    out = pixels.groupBy(tile).agg(F.count("*").alias("total"), F.coalesce(F.avg(cloud_pct), F.lit(0.0)).alias("__c"))
    masked = F.bround(F.col("total") * F.col("__c") / 100.0, 0).cast("long")
    return out.select(tile, "total", masked.alias("cloud_masked"), F.greatest(F.lit(0), F.col("total") - masked).alias("valid"))


def flood_metrics(pixels: DataFrame, tile: str, before: Column, after: Column) -> DataFrame:
    """Shares of water before and after, of new water and of water gone."""
    share = lambda c: raster.percentage(F.sum(c.cast("int")), F.count("*"))
    return pixels.groupBy(tile).agg(share(before).alias("before_pct"), share(after).alias("after_pct"), share(after & ~before).alias("expanded_pct"), share(before & ~after).alias("receded_pct"))


def bright_on_water(pixels: DataFrame, tile: str, quantile: float = 0.985, least_water: int = 10) -> DataFrame:
    """Pixels of water as bright as a quantile of their tile's water; none where a tile has hardly any water."""
    water = pixels.where("is_water")
    limit = water.groupBy(tile).agg(F.percentile("brightness", F.lit(quantile)).alias("__q"), F.count("*").alias("__n"))
    return water.join(limit, tile).where((F.col("brightness") >= F.col("__q")) & (F.col("__n") > least_water)).drop("__q", "__n")


def stretch_limits(pixels: DataFrame, tile: str, bands: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """pixels with each band as a whole number from 0 to 255 between two percentiles of its tile."""
    limits = pixels.groupBy(tile).agg(*[F.percentile(b, F.array(F.lit(low), F.lit(high))).alias(f"__{b}") for b in bands])
    return pixels.join(limits, tile).select(*[c for c in pixels.columns if c not in bands], *[raster.stretched(F.col(b), F.col(f"__{b}")[0], F.col(f"__{b}")[1]).alias(b) for b in bands])


def tiles_of(rasters: DataFrame, tile: int, stride: int) -> DataFrame:
    """rasters (height, width) by windows (row_off, col_off, tile_h, tile_w): all full ones by stride, or one short one where none fits."""
    starts = lambda n: F.when(n >= tile, F.sequence(F.lit(0), n - tile, F.lit(stride)))
    full = (F.col("height") >= tile) & (F.col("width") >= tile)
    windows = F.when(full, F.flatten(F.transform(starts(F.col("height")), lambda r: F.transform(starts(F.col("width")), lambda c: F.struct(r.alias("row_off"), c.alias("col_off"), F.lit(tile).alias("tile_h"), F.lit(tile).alias("tile_w")))))).otherwise(
        F.array(F.struct(F.lit(0).alias("row_off"), F.lit(0).alias("col_off"), F.least(F.col("height"), F.lit(tile)).alias("tile_h"), F.least(F.col("width"), F.lit(tile)).alias("tile_w")))
    )
    return rasters.withColumn("__w", F.explode(windows)).select(*rasters.columns, "__w.*")


def turned(pixels: DataFrame, size: int) -> DataFrame:
    """Square tiles with their mirror image and three turns: column variant tells which; a select, nothing is shuffled."""
    y, x, last = F.col("y"), F.col("x"), size - 1
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), a.alias("y"), b.alias("x")) for n, a, b in (("identity", y, x), ("hflip", y, last - x), ("rot90", last - x, y), ("rot180", last - y, last - x), ("rot270", x, last - y))]))
    return pixels.withColumn("__v", variants).drop("y", "x").select(*[c for c in pixels.columns if c not in ("y", "x")], "__v.*")


def nearest_downsampled(pixels: DataFrame, size: int, out: int) -> DataFrame:
    """Pixels of a smaller square tile by the nearest of a larger one: a filter on places."""
    kept = F.array(*[F.lit(int((i + 0.5) * size / out)) for i in range(out)])
    rows = pixels.withColumn("__y", F.array_position(kept, F.col("y").cast("int"))).withColumn("__x", F.array_position(kept, F.col("x").cast("int")))
    return rows.where((F.col("__y") > 0) & (F.col("__x") > 0)).withColumn("y", (F.col("__y") - 1).cast("int")).withColumn("x", (F.col("__x") - 1).cast("int")).drop("__y", "__x")


def area_caption(found: DataFrame, tile: str, label: str, pixels: int, most: int = 4) -> DataFrame:
    """(tile, caption): the labels of the greatest areas and their percentages of the canvas, in a sentence."""
    sums = found.groupBy(tile, label).agg(F.sum("area_px").alias("a"))
    listed = sums.groupBy(tile).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("o"), F.col(label).alias("l")))), 1, most).alias("top"))  # a tile has as many labels as there are classes
    parts = F.transform("top", lambda e: F.concat(e["l"], F.lit(" ("), F.bround(-e["o"] * 100.0 / pixels, 1).cast("string"), F.lit("%)")))
    body = F.when(F.size("top") == 1, F.element_at(parts, 1)).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.size("top") - 1), ", "), F.lit(", and "), F.element_at(parts, -1)))
    return listed.select(tile, F.concat(F.lit("This satellite imagery is dominated by "), body, F.lit(".")).alias("caption"))


def focus_sentence(name: Column, fraction: Column, components: Column) -> Column:
    """How much of an image a class covers, and in how many patches."""
    layout = F.when(components == 0, "spatially mixed appearance in this resolution.").when(components <= 2, "one or two dominant contiguous patches.").when(components <= 5, "several separated patches.").otherwise("many small fragments across the tile.")
    return F.concat(F.lit("In this satellite imagery, **"), name, F.lit("** accounts for about "), F.bround(fraction * 100.0, 1).cast("string"), F.lit("% of valid pixels, showing "), layout)


def absent_class(fractions: Column, present: Column, threshold: float = 0.03) -> Column:
    """The least class id whose share is small and that no region has."""
    ids = F.array(*[F.lit(i) for i in range(len(raster.LAND_COVER))])
    return F.array_min(F.filter(ids, lambda i: (F.coalesce(F.try_element_at(fractions, i), F.lit(0.0)) <= threshold) & ~F.array_contains(present, i)))



def cropped(pixels: DataFrame, windows: DataFrame, tile: str, value: str, *, size: int, fill: int | float = 0) -> DataFrame:
    """(tile, y, x, value): a square of so many pixels a side from each tile's window (row_off, col_off, height, width), filled where the window or the tile has none."""
    side = F.sequence(F.lit(0), F.lit(size - 1))
    grid = windows.select(tile, "row_off", "col_off", "height", "width", F.explode(side).alias("y")).select("*", F.explode(side).alias("x"))
    inside = (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
    wanted = grid.select(tile, "y", "x", F.when(inside, F.col("y") + F.col("row_off")).alias("__y"), F.when(inside, F.col("x") + F.col("col_off")).alias("__x"))
    held = pixels.select(tile, F.col("y").alias("__y"), F.col("x").alias("__x"), F.col(value).alias("__v"))
    return wanted.join(held, [tile, "__y", "__x"], "left").select(tile, "y", "x", F.coalesce("__v", F.lit(fill)).alias(value))
