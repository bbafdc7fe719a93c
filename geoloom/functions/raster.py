"""Spectral indices and class rules for pixels held as columns, one row a pixel and one column a band.

Bands are doubles. Missing values give null; sums near zero give null or 0, as the caller asks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6

# The land-cover classes by id.
LAND_COVER = ["water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare_ground", "snow_and_ice"]
# Scene classes that count as valid, and the land-cover class each stands for.
SCENE_TO_LAND_COVER = {4: 1, 5: 7, 6: 0, 11: 8}
# The coarse land classes of the change analysis by id.
COARSE_LAND = ["water", "vegetation", "built_or_bare", "low_signal"]
# Kinds of sites in open sea, where an empty scene counts as water.
OPEN_WATER = ["marine_reserve", "marine_reserve_offshore", "marine_reserve_nearshore", "marine_reserve_coastal", "marine_reserve_nearshore_control"]
#: Pixels of this value hold nothing.
NOTHING = 255


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, or null where den is near zero or not finite."""
    return F.when((F.abs(den) > TINY) & ~F.isnan(den) & ~F.isnan(num) & (F.abs(den) != float("inf")), num / den)


def index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), or null where that isn't defined: NBR, NDWI, MNDWI and NDVI are this of their two bands."""
    return safe_ratio(a - b, a + b)


def index_or_zero(a: Column, b: Column) -> Column:
    """The same, with 0 where that isn't defined."""
    return F.coalesce(index(a, b), F.lit(0.0))


def burn_delta(nir0: Column, swir0: Column, nir1: Column, swir1: Column) -> Column:
    """The fall of the burn ratio between two scenes, 0 where it isn't defined."""
    return index_or_zero(nir0, swir0) - index_or_zero(nir1, swir1)


def water_signal(green: Column, nir: Column, swir: Column) -> Column:
    """Strength of bright objects, damped to 0.35 off the water."""
    strength = F.abs(index_or_zero(swir, nir))
    return F.when(index_or_zero(green, nir) > 0, strength).otherwise(strength * 0.35)


def coarse_land(red: Column, green: Column, nir: Column, swir: Column) -> Column:
    """Id of the coarse land class: water goes before vegetation, that before built or bare."""
    return (
        F.when(index_or_zero(green, nir) > 0.12, F.lit(0))
        .when(index_or_zero(nir, red) > 0.25, F.lit(1))
        .when(index_or_zero(swir, nir) > 0.12, F.lit(2))
        .otherwise(F.lit(3))
    )


def is_water(green: Column, nir: Column) -> Column:
    return index_or_zero(green, nir) > 0.12


def vegetation_changed(red0: Column, nir0: Column, red1: Column, nir1: Column, least: float = 0.22) -> Column:
    return F.coalesce(F.abs(index(nir1, red1) - index(nir0, red0)) > least, F.lit(False))


def burnt(nir0: Column, swir0: Column, nir1: Column, swir1: Column, least: float = 0.27) -> Column:
    return F.coalesce(index(nir0, swir0) - index(nir1, swir1) > least, F.lit(False))


def flooded(green0: Column, swir0: Column, green1: Column, swir1: Column, least: float = 0.15) -> Column:
    """Water after the event where there was none before it."""
    after, before = index(green1, swir1) > least, index(green0, swir0) > least
    return F.coalesce(after, F.lit(False)) & ~F.coalesce(before, F.lit(False))


def percentage(count: Column, total: Column, digits: int = 3) -> Column:
    """100 * count / total, rounded half to even; null without a total."""
    return F.when(total > 0, F.bround(count / total * 100.0, digits))


def land_cover_name(class_id: Column) -> Column:
    """The name of a class id, null outside the classes."""
    return F.get(F.array(*[F.lit(x) for x in LAND_COVER]), F.when(class_id >= 0, class_id.cast("int")))


def scene_land_cover(scene_class: Column) -> Column:
    """The land-cover class of a scene class, null for clouds, shadows and missing data."""
    out = None
    for scene, land in SCENE_TO_LAND_COVER.items():
        out = F.when(scene_class == scene, F.lit(land)) if out is None else out.when(scene_class == scene, F.lit(land))
    return out


def scene_role(scene_class: Column) -> Column:
    """What a scene class shows: vegetation, bare, water or snow_ice, else null."""
    return F.when(scene_class == 4, "vegetation").when(scene_class == 5, "bare").when(scene_class == 6, "water").when(scene_class == 11, "snow_ice")


def reflectance(value: Column, largest: Column) -> Column:
    """Value in units of 1/10000: scaled where the largest of its scene shows that it is a fraction."""
    return F.when(largest <= 1.5, value * 10_000.0).otherwise(value)


def stretched(value: Column, low: Column, high: Column) -> Column:
    """Value between two percentiles as a whole number from 0 to 255, clipped."""
    share = (value - low) / F.greatest(high - low, F.lit(TINY))
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255.0).cast("int")


def grid_cell(at: Column, extent: int, cells: int) -> Column:
    """The cell, of so many across extent pixels, whose rounded bounds hold a pixel."""
    bounds = [round(i * extent / cells) for i in range(cells + 1)]
    out = F.lit(None).cast("int")
    for i in range(cells - 1, -1, -1):
        out = F.when((at >= bounds[i]) & (at < bounds[i + 1]), F.lit(i)).otherwise(out)
    return out


def cloud_colour(scene_class: Column) -> Column:
    """RGBA of the cloud mask: clouds white, cirrus and shadows grey, all else clear."""
    return (
        F.when(scene_class.isin(8, 9), F.array(*[F.lit(x) for x in (255, 255, 255, 200)]))
        .when(scene_class.isin(3, 7, 10), F.array(*[F.lit(x) for x in (160, 160, 160, 140)]))
        .otherwise(F.array(*[F.lit(0)] * 4))
    )
