"""Dates of scenes: bounds, centres, windows to try, and slices in time.

Dates are texts (yyyy-MM-dd) where a catalog's filter takes them; the end of a bound is the first day that isn't in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half widths, in days, of the windows around a scene's centre, in the order in which they are tried.
HALF_WIDTHS = (7, 14, 30, 60, 120)
#: Days before today that a search covers when nothing says which.
DEFAULT_SPAN = 90
# Profiles that compare two scenes.
TEMPORAL_PROFILES = ("land_use_change", "wildfire", "flood_pulse")

BOUNDS = "struct<start:string,end:string>"


def _text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def event_time(value: Column) -> Column:
    """A date or an ISO time as a time; a time without a zone is of the session's. Null where it is neither."""
    t = F.trim(value)
    return F.coalesce(F.when(F.length(t) == 10, F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))), F.try_to_timestamp(t))


def bounds_of_item(time: Column) -> Column:
    """struct(start, end) of the day of an item's time."""
    day = F.to_date(event_time(time))
    return F.when(day.isNotNull(), F.struct(_text(day).alias("start"), _text(F.date_add(day, 1)).alias("end")))


def bounds_of_query(query: Column, today: Column) -> Column:
    """struct(start, end) of a `start/end` span, or of the last DEFAULT_SPAN days."""
    parts = F.transform(F.split(F.trim(query), "/"), lambda p: F.trim(p))
    spans = (F.size(parts) == 2) & (parts[0] != "") & (F.get(parts, F.lit(1)) != "")
    recent = F.struct(_text(F.date_sub(today, DEFAULT_SPAN)).alias("start"), _text(today).alias("end"))
    return F.when(spans, F.struct(F.substring(parts[0], 1, 10).alias("start"), F.substring(F.get(parts, F.lit(1)), 1, 10).alias("end"))).otherwise(recent)


def scene_bounds(time: Column, query: Column, today: Column) -> Column:
    """struct(start, end): the item's day, else the query's span, else the last days."""
    return F.coalesce(bounds_of_item(time), bounds_of_query(query, today))


def scene_centre(start: Column, end: Column) -> Column:
    """The middle of a span of days as a time, or the noon of its first where it has no length."""
    a, b = (F.to_timestamp(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd") for x in (start, end))
    half = F.greatest(F.unix_timestamp(b) - F.unix_timestamp(a), F.lit(0)) / 2
    return F.timestamp_seconds(F.unix_timestamp(a) + F.when(half > 0, half).otherwise(12 * 3600))


def window_text(start: Column, end: Column) -> Column:
    """`start/end` of two times, as days."""
    return F.concat_ws("/", _text(start), _text(end))


def date_windows(start: Column, end: Column, query: Column, today: Column) -> Column:
    """array<struct(start, end, tag)> of windows to try in order: the scene's own, ever wider ones around its centre, and the query's span where one is given."""
    centre = scene_centre(start, end)
    own = F.struct(start.alias("start"), end.alias("end"), F.lit("scene_window").alias("tag"))

    def around(half: int) -> Column:
        days = F.make_interval(days=F.lit(half))
        return F.struct(_text(centre - days).alias("start"), _text(F.date_add(F.to_date(centre + days), 1)).alias("end"), F.lit(f"symmetric_{half}d").alias("tag"))

    asked = bounds_of_query(query, today)
    last = F.when(F.trim(F.coalesce(query, F.lit(""))) != "", F.struct(asked["start"].alias("start"), asked["end"].alias("end"), F.lit("stac_datetime_query_fallback").alias("tag")))
    return F.array_compact(F.array(own, *[around(h) for h in HALF_WIDTHS], last))


def scene_slices(profile: Column, interval: Column, before: Column, ids: dict[str, Column]) -> Column:
    """array<struct(label, interval, scene_id)>: t1 alone, or t0 (the interval before) and t1 where the profile compares scenes or any scene is named, and t2 if that is."""
    of = lambda label, when: F.struct(F.lit(label).alias("label"), when.alias("interval"), ids[label].alias("scene_id"))
    named = ids["t0"].isNotNull() | ids["t1"].isNotNull() | ids["t2"].isNotNull()
    single = F.array(of("t1", interval))
    return F.when(~(profile.isin(*TEMPORAL_PROFILES) | named), single).otherwise(F.array_compact(F.array(of("t0", before), of("t1", interval), F.when(ids["t2"].isNotNull(), of("t2", interval)))))


def slice_parameters(slices: Column, base: Column, overrides: Column) -> Column:
    """map of label to parameters (maps of texts): a slice's interval and scene over the base, and what is set for its label over both."""
    def one(s: Column) -> Column:
        own = F.map_filter(F.create_map(F.lit("datetime"), s["interval"], F.lit("scene_id"), s["scene_id"]), lambda k, v: v.isNotNull())
        layers = (base, own, F.coalesce(F.try_element_at(overrides, s["label"]), F.create_map().cast("map<string,string>")))
        return F.map_zip_with(F.map_zip_with(layers[0], layers[1], lambda k, a, b: F.coalesce(b, a)), layers[2], lambda k, a, b: F.coalesce(b, a))

    return F.map_from_entries(F.transform(slices, lambda s: F.struct(s["label"].alias("key"), one(s).alias("value"))))


def provenance(scenes: Column) -> Column:
    """map of label to struct(item_id, datetime, cloud_pct) of an array of scenes (label, item_id, datetime, cloud_pct), by label; scenes without an item are left out."""
    known = F.array_sort(F.filter(scenes, lambda s: F.coalesce(s["item_id"], F.lit("")) != ""))
    return F.map_from_entries(F.transform(known, lambda s: F.struct(s["label"].alias("key"), F.struct(s["item_id"], s["datetime"], s["cloud_pct"]).alias("value"))))
