"""A scene search as a data source of Spark: pages of catalog items, with the box, the time and the cloud cover pushed into the search.

A store is a folder of pages (JSON feature collections of items, as scene catalogs give them) and an index.json that says which box and time each page covers. Pages that
can't hold a wanted scene are no partitions at all; of the others only wanted items leave the reader. Spark applies the same filters again,
so a page with a wrong index loses its scenes but never adds any. The store may lie wherever pyarrow's filesystems reach.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCENE = "scene_id string, collection string, scene_ts timestamp, cloud double, west double, south double, east double, north double"
#: Columns whose bounds are pushed.
_BOUNDED = ("scene_ts", "cloud", "west", "south", "east", "north")


def _open(path: str):
    """The filesystem and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _json(path: str):
    where, inner = _open(path)
    with where.open_input_stream(inner) as f:
        return json.loads(f.read())


def _time(value) -> dt.datetime | None:
    """A moment in UTC from ISO text; None for what isn't one."""
    try:
        made = dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return made.replace(tzinfo=dt.timezone.utc) if made.tzinfo is None else made.astimezone(dt.timezone.utc)


def _aware(value):
    return value.replace(tzinfo=dt.timezone.utc) if isinstance(value, dt.datetime) and value.tzinfo is None else value


class Bounds:
    """What is wanted: for each column the values that it must have, at least and at most."""

    def __init__(self) -> None:
        self.low: dict[str, tuple] = {}
        self.high: dict[str, tuple] = {}
        self.same: dict[str, list] = {}

    def add(self, f: Filter) -> bool:
        """Whether a filter is one of these."""
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1:
            return False
        name, value = f.attribute[0], _aware(f.value)
        if isinstance(f, EqualTo):
            self.same.setdefault(name, []).append(value)
            return name in (*_BOUNDED, "collection", "scene_id")
        if name not in _BOUNDED:
            return False
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low[name] = max(self.low.get(name, (value, False)), (value, isinstance(f, GreaterThan)))
        else:
            self.high[name] = min(self.high.get(name, (value, True)), (value, not isinstance(f, LessThan)))
        return True

    def within(self, name: str, least, most) -> bool:
        """Whether a column whose values are from least to most can have a wanted one; None is unknown."""
        if name in self.low and most is not None:
            value, beyond = self.low[name]
            if most < value or (beyond and most == value):
                return False
        if name in self.high and least is not None:
            value, there = self.high[name]
            if least > value or (not there and least == value):
                return False
        return all((least is None or least <= v) and (most is None or most >= v) for v in self.same.get(name, []))

    def wants(self, row: dict) -> bool:
        """Whether a row can be wanted. A null fits no bound."""
        for name in {*self.low, *self.high, *self.same}:
            if row.get(name) is None or not self.within(name, row[name], row[name]):
                return False
        return True


class Page(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class SceneReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].rstrip("/")
        self.most = int(options["maxitems"]) if "maxitems" in options else None
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            if not self.bounds.add(f):
                yield f

    def _wanted(self, page: dict) -> bool:
        w, s, e, n = page.get("bbox") or (None,) * 4
        start, end = (_time(page[k]) if page.get(k) else None for k in ("start", "end"))
        held = {"west": (w, e), "east": (w, e), "south": (s, n), "north": (s, n), "scene_ts": (start, end)}
        return all(self.bounds.within(name, *ends) for name, ends in held.items())

    def partitions(self) -> list[InputPartition]:
        files = [p["file"] for p in _json(f"{self.root}/index.json")["pages"] if self._wanted(p)]
        # A search that ends after so many items goes through the pages in their order.
        return [Page(files)] if self.most is not None else [Page([f]) for f in files] or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        found = 0
        for name in partition.files:
            for item in _json(f"{self.root}/{name}").get("features") or []:
                properties, box = item.get("properties") or {}, item.get("bbox") or [None] * 4
                row = {"scene_id": item.get("id"), "collection": item.get("collection"), "scene_ts": _time(properties.get("datetime")), "cloud": properties.get("eo:cloud_cover")}
                row |= {k: None if v is None else float(v) for k, v in zip(("west", "south", "east", "north"), box, strict=False)}
                row["cloud"] = None if row["cloud"] is None else float(row["cloud"])
                at = row["scene_ts"]
                # The search counts items before those without a time are left out, and they are found whatever the time.
                if self.bounds.wants(row if at is not None else row | {"scene_ts": self._any_time()}):
                    found += 1
                    if at is not None:
                        yield tuple(row[c] for c in ("scene_id", "collection", "scene_ts", "cloud", "west", "south", "east", "north"))
                    if found == self.most:
                        return

    def _any_time(self):
        """A time that fits the bounds, if any does."""
        if "scene_ts" in self.bounds.same:
            return self.bounds.same["scene_ts"][0]
        if "scene_ts" in self.bounds.low:
            return self.bounds.low["scene_ts"][0] + dt.timedelta(microseconds=1)
        return self.bounds.high["scene_ts"][0] - dt.timedelta(microseconds=1) if "scene_ts" in self.bounds.high else None


class SceneStore(DataSource):
    """format("scene_store"): option path, and maxItems, the items that a search ends after (those without a time count, and aren't rows)."""

    @classmethod
    def name(cls) -> str:
        return "scene_store"

    def schema(self) -> str:
        return SCENE

    def reader(self, schema: StructType) -> SceneReader:
        return SceneReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters through to it."""
    spark.dataSource.register(SceneStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def search(spark: SparkSession, path: str, *, box: tuple[float, float, float, float], start: dt.datetime, end: dt.datetime, most_cloud: float, collection: str | None = None, max_items: int | None = None) -> DataFrame:
    """The scenes of a store that meet a box (west, south, east, north) from start to end with less cloud, of a collection.

    With max_items the search ends after so many, in the order of the store. Scenes without a time or a cloud cover aren't found.
    """
    register(spark)
    reader = spark.read.format("scene_store").option("path", path)
    if max_items is not None:
        reader = reader.option("maxItems", str(max_items))
    west, south, east, north = (float(v) for v in box)
    found = reader.load().where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    found = found.where((F.col("scene_ts") >= F.lit(start)) & (F.col("scene_ts") <= F.lit(end)) & (F.col("cloud") < float(most_cloud)))
    return found.where(F.col("collection") == collection) if collection is not None else found


def write_store(items: DataFrame, path: str, *, per_page: int = 500) -> None:
    """A store of items (SCENE's columns): pages by collection, time and id, and their index. Each task writes its pages; the index has one line a page."""
    from ..operators.ranking import placed

    ordered = placed(items.withColumn("__c", F.coalesce("collection", F.lit(""))), "__c", "scene_ts", "scene_id")
    box = F.array("west", "south", "east", "north")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("scene_id").alias("id"), "collection", box.alias("bbox"),
        F.struct(F.date_format("scene_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"), F.col("cloud").alias("eo:cloud_cover")).alias("properties"),
    )
    pages = ordered.groupBy(F.floor(F.col("place") / per_page).cast("long").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("place", feature.alias("f")))).alias("l"), F.min("west").alias("w"), F.min("south").alias("s"), F.max("east").alias("e"), F.max("north").alias("n"), F.min("scene_ts").alias("t0"), F.max("scene_ts").alias("t1")
    )  # a page has per_page items at most
    # A page with an item that lacks a time may hold any.
    whole = pages.select(
        F.format_string("page-%06d.json", "page").alias("file"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("l.f").alias("features"))).alias("body"),
        "w", "s", "e", "n", F.when(~F.exists("l", lambda x: x["f"]["properties"]["datetime"].isNull()), F.date_format("t0", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("start"), F.date_format("t1", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("end"),
    )

    def put(batches):
        import pandas as pd

        for b in batches:
            for name, body in zip(b["file"], b["body"], strict=True):
                where, inner = _open(path)
                where.create_dir(inner)
                with where.open_output_stream(f"{inner}/{name}") as f:
                    f.write(body.encode())
            yield pd.DataFrame({c: b[c] for c in ("file", "w", "s", "e", "n", "start", "end")})

    lines = whole.mapInPandas(put, "file string, w double, s double, e double, n double, start string, end string").collect()
    index = {"pages": [{"file": r["file"], "bbox": [r["w"], r["s"], r["e"], r["n"]] if r["w"] is not None else None} | ({"start": r["start"], "end": r["end"]} if r["start"] else {}) for r in sorted(lines, key=lambda r: r["file"])]}
    where, inner = _open(path)
    where.create_dir(inner)
    with where.open_output_stream(f"{inner}/index.json") as f:
        f.write(json.dumps(index).encode())
