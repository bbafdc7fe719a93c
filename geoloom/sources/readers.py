"""Readers: files of every kind in use as DataFrames with fixed schemas.

All of them go through Spark's own readers, so paths can lie in any store that Spark reads. Where a file's
place matters (the later file wins) its path is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, nested, yaml
from ..operators.dedup import first_wins, last_wins

LOCATION = "location_id string, map_id string, truth_lat double, truth_lon double, assist_level string"
STILLS = "struct<locations:array<struct<location_id:string,map_id:string,still_bundle_id:string,still_sha256:string,source:string,style_id:string,center_lat:double,center_lon:double,zoom:double,width_px:int,height_px:int>>>"
GUESSES = "struct<ai_guesses:array<struct<map_id:string,location_id:string,ai_lat:double,ai_lon:double>>>"
MODALITIES = "map_id string, location_id string, analysis_profile string, outputs string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text): whole files, for small JSON or YAML documents."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), stem_of(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("text"))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, value VARIANT, error) of YAML files; a file that can't be read has an error and no value."""
    docs = documents(spark, path).select("path", "stem", yaml.document(F.col("text")).alias("d"))
    return docs.select("path", "stem", "d.value", "d.error")


def catalog_locations(spark: SparkSession, folder: str) -> DataFrame:
    """One location a YAML file: the id defaults to the file's stem, the map to the id. error says why a file couldn't be read."""
    docs = yaml_documents(spark, folder)
    of = lambda name: yaml.field(F.col("value"), f"$.{name}")
    lid = F.coalesce(of("location_id"), F.col("stem"))
    return docs.select(
        lid.alias("location_id"), F.coalesce(of("map_id"), lid).alias("map_id"), geo.parse_coordinate(of("truth_lat")).alias("truth_lat"), geo.parse_coordinate(of("truth_lon")).alias("truth_lon"),
        of("assist_level").alias("assist_level"), F.col("stem").alias("file_stem"), "error",
    )


def _map_entries(docs: DataFrame) -> DataFrame:
    entries = F.coalesce(F.try_variant_get("value", "$.maps", "array<variant>"), F.try_variant_get("value", "$", "array<variant>"))
    return docs.select("path", F.posexplode(entries).alias("pos", "e"))


def catalog_maps(spark: SparkSession, path: str) -> DataFrame:
    """(pos, map_id, title, local_only, ranked_pool): the entries of a YAML list of maps, at the top or under maps, that are mappings."""
    of = lambda name: yaml.field(F.col("e"), f"$.{name}")
    rows = _map_entries(yaml_documents(spark, path)).where(F.schema_of_variant("e").startswith("OBJECT"))
    return rows.select("pos", of("map_id").alias("map_id"), of("title").alias("title"), F.coalesce(of("local_only") == "true", F.lit(False)).alias("local_only"), F.coalesce(of("ranked_pool") == "true", F.lit(False)).alias("ranked_pool"))


def lint_map_files(spark: SparkSession, path: str) -> DataFrame:
    """(code, key, path): what is wrong with files of maps: ones that can't be read, whose maps are no list, entries that are no mappings or have no id, and ids that come again."""
    docs = yaml_documents(spark, path)
    kind = F.schema_of_variant(F.try_variant_get("value", "$.maps", "variant"))
    whole = docs.select(F.when(F.col("error").isNotNull(), "maps_yaml_parse").when(kind.isNotNull() & ~kind.startswith("ARRAY") & (kind != "VOID"), "maps_type").alias("code"), F.coalesce("error", "stem").alias("key"), "path").where("code is not null")
    entries = _map_entries(docs).withColumn("map_id", F.when(F.schema_of_variant("e").startswith("OBJECT"), F.coalesce(yaml.field(F.col("e"), "$.map_id"), F.lit(""))))
    bad = entries.select(F.when(F.col("map_id").isNull(), "map_row_type").when(F.col("map_id") == "", "map_id_missing").alias("code"), F.format_string("maps[%d]", "pos").alias("key"), "path").where("code is not null")
    again = entries.where("map_id != ''").groupBy("path", "map_id").count().where("count > 1").select(F.lit("duplicate_map_id").alias("code"), F.col("map_id").alias("key"), "path")
    return whole.unionByName(bad).unionByName(again)


def listed(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """The elements of a list in JSON documents with their place: (path, pos, columns of the element)."""
    docs = documents(spark, path).select("path", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("d"))
    return docs.select("path", F.posexplode(f"d.{field}").alias("pos", "e")).select("path", "pos", "e.*")


def still_index(spark: SparkSession, path: str) -> DataFrame:
    """The stills of locations; of repeated locations the last counts."""
    return last_wins(listed(spark, path, STILLS, "locations"), ["location_id"], F.col("path"), F.col("pos")).drop("path", "pos")


def keyed_documents(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """JSON documents of a folder, one a file; of repeated keys the last file by path counts."""
    docs = documents(spark, folder).select("path", F.from_json("text", schema).alias("d")).select("path", "d.*").where(F.col(key).isNotNull())
    return last_wins(docs, [key], F.col("path")).drop("path")


def guesses(spark: SparkSession, path: str) -> DataFrame:
    return listed(spark, path, GUESSES, "ai_guesses").drop("path", "pos")


def strict_json_lines(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON lines that must parse and have all keys, each once: reading a bad one is an error that names it. Blank lines don't count."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", schema).alias("d"))
    bad = F.col("d").isNull()
    for k in keys:
        bad = bad | F.col(f"d.{k}").isNull()
    bad = (F.trim("value") != "") & bad  # the optimiser may look at blank lines before they are left out
    told = F.raise_error(F.concat(F.lit("bad line: "), F.substring("value", 1, 200)))
    checked = rows.select(F.when(bad, F.from_json(told.cast("string"), schema)).otherwise(F.col("d")).alias("d")).select("d.*")
    n = F.count(F.lit(1))
    counts = checked.groupBy(*keys).agg(n.alias("__n"))
    again = F.raise_error(F.concat_ws(" ", F.lit("repeated key:"), *[F.col(k).cast("string") for k in keys]))
    unique = counts.select(*keys, F.when(F.col("__n") > 1, again.cast("long")).otherwise(F.col("__n")).alias("__n"))
    return checked.join(unique, keys).where("__n = 1").drop("__n")


def json_lines(spark: SparkSession, path: str, schema: str, *, comments: bool = False) -> DataFrame:
    """JSON lines without blank ones, and without those that start with # if comments; what doesn't parse is null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("d")).select("d.*")


def concatenated_json(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Elements of files that hold several JSON values in a row: lists are joined, other values stand for themselves.

    Values may follow each other with or without white space or line ends between. These are small files, read whole. What can't be read in a file ends it and doesn't stop
    the scan; unread_json() tells of it.
    """
    values = documents(spark, path).select("path", F.posexplode(nested.json_values("text")["values"]).alias("at", "v"))
    rows = F.coalesce(F.from_json("v", f"array<{element}>"), F.array(F.from_json("v", element)))
    return values.select("path", "at", F.posexplode(rows).alias("pos", "d")).select("path", "at", "pos", "d.*")


def unread_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, rest): the files of concatenated_json() that hold something after their last value that can be read, and its first 200 characters."""
    found = documents(spark, path).select("path", nested.json_values("text")["rest"].alias("rest"))
    return found.where("rest is not null").select("path", F.substring("rest", 1, 200).alias("rest"))


def events(df: DataFrame, profile: str, source: str) -> DataFrame:
    """(event_id, lat, lon, event_date, profile, source, metadata) from event tables of several column names; rows without place or date go.

    Ids default to the profile and the row's place in `pos` (or 0); what has no column of its own is metadata.
    """
    low = {c.lower(): c for c in df.columns}
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(low[n]).cast("string")), F.lit("")) for n in names if n in low], F.lit(None).cast("string"))
    known = {"event_id", "id", "lat", "latitude", "lon", "longitude", "event_date", "date", "datetime", "pos"}
    rest = [c for c in df.columns if c.lower() not in known]
    pos = F.col(low["pos"]) if "pos" in low else F.lit(0)
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    out = df.select(
        F.coalesce(pick("event_id", "id"), F.format_string(f"{profile}_%06d", pos.cast("long"))).alias("event_id"), geo.parse_coordinate(pick("lat", "latitude")).alias("lat"),
        geo.parse_coordinate(pick("lon", "longitude")).alias("lon"), pick("event_date", "date", "datetime").alias("event_date"), F.lit(profile).alias("profile"), F.lit(source).alias("source"), meta.alias("metadata"),
    )
    return out.where("lat is not null and lon is not null and event_date is not null")


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """An event table from a JSON array or a CSV file with a header."""
    return spark.read.csv(path, header=True) if path.endswith(".csv") else spark.read.json(path, multiLine=True)


def csv_guesses(spark: SparkSession, path: str) -> DataFrame:
    """(location_id, ai_lat, ai_lon, map_id) from CSV with headers in any case; a missing column is an error."""
    raw = spark.read.csv(path, header=True)
    low = {c.strip().lower(): c for c in raw.columns}
    missing = {"location_id", "ai_lat", "ai_lon"} - set(low)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    map_id = F.trim(F.col(low["map_id"])) if "map_id" in low else F.lit(None).cast("string")
    return raw.select(F.trim(F.col(low["location_id"])).alias("location_id"), geo.parse_coordinate(F.col(low["ai_lat"])).alias("ai_lat"), geo.parse_coordinate(F.col(low["ai_lon"])).alias("ai_lon"), map_id.alias("map_id"))


POINT = "poi_id:string,latitude:double,longitude:double,address:string,country:string,half_km:double"


def places(spark: SparkSession, root: str) -> DataFrame:
    """Places of a manifest (points of *_manifest.json), or where there is none of poi_*/poi.json files; none of both is an error."""
    from pyspark.errors import AnalysisException

    def read(make) -> DataFrame | None:
        try:
            found = make()
            return None if found.isEmpty() else found
        except AnalysisException:
            return None

    a = read(lambda: listed(spark, f"{root}/*_manifest.json", f"struct<points:array<struct<{POINT}>>>", "points").drop("path", "pos"))
    if a is not None:
        return a
    b = read(lambda: documents(spark, f"{root}/poi_*/poi.json").select(F.from_json("text", f"struct<{POINT}>").alias("d")).select("d.*"))
    if b is None:
        raise ValueError(f"no places under {root}")
    return b


def sidecars(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All metadata documents under a root, however deep, with their stems."""
    return documents(spark, f"{root}/metadata").where(F.col("path").endswith(".json")).select("path", "stem", F.from_json("text", schema).alias("d")).select("path", "stem", "d.*")


def place_index(docs: DataFrame) -> DataFrame:
    """(id, lat, lon): the first document (by path) of every id and of every id without its suffix."""
    from ..functions.text import base_id

    ids = docs.select(F.explode(F.array_distinct(F.array(F.col("poi_id"), base_id(F.col("poi_id"))))).alias("id"), "lat", "lon", "path").where("id is not null")
    return first_wins(ids, ["id"], F.col("path")).drop("path")


FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def geojson_rings(spark: SparkSession, path: str, name_keys: list[str]) -> DataFrame:
    """(feature_id, name, ring): the outer rings of polygons and the lines of a GeoJSON file, as arrays of struct(x, y)."""
    feats = listed(spark, path, f"struct<features:array<{FEATURE}>>", "features")
    from ..functions.text import usable

    name = usable(*[F.try_element_at("properties", F.lit(k)) for k in name_keys])
    kind, raw = F.col("geometry.type"), F.col("geometry.coordinates")
    one = lambda t: F.from_json(raw, t)
    rings = (
        F.when(kind == "Polygon", F.slice(one("array<array<array<double>>>"), 1, 1))
        .when(kind == "MultiPolygon", F.transform(one("array<array<array<array<double>>>>"), lambda p: p[0]))
        .when(kind == "LineString", F.array(one("array<array<double>>")))
        .when(kind == "MultiLineString", one("array<array<array<double>>>"))
    )
    xy = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return feats.select(F.col("pos").alias("feature_id"), name.alias("name"), F.explode(rings).alias("r")).select("feature_id", "name", xy(F.col("r")).alias("ring"))


def geojson_areas(spark: SparkSession, path: str, name_keys: list[str], code_keys: list[str]) -> DataFrame:
    """(polygon_id, name, code, area, rings): the polygons of a GeoJSON file with all their rings, holes included, as arrays of arrays of struct(x, y).

    A part's outer ring comes before its holes. area is in square degrees, as it orders polygons that overlap. Rings of fewer than three different points, and positions that aren't finite, are left out;
    features of which nothing is left have no row.
    """
    feats = listed(spark, path, f"struct<features:array<{FEATURE}>>", "features")
    from ..functions.text import usable

    prop = lambda keys: usable(*[F.try_element_at("properties", F.lit(k)) for k in keys])
    kind, raw = F.col("geometry.type"), F.col("geometry.coordinates")
    raw_rings = F.when(kind == "Polygon", F.from_json(raw, "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.from_json(raw, "array<array<array<array<double>>>>")))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    rings = F.transform(raw_rings, lambda r: F.filter(F.transform(r, point), lambda p: finite(p["x"]) & finite(p["y"])))
    whole = feats.select(F.col("pos").alias("polygon_id"), prop(name_keys).alias("name"), F.upper(F.trim(prop(code_keys))).alias("code"), F.filter(rings, lambda r: F.size(F.array_distinct(r)) >= 3).alias("rings"))
    twice = lambda r: F.aggregate(F.transform(r, lambda p, i: p["x"] * F.coalesce(F.get(r, i + 1), r[0])["y"] - F.coalesce(F.get(r, i + 1), r[0])["x"] * p["y"]), F.lit(0.0), lambda a, b: a + b)
    area = F.abs(F.aggregate(F.transform("rings", twice), F.lit(0.0), lambda a, b: a + b)) / 2
    return whole.where(F.size("rings") > 0).select("polygon_id", "name", "code", area.alias("area"), "rings")


def scenes(df: DataFrame, box: Column, start: Column, end: Column, most_cloud: float) -> DataFrame:
    """Scenes (scene_ts, cloud, west, south, east, north) that meet a box in a time under a cloud cover: plain predicates, which reach the scan."""
    meets = (F.col("west") <= box["east"]) & (F.col("east") >= box["west"]) & (F.col("south") <= box["north"]) & (F.col("north") >= box["south"])
    return df.where(F.col("scene_ts").between(start, end) & (F.col("cloud") < most_cloud) & meets)


def files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, name, bytes) of the files under a root, but for hidden, cache and bytecode folders; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    kept = found.where(~F.col("path").rlike(r"/(\.git|\.cache|__pycache__)/|/\.DS_Store$"))
    if suffixes:
        kept = kept.where(F.lower("path").rlike("(" + "|".join(s.lower().replace(".", r"\.") for s in suffixes) + ")$"))
    return kept.select("path", F.substring_index("path", "/", -1).alias("name"), "bytes")


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of the files under a root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.sha2("content", 256).alias("sha256"))


def shards(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet shards, of which only the columns asked for are read."""
    df = spark.read.parquet(folder)
    return df.select(*columns) if columns else df


def evolved(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with columns that it lacks, of a type and with a default."""
    return df.select("*", *[F.lit(v).cast(t).alias(c) for c, (t, v) in columns.items() if c not in df.columns])


def staged_split(spark: SparkSession, root: str, dataset: str, *, split: str, subset: str | None = None, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """A split of a dataset that is staged as Parquet under root/dataset/subset/split, subset being default where none is named; so many of its rows at most.

    Filters and columns reach the files. A split that isn't there is an error.
    """
    from pyspark.errors import AnalysisException

    path = f"{root.rstrip('/')}/{dataset}/{subset or 'default'}/{split}"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"no split {split} of {dataset}, subset {subset or 'default'}") from e
    df = df.select(*columns) if columns else df
    return df if most is None else df.limit(most)
