"""Queries over pixels and vectors: fractions, transitions, zones, indices, regions and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster
from ..operators import pixels as P
from ..operators import regions as R
from . import tables as t

EDGE = 64


def class_fractions(spark: SparkSession, d: str) -> DataFrame:
    return P.class_fractions(t.pixels(spark, d), "tile", "class0").withColumn("class_id", F.col("class_id").cast("long"))


def scene_fractions(spark: SparkSession, d: str) -> DataFrame:
    return P.scene_fractions(t.pixels(spark, d), "tile", "scene_class").withColumn("class_id", F.col("class_id").cast("long"))


def water_prior(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d)
    fr = P.scene_fractions(x.where("tile % 3 = 0"), "tile", "scene_class")
    tiles = x.select("tile").distinct().withColumn("category", F.when(F.col("tile") % 2 == 0, "Marine_reserve").otherwise("forest"))
    return P.with_water_prior(tiles, fr, "tile", "category").select("tile", F.col("class_id").cast("long").alias("class_id"), "fraction", "tag")


def fraction_deltas(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d)
    out = P.fraction_deltas(P.class_fractions(x, "tile", "class0"), P.class_fractions(x.where("class1 != 4"), "tile", "class1"), "tile")
    return out.withColumn("class_id", F.col("class_id").cast("long"))


def land_transitions(spark: SparkSession, d: str) -> DataFrame:
    return P.transitions(t.pixels(spark, d), "tile", "land0", "land1").select("tile", F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), "n", "pct")


def land_top_changes(spark: SparkSession, d: str) -> DataFrame:
    m = P.transitions(t.pixels(spark, d), "tile", "land0", "land1")
    return P.top_changes(m, "tile").select("tile", F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), "n", F.col("place").cast("long").alias("place"))


def change_metrics(spark: SparkSession, d: str) -> DataFrame:
    return P.change_metrics(t.pixels(spark, d), "tile", "delta").withColumn("changed_at", F.round("changed_at", 6)).withColumn("high_at", F.round("high_at", 6))


def zone_means(spark: SparkSession, d: str) -> DataFrame:
    z = P.zones(t.pixels(spark, d), "tile", EDGE, EDGE, 8, F.round(F.avg(F.greatest(F.col("delta"), F.lit(0.0))), 6))
    return P.best_zones(z, "tile", 12).select("tile", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "score", F.col("place").cast("long").alias("place"))


def zone_changes(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d)
    z = P.zones(x, "tile", EDGE, EDGE, 8, F.bround(F.avg((F.col("land0") != F.col("land1")).cast("int")) * 100, 3))
    return P.best_zones(z, "tile", 12).select("tile", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "score")


def zone_floods(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d)
    new = raster.is_water(F.col("green"), F.col("nir")) & ~raster.is_water(F.col("green"), F.col("swir"))
    z = P.best_zones(P.zones(x, "tile", EDGE, EDGE, 8, F.bround(F.avg(new.cast("int")) * 100, 3)), "tile", 16)
    box = F.struct(F.lit(10.0).alias("west"), F.lit(50.0).alias("south"), F.lit(10.8).alias("east"), F.lit(50.8).alias("north"))
    return z.withColumn("b", P.zone_box(F.col("gy"), F.col("gx"), 8, box)).select("tile", "score", F.round("b.west", 6).alias("west"), F.round("b.north", 6).alias("north"))


def signal_candidates(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d).withColumn("signal", F.round(raster.water_signal(F.col("green"), F.col("nir"), F.col("swir")), 9))
    return P.signal_candidates(x, "tile", "signal", EDGE, EDGE).select("tile", F.col("gy").cast("long").alias("gy"), F.col("gx").cast("long").alias("gx"), "score")


def observation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return P.coverage(t.pixels(spark, d), "tile", "cloud")


def flood_metrics(spark: SparkSession, d: str) -> DataFrame:
    g, n, s = (F.col(c) for c in ("green", "nir", "swir"))
    return P.flood_metrics(t.pixels(spark, d), "tile", raster.is_water(g, s), raster.is_water(g, n))


def spectral_indices(spark: SparkSession, d: str) -> DataFrame:
    g, n, s, r = (F.col(c) for c in ("green", "nir", "swir", "red"))
    return t.pixels(spark, d).groupBy("tile").agg(
        F.round(F.avg(raster.index(n, s)), 6).alias("nbr"), F.round(F.avg(raster.index_or_zero(g, n)), 6).alias("ndwi"), F.round(F.avg(raster.burn_delta(n, s, g, s)), 6).alias("burn"),
        F.sum(raster.burnt(n, s, g, s).cast("int")).alias("burnt"), F.sum(raster.flooded(g, s, n, s).cast("int")).alias("flooded"), F.sum(raster.vegetation_changed(r, n, g, n).cast("int")).alias("veg_changed"),
    )


def coarse_land(spark: SparkSession, d: str) -> DataFrame:
    g, n, s, r = (F.col(c) for c in ("green", "nir", "swir", "red"))
    return t.pixels(spark, d).groupBy(raster.coarse_land(r, g, n, s).cast("long").alias("land")).agg(F.count("*").alias("n"))


def bright_on_water(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d).withColumn("is_water", raster.is_water(F.col("green"), F.col("nir"))).withColumn("brightness", F.col("red"))
    return P.bright_on_water(x, "tile").groupBy("tile").agg(F.count("*").alias("n"))


def stretched_bands(spark: SparkSession, d: str) -> DataFrame:
    return P.stretch_limits(t.pixels(spark, d).select("tile", "green", "nir"), "tile", ["green", "nir"]).groupBy("tile").agg(F.sum("green").alias("green"), F.sum("nir").alias("nir"))


def tile_windows(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 700 + 300).cast("int").alias("height"), (F.col("c_custkey") % 500 + 400).cast("int").alias("width"))
    return P.tiles_of(o, 512, 128).groupBy("id").agg(F.count("*").alias("n"), F.sum("row_off").alias("rows"), F.sum("col_off").alias("cols"), F.min("tile_h").cast("long").alias("least_h"))


def tile_variants(spark: SparkSession, d: str) -> DataFrame:
    return P.turned(t.pixels(spark, d).select("tile", "y", "x", "class0"), EDGE).groupBy("tile", "variant").agg(F.sum("y").alias("ys"), F.sum("x").alias("xs"), F.count("*").alias("n"))


def downsampled(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest_downsampled(t.pixels(spark, d).select("tile", "y", "x", "class0"), EDGE, 16).groupBy("tile").agg(F.count("*").alias("n"), F.sum("y").alias("ys"), F.sum("x").alias("xs"), F.sum("class0").alias("classes"))


def bilinear_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = t.pixels(spark, d).groupBy("tile", "y", "x").agg((F.min("class0") * 28 % 256).alias("v"))
    return R.bilinear(p, "tile", "v", height=EDGE, width=EDGE, out=24).select("tile", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


def valid_fraction(spark: SparkSession, d: str) -> DataFrame:
    return t.pixels(spark, d).groupBy("tile").agg(F.round(F.avg((F.col("class0") != raster.NOTHING).cast("int")), 6).alias("valid"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 8, 3)).alias("v"))


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _vectors(spark, d).select("vec_id", P.vector_stats(F.col("v")).alias("s"))
    return s.select("vec_id", F.col("s.numel").cast("long").alias("numel"), "s.mean", "s.std", "s.min", "s.max", F.size("s.sample").cast("long").alias("n_sample"))


def confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", P.confidence_bins(F.col("v")).alias("b")).select("vec_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("low", "medium", "high")])


def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = _vectors(spark, d).select("vec_id", F.posexplode(P.sample_candidates(F.col("v"), 0.5, 12)).alias("p", "c"))
    return c.select("vec_id", F.col("p").cast("long").alias("p"), F.col("c.sample_index").cast("long").alias("i"), "c.score", "c.confidence")


def sample_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_histogram(_vectors(spark, d), "vec_id", "v").withColumn("value", F.col("value").cast("long"))


def sample_transitions(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_transitions(_vectors(spark, d), "vec_id", "v").withColumn("from_id", F.col("from_id").cast("long")).withColumn("to_id", F.col("to_id").cast("long"))


def mean_places(spark: SparkSession, d: str) -> DataFrame:
    p = t.places(spark, d).withColumn("lat", F.when(F.col("id") % 7 != 0, F.col("lat")))
    return P.mean_place(p, "map_id").select("map_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _maps(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d).where("class0 != 255").groupBy("tile", "class0").agg(F.count("*").alias("n"))
    return x.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("class0", F.col("n").cast("double")))).alias("f"))  # nine classes at most


def dominant_classes(spark: SparkSession, d: str) -> DataFrame:
    return _maps(spark, d).select("tile", F.posexplode(P.dominant_classes(F.col("f"))).alias("p", "c")).select("tile", F.col("p").cast("long").alias("p"), F.col("c.class_id").cast("long").alias("class_id"), "c.label", "c.fraction")


def profile_fractions(spark: SparkSession, d: str) -> DataFrame:
    p = F.element_at(F.array(*[F.lit(x) for x in ("land_use_change", "wildfire", "flood_pulse", "oceanscout_ship_detection", "brief_only")]), (F.col("tile") % 5 + 1).cast("int"))
    return _maps(spark, d).select("tile", F.explode(P.profile_fractions(F.col("f"), p)).alias("class_id", "fraction")).withColumn("class_id", F.col("class_id").cast("long"))


def class_samples(spark: SparkSession, d: str) -> DataFrame:
    return _maps(spark, d).select("tile", F.explode(P.class_sample(F.col("f"))).alias("c")).groupBy("tile", F.col("c").cast("long").alias("class_id")).agg(F.count("*").alias("n"))


def picked_classes(spark: SparkSession, d: str) -> DataFrame:
    return _maps(spark, d).select("tile", P.picked_class(F.col("f"), (F.col("tile") % 10) / F.lit(10.0)).cast("long").alias("class_id"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d).where("class0 != 255").groupBy("tile", "y", "x").agg(F.min(F.col("class0") % 3).alias("k"))
    r = R.regions(x, "tile", "k", least_pixels=2, most=6, block=24)
    return r.select("tile", *[F.col(c).cast("long").alias(c) for c in ("class_id", "x1", "y1", "x2", "y2", "area_px")])


def region_captions(spark: SparkSession, d: str) -> DataFrame:
    x = t.pixels(spark, d).where("class0 != 255").groupBy("tile", F.col("class0").alias("c")).agg(F.count("*").alias("area_px")).withColumn("label", raster.land_cover_name(F.col("c")))
    return P.area_caption(x, "tile", "label", EDGE * EDGE)


QUERIES = {f.__name__: f for f in (
    class_fractions, scene_fractions, water_prior, fraction_deltas, land_transitions, land_top_changes, change_metrics, zone_means, zone_changes, zone_floods, signal_candidates, observation_coverage, flood_metrics,
    spectral_indices, coarse_land, bright_on_water, stretched_bands, tile_windows, tile_variants, downsampled, bilinear_tiles, valid_fraction, vector_stats, confidence_bins, sample_candidates, sample_histogram, sample_transitions,
    mean_places, dominant_classes, profile_fractions, class_samples, picked_classes, regions, region_captions,
)}

_P = f"({t.PIXELS_SQL})"
_V = "(SELECT vec_id, [round(x::DOUBLE * 8, 3) for x in embedding] AS v FROM embeddings)"
_E = f"(SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i, list_max([abs(y) for y in v]) AS top FROM {_V})"
_ND = lambda a, b: f"(CASE WHEN abs({a} + {b}) > 1e-6 THEN ({a} - {b}) / ({a} + {b}) END)"
_NZ = lambda a, b: f"coalesce({_ND(a, b)}, 0.0::DOUBLE)"
_NAMES = "['" + "', '".join(raster.LAND_COVER) + "']"
_FR = lambda c, where="true": f"(SELECT tile, c AS class_id, n, round_even(n / sum(n) OVER (PARTITION BY tile), 6) AS fraction FROM (SELECT tile, {c} AS c, count(*) AS n FROM {_P} WHERE {c} BETWEEN 0 AND 8 AND {where} GROUP BY 1, 2))"
_SCENE = f"(SELECT tile, c AS class_id, n, round_even(n / sum(n) OVER (PARTITION BY tile), 6) AS fraction FROM (SELECT tile, CASE scene_class WHEN 4 THEN 1 WHEN 5 THEN 7 WHEN 6 THEN 0 ELSE 8 END::BIGINT AS c, count(*) AS n FROM {_P} WHERE scene_class IN (4, 5, 6, 11) GROUP BY 1, 2))"
_CELL = lambda v, n=8: f"(CASE {' '.join(f'WHEN {v} < {round((i + 1) * EDGE / n)} THEN {i}' for i in range(n))} END::BIGINT)"
_ZONES = lambda expr, n=8: f"(SELECT tile, {_CELL('y', n)} AS gy, {_CELL('x', n)} AS gx, {expr} AS score FROM {_P} GROUP BY 1, 2, 3)"
_BEST = lambda z, most: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY score DESC, gy, gx) AS place FROM {z} WHERE score > 0) WHERE place <= {most})"
_GRID = f"(SELECT tile, f.i AS from_id, g.i AS to_id FROM (SELECT DISTINCT tile FROM {_P}), (SELECT unnest(range(4)) AS i) f, (SELECT unnest(range(4)) AS i) g)"
_TRANS = f"(SELECT tile, from_id, to_id, coalesce(n, 0)::BIGINT AS n, round_even(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY tile) * 100, 3) AS pct FROM {_GRID} LEFT JOIN (SELECT tile, land0 AS from_id, land1 AS to_id, count(*) AS n FROM {_P} GROUP BY 1, 2, 3) USING (tile, from_id, to_id))"
_SIG = f"(SELECT *, round(CASE WHEN {_NZ('green', 'nir')} > 0 THEN abs({_NZ('swir', 'nir')}) ELSE abs({_NZ('swir', 'nir')}) * 0.35::DOUBLE END, 9) AS signal FROM {_P})"

SQL = {
    "class_fractions": f"SELECT * FROM {_FR('class0')}",
    "scene_fractions": f"SELECT * FROM {_SCENE}",
    "water_prior": f"""SELECT tile, CASE WHEN class_id IS NULL AND tile % 2 = 0 THEN 0 ELSE class_id END AS class_id, CASE WHEN class_id IS NULL AND tile % 2 = 0 THEN 1.0::DOUBLE ELSE fraction END AS fraction, CASE WHEN class_id IS NOT NULL THEN 'strict' WHEN tile % 2 = 0 THEN 'marine_water_prior' ELSE 'empty' END AS tag
      FROM (SELECT DISTINCT tile FROM {_P}) LEFT JOIN (SELECT * FROM {_SCENE} WHERE tile % 3 = 0) USING (tile)""",
    "fraction_deltas": f"""WITH j AS (SELECT tile, class_id, coalesce(a.fraction, 0) AS before, coalesce(b.fraction, 0) AS after FROM {_FR('class0')} a FULL JOIN {_FR('class1', 'class1 != 4')} b USING (tile, class_id)), x AS (SELECT *, round_even(after - before, 6) AS delta FROM j)
      SELECT *, CASE WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS direction, CASE WHEN abs(delta) >= 0.12 THEN 'high' WHEN abs(delta) >= 0.04 THEN 'medium' ELSE 'low' END AS magnitude FROM x WHERE abs(delta) >= 0.005""",
    "land_transitions": f"SELECT * FROM {_TRANS}",
    "land_top_changes": f"SELECT tile, from_id, to_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, from_id, to_id) AS place FROM {_TRANS} WHERE from_id != to_id AND n > 0) WHERE place <= 8",
    "change_metrics": f"""WITH q AS (SELECT tile, greatest(coalesce(quantile_cont(delta, 0.85) FILTER (delta > 0), 0.1), 0.1) AS a, quantile_cont(delta, 0.97) FILTER (delta > 0) AS b FROM {_P} GROUP BY tile), l AS (SELECT tile, a, greatest(coalesce(b, 0.2), a, 0.2) AS b FROM q)
      SELECT tile, round(any_value(a), 6) AS changed_at, round(any_value(b), 6) AS high_at, round_even(count(*) FILTER (delta >= a) / count(*) * 100, 3) AS changed_pct, round_even(count(*) FILTER (delta >= b) / count(*) * 100, 3) AS high_pct, round_even(avg(greatest(delta, 0)), 6) AS mean_signal, round_even(max(delta), 6) AS max_signal FROM {_P} JOIN l USING (tile) GROUP BY tile""",
    "zone_means": f"SELECT tile, gy, gx, score, place FROM {_BEST(_ZONES('round(avg(greatest(delta, 0.0)), 6)'), 12)}",
    "zone_changes": f"SELECT tile, gy, gx, score FROM {_BEST(_ZONES('round_even(avg((land0 != land1)::INT) * 100, 3)'), 12)}",
    "zone_floods": f"SELECT tile, score, round(10.0::DOUBLE + gx * (0.8000000000000007::DOUBLE / 8), 6) AS west, round(50.8::DOUBLE - gy * (0.7999999999999972::DOUBLE / 8), 6) AS north FROM {_BEST(_ZONES(f'round_even(avg(({_NZ("green", "nir")} > 0.12 AND NOT {_NZ("green", "swir")} > 0.12)::INT) * 100, 3)'), 16)}",
    "signal_candidates": f"""WITH l AS (SELECT tile, greatest(quantile_cont(signal, 0.94), 0.15) AS lim, greatest(max(signal), 1e-6) AS top FROM {_SIG} GROUP BY tile), z AS (SELECT tile, {_CELL('y', 10)} AS gy, {_CELL('x', 10)} AS gx, max(signal) AS m FROM {_SIG} GROUP BY 1, 2, 3), s AS (SELECT tile, gy, gx, round(m / top, 6) AS score FROM z JOIN l USING (tile) WHERE m >= lim)
      SELECT tile, gy, gx, score FROM {_BEST('s', 20)}""",
    "observation_coverage": f"SELECT tile, total, m AS cloud_masked, greatest(0, total - m) AS valid FROM (SELECT tile, count(*) AS total, round_even(count(*) * avg(cloud) / 100, 0)::BIGINT AS m FROM {_P} GROUP BY tile)",
    "flood_metrics": f"""SELECT tile, round_even(count(*) FILTER (b) / count(*) * 100, 3) AS before_pct, round_even(count(*) FILTER (a) / count(*) * 100, 3) AS after_pct, round_even(count(*) FILTER (a AND NOT b) / count(*) * 100, 3) AS expanded_pct, round_even(count(*) FILTER (b AND NOT a) / count(*) * 100, 3) AS receded_pct
      FROM (SELECT tile, {_NZ('green', 'swir')} > 0.12 AS b, {_NZ('green', 'nir')} > 0.12 AS a FROM {_P}) GROUP BY tile""",
    "spectral_indices": f"""SELECT tile, round(avg({_ND('nir', 'swir')}), 6) AS nbr, round(avg({_NZ('green', 'nir')}), 6) AS ndwi, round(avg({_NZ('nir', 'swir')} - {_NZ('green', 'swir')}), 6) AS burn, count(*) FILTER ({_ND('nir', 'swir')} - {_ND('green', 'swir')} > 0.27) AS burnt,
      count(*) FILTER (coalesce({_ND('nir', 'swir')} > 0.15, false) AND NOT coalesce({_ND('green', 'swir')} > 0.15, false)) AS flooded, count(*) FILTER (abs({_ND('nir', 'green')} - {_ND('nir', 'red')}) > 0.22) AS veg_changed FROM {_P} GROUP BY tile""",
    "coarse_land": f"SELECT CASE WHEN {_NZ('green', 'nir')} > 0.12 THEN 0 WHEN {_NZ('nir', 'red')} > 0.25 THEN 1 WHEN {_NZ('swir', 'nir')} > 0.12 THEN 2 ELSE 3 END::BIGINT AS land, count(*) AS n FROM {_P} GROUP BY 1",
    "bright_on_water": f"WITH w AS (SELECT tile, red FROM {_P} WHERE {_NZ('green', 'nir')} > 0.12), q AS (SELECT tile, quantile_cont(red, 0.985) AS q FROM w GROUP BY tile HAVING count(*) > 10) SELECT tile, count(*) AS n FROM w JOIN q USING (tile) WHERE red >= q GROUP BY tile",
    "stretched_bands": f"""WITH q AS (SELECT tile, quantile_cont(green, 0.02) AS a, quantile_cont(green, 0.98) AS b, quantile_cont(nir, 0.02) AS c, quantile_cont(nir, 0.98) AS e FROM {_P} GROUP BY tile)
      SELECT tile, sum(trunc(greatest(0, least(1, (green - a) / greatest(b - a, 1e-6))) * 255))::BIGINT AS green, sum(trunc(greatest(0, least(1, (nir - c) / greatest(e - c, 1e-6))) * 255))::BIGINT AS nir FROM {_P} JOIN q USING (tile) GROUP BY tile""",
    "tile_windows": """WITH r AS (SELECT c_custkey AS id, c_custkey % 700 + 300 AS h, c_custkey % 500 + 400 AS w FROM customer), x AS (SELECT *, CASE WHEN h >= 512 AND w >= 512 THEN (h - 512) // 128 + 1 ELSE 1 END AS nr, CASE WHEN h >= 512 AND w >= 512 THEN (w - 512) // 128 + 1 ELSE 1 END AS nc FROM r)
      SELECT id, nr * nc AS n, (64 * nr * (nr - 1) * nc)::BIGINT AS rows, (64 * nc * (nc - 1) * nr)::BIGINT AS cols, CASE WHEN h >= 512 AND w >= 512 THEN 512 ELSE least(h, 512) END AS least_h FROM x""",
    "tile_variants": f"""SELECT tile, v AS variant, sum(CASE v WHEN 'identity' THEN y WHEN 'hflip' THEN y WHEN 'rot90' THEN 63 - x WHEN 'rot180' THEN 63 - y ELSE x END)::BIGINT AS ys, sum(CASE v WHEN 'identity' THEN x WHEN 'hflip' THEN 63 - x WHEN 'rot90' THEN y WHEN 'rot180' THEN 63 - x ELSE 63 - y END)::BIGINT AS xs, count(*) AS n
      FROM {_P}, (SELECT unnest(['identity', 'hflip', 'rot90', 'rot180', 'rot270']) AS v) GROUP BY 1, 2""",
    "regions": f"""WITH RECURSIVE p AS (SELECT tile, y, x, min(class0 % 3)::INT AS k FROM {_P} WHERE class0 != 255 GROUP BY tile, y, x),
      cc(tile, y, x, k, root) USING KEY (tile, y, x) AS (SELECT tile, y, x, k, y * 64 + x FROM p UNION
        SELECT n.tile, n.y, n.x, n.k, min(c.root) FROM cc c JOIN recurring.cc n ON c.tile = n.tile AND c.k = n.k AND abs(c.y - n.y) <= 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 WHERE c.root < n.root GROUP BY n.tile, n.y, n.x, n.k),
      r AS (SELECT tile, k, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS area_px FROM cc GROUP BY tile, k, root HAVING count(*) >= 2)
      SELECT tile, k::BIGINT AS class_id, x1, y1, x2, y2, area_px FROM r QUALIFY row_number() OVER (PARTITION BY tile, k ORDER BY area_px DESC, y1, x1, y2, x2) <= 6""",
    "bilinear_tiles": f"""WITH p AS (SELECT tile, y, x, min(class0) * 28 % 256 AS v FROM {_P} GROUP BY tile, y, x), r AS (SELECT i, (i + 0.5::DOUBLE) * (64 / 24::DOUBLE) AS m, 64 / 24::DOUBLE AS s FROM range(0, 24) r(i)),
      b AS (SELECT i, m, s, x, greatest(0.0::DOUBLE, 1 - abs((x - m + 0.5::DOUBLE) / s)) AS w FROM r, range(0, 64) q(x) WHERE x >= trunc(m - s + 0.5::DOUBLE) AND x < trunc(m + s + 0.5::DOUBLE)),
      k AS (SELECT i, x AS at_, trunc(0.5::DOUBLE + w / sum(w) OVER (PARTITION BY i) * 4194304)::BIGINT AS k FROM b), h AS (SELECT tile, y, i AS x, least(255, (sum(v * k) + 2097152)::BIGINT >> 22) AS v FROM p JOIN k ON p.x = at_ GROUP BY tile, y, i)
      SELECT tile, i AS y, x, least(255, (sum(v * k) + 2097152)::BIGINT >> 22) AS v FROM h JOIN k ON h.y = at_ GROUP BY tile, i, x""",
    "downsampled": f"SELECT tile, count(*) AS n, sum((y - 2) // 4)::BIGINT AS ys, sum((x - 2) // 4)::BIGINT AS xs, sum(class0)::BIGINT AS classes FROM {_P} WHERE y % 4 = 2 AND x % 4 = 2 GROUP BY tile",
    "valid_fraction": f"SELECT tile, round(avg((class0 != 255)::INT), 6) AS valid FROM {_P} GROUP BY tile",
    "vector_stats": f"SELECT vec_id, count(*) AS numel, round_even(avg(x), 6) AS mean, round_even(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, least(16, ceil(count(*) / greatest(1, count(*) // 16)))::BIGINT AS n_sample FROM {_E} GROUP BY vec_id",
    "confidence_bins": f"SELECT vec_id, count(*) FILTER (abs(x) / top < 0.33) AS low, count(*) FILTER (abs(x) / top >= 0.33 AND abs(x) / top < 0.67) AS medium, count(*) FILTER (abs(x) / top >= 0.67) AS high FROM {_E} GROUP BY vec_id",
    "sample_candidates": f"SELECT vec_id, p, i, score, CASE WHEN score >= 0.67 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) - 1 AS p FROM (SELECT vec_id, i, round_even(abs(x) / top, 6) AS score FROM {_E}) WHERE score >= 0.5) WHERE p < 12",
    "sample_histogram": f"SELECT vec_id, value, n, pct FROM (SELECT *, round_even(n / sum(n) OVER (PARTITION BY vec_id) * 100, 3) AS pct, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, value) AS r FROM (SELECT vec_id, round_even(x, 0)::BIGINT AS value, count(*) AS n FROM {_E} GROUP BY 1, 2)) WHERE r <= 8",
    "sample_transitions": f"""WITH c AS (SELECT vec_id, i, round_even(x, 0)::BIGINT AS c FROM {_E}), p AS (SELECT a.vec_id, a.c AS from_id, b.c AS to_id, count(*) AS n FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.i % 2 = 0 AND b.i = a.i + 1 GROUP BY 1, 2, 3) SELECT *, round_even(n / sum(n) OVER (PARTITION BY vec_id) * 100, 3) AS pct FROM p""",
    "mean_places": f"SELECT map_id, round(avg(lat) FILTER (id % 7 != 0), 6) AS lat, round(avg(lon) FILTER (id % 7 != 0), 6) AS lon FROM ({t.PLACES_SQL}) GROUP BY map_id",
    "dominant_classes": f"SELECT tile, p, class_id, {_NAMES}[class_id + 1] AS label, fraction FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY fraction DESC, class_id) - 1 AS p FROM {_FR('class0')}) WHERE p < 4",
    "region_captions": f"""WITH a AS (SELECT tile, {_NAMES}[class0 + 1] AS l, count(*) AS a FROM {_P} WHERE class0 != 255 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY a DESC, l) AS r, least(4, count(*) OVER (PARTITION BY tile)) AS n, l || ' (' || round_even(a * 100.0::DOUBLE / 4096, 1) || '%)' AS s FROM a)
      SELECT tile, 'This satellite imagery is dominated by ' || CASE WHEN any_value(n) = 1 THEN max(s) ELSE string_agg(s, ', ' ORDER BY r) FILTER (r < n) || ', and ' || max(s) FILTER (r = n) END || '.' AS caption FROM r WHERE r <= 4 GROUP BY tile""",
    "picked_classes": f"""WITH f AS (SELECT *, sum(fraction) OVER (PARTITION BY tile) AS total FROM {_FR('class0')}), c AS (SELECT tile, class_id, sum(fraction / total) OVER (PARTITION BY tile ORDER BY class_id) AS upto FROM f)
      SELECT tile, coalesce(min(class_id) FILTER (tile % 10 / 10.0::DOUBLE < upto), 8) AS class_id FROM c GROUP BY tile""",
    "class_samples": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY fraction DESC, class_id) AS r, count(*) OVER (PARTITION BY tile) AS c, greatest(1, round_even(fraction * 32, 0)::BIGINT) AS k FROM {_FR('class0')}), u AS (SELECT *, sum(k) OVER (PARTITION BY tile) AS used FROM f),
      s AS (SELECT *, CASE WHEN used < 32 AND r = 1 THEN k + 32 - used WHEN used > 32 AND r = c THEN greatest(1, k - (used - 32)) ELSE k END AS m FROM u), x AS (SELECT tile, class_id, m, sum(m) OVER (PARTITION BY tile ORDER BY r) - m AS before FROM s)
      SELECT tile, class_id, least(m, 32 - before)::BIGINT AS n FROM x WHERE before < 32""",
    "profile_fractions": f"""WITH p(pid, raised, lift, donors) AS (VALUES (0, 6, 0.12::DOUBLE, [1, 2, 5, 7, 4, 0, 8]), (1, 7, 0.10::DOUBLE, [1, 5, 2, 4, 6, 0, 8]), (2, 0, 0.15::DOUBLE, [2, 4, 5, 7, 6, 1, 8]), (3, 0, 0.06::DOUBLE, [7, 2, 5, 6, 1, 4, 8])),
      f AS (SELECT tile, class_id, fraction FROM {_FR('class0')}), g AS (SELECT t.tile, c.i AS class_id, coalesce(f.fraction, 0) AS have, raised, lift, donors, list_position(donors, c.i) AS o FROM (SELECT DISTINCT tile FROM f) t JOIN p ON p.pid = t.tile % 5, (SELECT unnest(range(9)) AS i) c LEFT JOIN f ON f.tile = t.tile AND f.class_id = c.i),
      d AS (SELECT *, CASE WHEN o IS NOT NULL THEN least(have, greatest(0, lift - coalesce(sum(CASE WHEN o IS NOT NULL THEN have ELSE 0 END) OVER (PARTITION BY tile ORDER BY o NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS take FROM g),
      v AS (SELECT tile, class_id, have - take + CASE WHEN class_id = raised THEN lift ELSE 0 END AS v FROM d) SELECT tile, class_id, round_even(v / sum(v) OVER (PARTITION BY tile), 6) AS fraction FROM v WHERE v > 0 UNION ALL SELECT tile, class_id, fraction FROM f WHERE tile % 5 = 4""",
}
