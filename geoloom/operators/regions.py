"""Connected regions of rasters of any size, and resampling by weight tables.

A raster is cut into blocks of a fixed size. A block is labelled by runs of pixels in one task; regions that meet at the blocks' borders are then one component of a
graph whose nodes are the blocks' regions, so no task ever holds more than a block and regions don't end at borders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed

#: Pixels of a block's side. Results don't depend on it.
BLOCK = 512
#: Bits of a resampling weight after the point.
WEIGHT_BITS = 22


def run_labels(ys: np.ndarray, xs: np.ndarray, classes: np.ndarray, eight: bool) -> np.ndarray:
    """A number for each pixel, the same for pixels of a class that hang together. Pixels come in order of y and x and are different places.

    Runs of neighbours in a row are joined with the runs of the next row that they touch, all rows at once; unions are resolved by halving paths.
    """
    n = len(ys)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1) | (classes[1:] != classes[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n) - 1
    row, first, last, kind = ys[starts].astype(np.int64), xs[starts].astype(np.int64), xs[ends].astype(np.int64), classes[starts]
    wide = max(int(last.max()) - int(first.min()), 0) + 4
    base, reach = int(first.min()) - 1, int(eight)
    key = lambda y, x: y * wide + (x - base)
    low = np.searchsorted(key(row, last), key(row + 1, first - reach))
    high = np.searchsorted(key(row, first), key(row + 1, last + reach), side="right")
    many = np.maximum(high - low, 0)
    one = np.repeat(np.arange(len(row)), many)
    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    same = kind[one] == kind[other]
    one, other = one[same], other[same]
    parent = np.arange(len(row))
    while len(one):
        a, b = parent[one], parent[other]
        open_ = a != b
        if not open_.any():
            break
        one, other, a, b = one[open_], other[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent[np.cumsum(new) - 1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v): the least node that each hangs together with. Nodes may be of any type that has an order.

    Each node's neighbours are hung on the least of them, the greater ones and then the lesser ones, until nothing changes; that takes about as many rounds as the logarithm of the longest way.
    """
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = checkpointed(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = checkpointed(small.distinct())
        changed = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if changed:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def regions(pixels: DataFrame, tile: str, klass: str, *, eight: bool = True, inclusive: bool = True, least_pixels: int = 1, most: int = 20, score: str | None = None, block: int = BLOCK) -> DataFrame:
    """(tile, class_id, x1, y1, x2, y2, area_px, score): connected pixels of the same class, in rasters of any size.

    eight joins pixels at corners too. Boxes end at the last pixel (inclusive) or after it; score is the mean over a region's pixels. Of each tile and class so many
    largest regions stay, ties by box. Pixels without a class or place belong to no region; of several at one place the least class counts, with the mean of its scores. A null tile is one tile.
    """
    s = F.col(score).cast("double") if score else F.lit(None).cast("double")
    kind = dict(pixels.dtypes)[tile]
    cells = pixels.where(F.col(klass).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()).select(F.col(tile).alias("tile"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(klass).cast("int").alias("class_id"), s.alias("score"))
    cells = cells.groupBy("tile", "y", "x", "class_id").agg(F.avg("score").alias("score")).groupBy("tile", "y", "x").agg(F.min(F.struct("class_id", "score")).alias("c"))
    cells = cells.select("tile", "y", "x", "c.*").withColumn("by", F.floor(F.col("y") / block)).withColumn("bx", F.floor(F.col("x") / block))

    def label(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["y", "x"], ignore_index=True)
        ys, xs, classes = (g[c].to_numpy() for c in ("y", "x", "class_id"))
        g["label"] = run_labels(ys, xs, classes, eight)
        by, bx = int(g["by"].iloc[0]), int(g["bx"].iloc[0])
        found = g.groupby("label", as_index=False).agg(class_id=("class_id", "first"), x1=("x", "min"), y1=("y", "min"), x2=("x", "max"), y2=("y", "max"), area_px=("x", "size"), scores=("score", lambda v: v.sum(min_count=1)), scored=("score", "count"))
        edge = (ys % block == 0) | (ys % block == block - 1) | (xs % block == 0) | (xs % block == block - 1)
        border = g.loc[edge, ["label", "class_id", "y", "x"]]
        out = pd.concat([found, border], ignore_index=True)
        return out.assign(tile=group["tile"].iloc[0], by=by, bx=bx)[["tile", "by", "bx", "label", "class_id", "y", "x", "x1", "y1", "x2", "y2", "area_px", "scores", "scored"]]

    schema = f"tile {kind}, by long, bx long, label long, class_id int, y long, x long, x1 long, y1 long, x2 long, y2 long, area_px long, scores double, scored long"
    made = checkpointed(cells.groupBy("tile", "by", "bx").applyInPandas(label, schema))
    node = F.struct("tile", "by", "bx", "label").alias("node")
    parts, border = made.where("area_px is not null").select(node, "class_id", "x1", "y1", "x2", "y2", "area_px", "scores", "scored"), made.where("area_px is null").select("tile", "class_id", "y", "x", "by", "bx", node)
    # Neighbours that come later by row and column, in another block.
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * eight
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("to")
    ahead = border.select("tile", "class_id", F.col("node").alias("u"), F.col("by").alias("uy"), F.col("bx").alias("ux"), near).select("tile", "class_id", "u", "uy", "ux", "to.y", "to.x")
    there = border.select(F.col("tile").alias("t"), F.col("class_id").alias("k"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("node").alias("v"), "by", "bx")
    met = ahead.join(there, F.col("tile").eqNullSafe(F.col("t")) & (F.col("class_id") == F.col("k")) & (F.col("y") == F.col("y2")) & (F.col("x") == F.col("x2"))).where((F.col("uy") != F.col("by")) | (F.col("ux") != F.col("bx")))
    edges = checkpointed(met.select("u", "v").distinct())
    if not edges.isEmpty():
        roots = components(edges).select(F.col("node").alias("n"), "root")
        parts = parts.join(roots, F.col("node").eqNullSafe(F.col("n")), "left").withColumn("node", F.coalesce("root", "node"))
    whole = parts.groupBy("node", "class_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("area_px").alias("area_px"), F.try_divide(F.sum("scores"), F.sum("scored")).alias("score"))
    extra = 0 if inclusive else 1
    boxes = whole.where(F.col("area_px") >= least_pixels).select(F.col("node.tile").alias(tile), "class_id", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1")], *[(F.col(c) + extra).cast("int").alias(c) for c in ("x2", "y2")], F.col("area_px").cast("int").alias("area_px"), "score")
    place = F.row_number().over(Window.partitionBy(tile, "class_id").orderBy(F.desc("area_px"), "y1", "x1", "y2", "x2"))
    return boxes.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def bilinear_weights(size: int, out: int) -> list[tuple[int, int, int]]:
    """(to, from, weight) for a line of size pixels made out pixels long: a triangle as wide as the step, at least one pixel to each side, in whole numbers of 2 ** -WEIGHT_BITS."""
    step = size / out
    wide = max(step, 1.0)
    rows = []
    for i in range(out):
        middle = (i + 0.5) * step
        low, high = max(0, int(middle - wide + 0.5)), min(size, int(middle + wide + 0.5))
        raw = [max(0.0, 1.0 - abs((x - middle + 0.5) / wide)) for x in range(low, high)]
        total = sum(raw)
        rows += [(i, x, int(0.5 + w / total * (1 << WEIGHT_BITS))) for x, w in zip(range(low, high), raw, strict=True) if w > 0]
    return rows


def bilinear(pixels: DataFrame, tile: str, value: str, *, height: int, width: int, out: int) -> DataFrame:
    """(tile, y, x, value): square tiles of out pixels a side from tiles of height and width, by weighted means, first along x and then along y.

    Values are whole numbers from 0 to 255 and are rounded to such after each pass. Each pass joins the pixels with a table of weights, which has some twice as many rows as a side
    has pixels, and adds up. Pixels that a tile lacks, and null values, count as 0; a place given twice counts twice.
    """
    spark = pixels.sparkSession
    rounded = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(F.sum(c) + (1 << (WEIGHT_BITS - 1)), WEIGHT_BITS))).cast("int")

    def table(size: int) -> DataFrame:
        return F.broadcast(spark.createDataFrame(bilinear_weights(size, out), "to int, at int, weight long"))

    across = pixels.select(F.col(tile), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("at"), F.col(value).cast("long").alias("v")).join(table(width), "at")
    across = across.groupBy(tile, "y", F.col("to").alias("x")).agg(rounded(F.coalesce("v", F.lit(0)) * F.col("weight")).alias("v"))
    down = across.select(tile, F.col("y").alias("at"), "x", F.col("v").cast("long").alias("v")).join(table(height), "at")
    return down.groupBy(tile, F.col("to").alias("y"), "x").agg(rounded(F.col("v") * F.col("weight")).alias(value))
