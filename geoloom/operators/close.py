"""The points nearest to positions, however unevenly both lie.

Both sides are cut into cubes of space, which have neither poles nor a date line. Pairs of cubes are looked at from the largest down: a cube of positions keeps only
the cubes of points that may hold the nearest one for any of its positions, by the bounds of what is in them. The rest is halved, until a pair
of cubes holds few places, which are compared. So a position far from a dense crowd meets the crowd's edge and not the crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed, dealt
from .pairs import R, in_space

#: Levels of the first and the last cubes (of 3,185 km and 6 m), and pairs of places up to which two cubes are compared place by place; as many where the cubes are too small to tell the places apart. Results don't depend on these.
FIRST, LAST, FEW, ALIKE = 2, 21, 64, 65_536
_AXES = ("x", "y", "z")


def _cube(level: int):
    """The number of the cube of a level that a row's x, y and z lie in."""
    x, y, z = (F.floor(F.col(c) / (2 * R / 2**level)).cast("long") for c in _AXES)
    return (x * (2**21 + 1) + y) * (2**21 + 1) + z if level > 20 else (x * 2**21 + y) * 2**21 + z


def _nodes(rows: DataFrame, level: int, name: str) -> DataFrame:
    """The cubes of a level, with the cube above, the number of rows, the bounds of these and their largest slack."""
    ends = [f(c).alias(f"{c}{k}") for c in _AXES for k, f in ((0, F.min), (1, F.max))]
    made = rows.groupBy(_cube(level).alias(f"c{name}"), _cube(level - 1).alias(f"up{name}")).agg(F.count("*").alias("n"), F.max("slack").alias("slack"), *ends)
    return made.select(f"c{name}", f"up{name}", F.struct("n", "slack", *[f"{c}{k}" for c in _AXES for k in (0, 1)]).alias(name))


def _bounds(a: str, b: str):
    """The least and the greatest straight way between rows of two cubes."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in _AXES:
        lo, hi, lo2, hi2 = (F.col(f"{n}.{c}{k}") for n in (a, b) for k in (0, 1))
        gap, wide = F.greatest(F.lit(0.0), lo2 - hi, lo - hi2), F.greatest(hi2 - lo, hi - lo2)
        near, far = near + gap * gap, far + wide * wide
    return F.sqrt(near), F.sqrt(far)


def candidates(positions: DataFrame, points: DataFrame, slack_km: float | Column) -> DataFrame:
    """(lat, lon, at): for each position (lat, lon) the points (at, lat, lon) that may be at most slack_km farther, straight through the globe, than its nearest one.

    slack_km may be a column of points, each point's own. None of those is missing; a few others may be there. Positions are distinct.
    """
    slack = (slack_km if isinstance(slack_km, Column) else F.lit(float(slack_km))) + 1e-6
    # Rows of a small file would stay in one task at every level.
    a = checkpointed(dealt(in_space(positions.select("lat", "lon", F.lit(0.0).alias("slack"))), "lat", "lon"))
    b = checkpointed(dealt(in_space(points.select("at", "lat", "lon", slack.alias("slack"))), "lat", "lon"))
    pairs = _nodes(a, FIRST, "a").withColumn("bound", F.lit(float("inf"))).crossJoin(_nodes(b, FIRST, "b")).select("ca", "cb", "a", "b", "bound")
    few, levels = None, []
    for level in range(FIRST, LAST + 1):
        near, far = _bounds("a", "b")
        of_a = Window.partitionBy("ca")
        pairs = pairs.withColumn("near", near).withColumn("bound", F.least("bound", F.min(far).over(of_a))).where(F.col("near") <= F.col("bound") + F.col("b.slack"))
        # Places of cubes much smaller than the slack can't be told apart.
        most = F.when(F.lit(2 * R / 2**level) < F.col("b.slack") / 2, ALIKE).otherwise(FEW)
        small = F.lit(True) if level == LAST else F.col("a.n") * F.col("b.n") <= most
        pairs = checkpointed(pairs.select("ca", "cb", "bound", small.alias("small")))
        leaves = pairs.where("small").select(F.lit(level).alias("level"), "ca", "cb", "bound")
        few, levels = leaves if few is None else few.unionByName(leaves), [*levels, level]
        rest = pairs.where("not small").select(F.col("ca").alias("upa"), F.col("cb").alias("upb"), "bound")
        if level == LAST or rest.isEmpty():
            break
        pairs = rest.join(_nodes(a, level + 1, "a"), "upa").join(_nodes(b, level + 1, "b"), "upb").select("ca", "cb", "a", "b", "bound")
    cubes = F.explode(F.array(*[F.struct(F.lit(v).alias("level"), _cube(v).alias("c")) for v in levels]))
    side = lambda rows, name, *columns: rows.select(*columns, cubes.alias("c")).select(F.struct(*columns).alias(name), F.col("c.level").alias("level"), F.col("c.c").alias(f"c{name}"))
    # Joined by sorting: what is small as it is shuffled, packed, takes many times that in each task as a table of hashes.
    met = few.join(side(a, "a", "lat", "lon", *_AXES).hint("merge"), ["level", "ca"]).join(side(b, "b", "at", "slack", *_AXES).hint("merge"), ["level", "cb"])
    way = F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in _AXES), F.lit(0.0)))
    met = met.select("a.lat", "a.lon", "b.at", "b.slack", way.alias("way"), "bound").where(F.col("way") <= F.col("bound") + F.col("slack"))
    least = met.withColumn("least", F.min("way").over(Window.partitionBy("lat", "lon")))
    return least.where(F.col("way") <= F.col("least") + F.col("slack")).select("lat", "lon", "at")
