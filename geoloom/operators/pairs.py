"""The closest pair of places, and the first pair that is farther apart than allowed, without meeting all pairs.

Places are points of a sphere in space and are cut into cubes, which have neither poles nor a date line. A level halves the cubes of the one before it.
"""

from __future__ import annotations

from math import sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .frames import checkpointed

R = geo.RADIUS_KM
#: Places of a cube at most when cubes are small enough; levels at most (the smallest cubes are far below a millimetre).
FEW, LEVELS = 8, 48
#: Pairs of places up to which two cubes are compared place by place.
FEW_PAIRS = 256
_AXES = ("x", "y", "z")


def in_space(df: DataFrame) -> DataFrame:
    """df with x, y and z (km, from 0 to twice the radius) of its lat and lon; rows without these go."""
    a, o = F.radians("lat"), F.radians("lon")
    return df.where("lat is not null and lon is not null").withColumns({"x": F.cos(a) * F.cos(o) * R + R, "y": F.cos(a) * F.sin(o) * R + R, "z": F.sin(a) * R + R})


def cube(side: float, shift: tuple[Column | int, ...] = (0, 0, 0)) -> Column:
    """The cube of a side that a row's x, y and z lie in."""
    return F.struct(*[(F.floor(F.col(c) / side) + s).cast("long").alias(c) for c, s in zip(_AXES, shift, strict=True)])


def _km(a: str, b: str) -> Column:
    return geo.haversine_km(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))


def closest_pair_km(places: DataFrame, *, place: str = "id") -> float | None:
    """The least distance between two places of different ids; None for fewer than two. Places without coordinates don't count.

    Cubes are halved until none holds more than a few places. Cubes of the level before have two places at least somewhere, and few, so the least
    distance within them is a bound; at that distance each place meets the few in the cubes around it. Rows that come out are so a constant times the places,
    however dense these are.
    """
    rows = checkpointed(in_space(places.select(F.col(place).alias("id"), "lat", "lon")))
    least, most = rows.agg(F.min("id"), F.max("id")).first()
    if least is None or least == most:
        return None
    if not rows.groupBy(*_AXES).agg((F.min("id") < F.max("id")).alias("two")).where("two").isEmpty():
        return 0.0
    # Rows of one id at one point count once.
    rows = checkpointed(rows.dropDuplicates(["id", *_AXES]))
    dense = lambda level: rows.groupBy(cube(2 * R / 2**level)).count().agg(F.max("count")).first()[0] > FEW
    low, high = -1, LEVELS
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if dense(mid) else (low, mid)
    both = lambda side: (F.struct("id", "lat", "lon"), cube(side))

    def nearest(left: DataFrame, right: DataFrame) -> float | None:
        met = left.join(right, "c").where(F.col("a.id") < F.col("b.id"))
        return met.agg(F.min(_km("a", "b"))).first()[0]

    own, at = both(2 * R / 2**low)
    bound = nearest(rows.select(own.alias("a"), at.alias("c")), rows.select(own.alias("b"), at.alias("c")))
    if bound is None or bound == 0.0:
        # Only repeated ids share those cubes: look through ever larger ones.
        while bound is None and low >= 0:
            low -= 1
            own, at = both(2 * R / 2**low)
            bound = nearest(rows.select(own.alias("a"), at.alias("c")), rows.select(own.alias("b"), at.alias("c")))
        if not bound:
            return bound
    side = bound * (1 + 1e-9) + 1e-9
    around = F.array(*[cube(side, (i, j, k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return nearest(rows.select(own.alias("a"), F.explode(around).alias("c")), rows.select(own.alias("b"), cube(side).alias("c")))


def _nodes(rows: DataFrame, group: str, level: int) -> DataFrame:
    """(group, cube, n, pos, bounds): the cubes of a level with their least position and the bounds of their places."""
    ends = [f(c).alias(f"{c}{k}") for c in _AXES for k, f in ((0, F.min), (1, F.max))]
    return rows.groupBy(group, cube(2 * R / 2**level).alias("cube")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.struct(*ends).alias("b"))


def _chords(a: str, b: str) -> tuple[Column, Column]:
    """The least and the greatest square of the straight way between places of two cubes, by their bounds."""
    near, far = F.lit(0.0), F.lit(0.0)
    for c in _AXES:
        lo, hi, lo2, hi2 = (F.col(f"{n}.b.{c}{k}") for n in (a, b) for k in (0, 1))
        gap = F.greatest(F.lit(0.0), lo2 - hi, lo - hi2)
        wide = F.greatest(hi2 - lo, hi - lo2)
        near, far = near + gap * gap, far + wide * wide
    return near, far


def first_far_pair(places: DataFrame, group: str, most_km: float) -> DataFrame:
    """(group, pos_a, pos_b, km): per group the first pair (by positions, which are unique in a group) of places farther apart than most_km.

    The first place of the pair is the least position that has any place so far away, before or after it. Pairs of cubes are
    looked at from the largest down: cubes that are apart as wholes give a bound for that position; those that can't be, and those whose places all come later than the bound,
    go; the rest are halved, until they hold few places, which are compared. The second is the least position that far from the first. Groups without such a pair, null
    groups and places without coordinates have no row.
    """
    rows = checkpointed(in_space(places.select(group, "pos", "lat", "lon").where(F.col(group).isNotNull())))
    chord = (2 * R * sin(min(most_km / (2 * R), 1.5707963267948966))) ** 2
    first = None  # (group, first): positions that have a partner

    def sides(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.select(group, F.struct("cube", "n", "pos", "b").alias(name))

    whole = _nodes(rows, group, 0)
    pairs = sides(whole, "a").join(sides(whole, "b"), group).where(F.col("a.cube") <= F.col("b.cube"))
    few = None
    for level in range(LEVELS):
        near, far = _chords("a", "b")
        pos = F.least("a.pos", "b.pos")
        pairs = checkpointed(pairs.withColumn("sure", near > chord * (1 + 1e-9)).withColumn("pos", pos).where(far > chord * (1 - 1e-9)))
        found = pairs.where("sure").groupBy(group).agg(F.min("pos").alias("first"))
        first = checkpointed(found if first is None else first.unionByName(found).groupBy(group).agg(F.min("first").alias("first")))
        open_ = pairs.where("not sure").join(first, group, "left").where(F.col("first").isNull() | (F.col("pos") < F.col("first"))).drop("first", "sure", "pos")
        small = F.col("a.n") * F.col("b.n") <= FEW_PAIRS
        leaves = open_.where(small).select(group, F.lit(level).alias("level"), F.col("a.cube").alias("ca"), F.col("b.cube").alias("cb"))
        few = leaves if few is None else few.unionByName(leaves)
        rest = checkpointed(open_.where(~small).select(group, F.col("a.cube").alias("ca"), F.col("b.cube").alias("cb")))
        if rest.isEmpty() or level == LEVELS - 1:
            break
        below = _nodes(rows.join(rest.select(group).distinct(), group, "left_semi"), group, level + 1)
        parent = F.struct(*[F.shiftright(F.col(f"cube.{c}"), 1).alias(c) for c in _AXES])
        halves = lambda name: below.select(group, F.struct("cube", "n", "pos", "b").alias(name), parent.alias(f"c{name}"))
        pairs = rest.join(halves("a"), [group, "ca"]).join(halves("b"), [group, "cb"]).where((F.col("ca") != F.col("cb")) | (F.col("a.cube") <= F.col("b.cube"))).select(group, "a", "b")

    # What is left is compared place by place, a few at a time.
    few = checkpointed(few)
    levels = [r["level"] for r in few.select("level").distinct().collect()]
    for level in levels:
        at = rows.select(group, "pos", "lat", "lon", cube(2 * R / 2**level).alias("c"))
        side = lambda name: at.select(group, F.struct("pos", "lat", "lon").alias(name), F.col("c").alias(f"c{name}"))
        met = few.where(F.col("level") == level).join(side("a"), [group, "ca"]).join(side("b"), [group, "cb"]).where(_km("a", "b") > most_km)
        first = first.unionByName(met.groupBy(group).agg(F.min(F.least("a.pos", "b.pos")).alias("first")))
    first = checkpointed(first.groupBy(group).agg(F.min("first").alias("first")))
    heads = rows.join(first, group).where(F.col("pos") == F.col("first")).select(group, F.struct("pos", "lat", "lon").alias("a"))
    other = rows.select(group, F.struct("pos", "lat", "lon").alias("b")).join(heads, group).where(F.col("b.pos") > F.col("a.pos")).withColumn("km", _km("a", "b")).where(F.col("km") > most_km)
    return other.groupBy(group).agg(F.min(F.struct(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "km")).alias("p")).select(group, "p.*")
