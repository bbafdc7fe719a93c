"""Regions over block borders, resampling and matching blocks, against brute force."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.functions import matching
from geoloom.operators import regions
from geoloom.plans import text_queries

SCHEMA = "tile string, y int, x int, k int, s double"


def flood(rows, eight):
    """(tile, class, x1, y1, x2, y2, area, mean score) by flooding."""
    at, sums = {}, {}
    for t, y, x, k, s in rows:
        if None not in (y, x, k):
            at[t, y, x] = min(at.get((t, y, x), k), k)
    for t, y, x, k, s in rows:
        if at.get((t, y, x)) == k and s is not None:
            sums.setdefault((t, y, x), []).append(s)
    out, seen = [], set()
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * eight
    for p, k in at.items():
        if p not in seen:
            todo, found = [p], []
            seen.add(p)
            while todo:
                t, y, x = todo.pop()
                found.append((y, x))
                for dy, dx in steps:
                    q = (t, y + dy, x + dx)
                    if at.get(q) == k and q not in seen:
                        seen.add(q)
                        todo.append(q)
            ys, xs = [y for y, _ in found], [x for _, x in found]
            means = [sum(sums[p[0], y, x]) / len(sums[p[0], y, x]) for y, x in found if (p[0], y, x) in sums]
            out.append((p[0], k, min(xs), min(ys), max(xs), max(ys), len(found), round(sum(means) / len(means), 9) if means else None))
    return out


def noise(seed, side=40):
    rng = random.Random(seed)
    rows = [("a", y, x, int(rng.random() < 0.55), rng.random()) for y in range(side) for x in range(side) if rng.random() < 0.97]
    # A spiral through all blocks, a null tile, places outside the first quadrant, repeated places and nulls.
    y = x = 0
    dy, dx, seen = 0, 1, set()
    while (y, x) not in seen:
        seen.add((y, x))
        ny, nx = y + dy, x + dx
        if not (0 <= ny + dy < side + dy * dy and 0 <= nx < side and 0 <= ny < side) or (ny, nx) in seen or (ny + dy, nx + dx) in seen:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < side and 0 <= nx < side) or (ny, nx) in seen or (ny + dy, nx + dx) in seen:
                break
        y, x = ny, nx
    rows += [("spiral", y, x, 5, None) for y, x in seen]
    return rows + [(None, -1, -1, 2, 1.0), (None, 0, 0, 2, 3.0), (None, 0, 0, 7, 9.0), (None, 5, None, 2, 1.0), ("a", 3, 3, None, 1.0), ("b", 1000, -1000, 1, None)]


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("block", [512, 16, 5])
def test_regions_against_flooding(spark, eight, block):
    rows = noise(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = regions.regions(df, "tile", "k", eight=eight, most=10_000, score="s", block=block).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(((r["tile"], r["class_id"], r["x1"], r["y1"], r["x2"], r["y2"], r["area_px"], None if r["score"] is None else round(r["score"], 9)) for r in got), key=key) == sorted(flood(rows, eight), key=key)


def test_largest_regions_and_none(spark):
    df = spark.createDataFrame([("a", 0, x, 1, None) for x in (0, 1, 3, 5, 6)], SCHEMA)
    got = regions.regions(df, "tile", "k", inclusive=False, least_pixels=2, most=1).collect()
    assert [(r["x1"], r["x2"], r["y2"], r["area_px"]) for r in got] == [(0, 2, 1, 2)]
    assert regions.regions(df.limit(0), "tile", "k").count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(1000, 1001), (1001, 1000), (1002, 1002)]
    got = {r["node"]: r["root"] for r in regions.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize(("size", "out"), [(64, 24), (10, 10), (6, 16), (7, 1)])
def test_bilinear_against_weights_by_hand(spark, size, out):
    rng = random.Random(5)
    image = np.array([[rng.randrange(256) for _ in range(size)] for _ in range(size)], dtype=np.int64)

    def line(v):
        step = size / out
        wide = max(1.0, step)
        made = []
        for i in range(out):
            w = np.maximum(0.0, 1 - abs((np.arange(size) + 0.5 - (i + 0.5) * step) / wide))
            made.append(float((w * v).sum() / w.sum()))
        return made

    across = np.floor(np.array([line(r) for r in image]) + 0.5)
    want = np.floor(np.array([line(c) for c in across.T]).T + 0.5)
    df = spark.createDataFrame([(1, y, x, int(image[y, x])) for y in range(size) for x in range(size)], "tile long, y int, x int, v int")
    got = {(r["y"], r["x"]): r["v"] for r in regions.bilinear(df, "tile", "v", height=size, width=size, out=out).collect()}
    assert len(got) == out * out and all(abs(got[y, x] - want[y, x]) <= (1 if abs(want[y, x] % 1) == 0 else 0) for y in range(out) for x in range(out))
    assert sum(got[y, x] != want[y, x] for y in range(out) for x in range(out)) <= out * out // 20


@settings(max_examples=300, deadline=None)
@given(st.text("abcx", max_size=40), st.text("abcy", max_size=40), st.integers(0, 12))
def test_ratio_is_that_of_matching_blocks(a, b, times):
    a, b = a + "the " * times + b, b * (1 + times)
    assert matching.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_caption_responsiveness_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    import re

    want = {}
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        a, b = ((x or "").strip(" \t\n\x0b\x0c\r").lower() for x in (r["text"], re.sub(r"(\w+) (\w+) (\w+)", r"\2 \1", r["text"] or "", flags=re.ASCII)))
        want[r["item_id"]] = round(max(0.0, 1 - difflib.SequenceMatcher(None, a, b).ratio()), 4) if a or b else 0.0
    got = {r["item_id"]: r["responsiveness"] for r in text_queries.caption_responsiveness(spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-4) and len(set(got.values())) > 3


def test_changes_of_nothing(spark):
    df = spark.createDataFrame([(None, ""), ("a", None), (" Ab", "aB "), ("abcd", "bcde")], "a string, b string")
    assert [r[0] for r in df.select(matching.changed_by(df.a, df.b)).collect()] == [0.0, 1.0, 0.0, 0.25]
