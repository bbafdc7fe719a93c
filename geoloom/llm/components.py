"""Connected components of a graph that is given as edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge to another: root is the component's least node.

    Each round links every node's larger neighbours to its least one and then its smaller ones, which at least halves the
    paths; edges never grow in number by more than the nodes. It ends when a round changes nothing (some four rounds
    for the groups of near copies). Each round is checkpointed, so that lost executors cost one round. Null nodes and loops are left out.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    links = checkpointed(edges.where(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")).distinct())
    seen = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if (now["n"], now["x"]) == seen or not now["n"]:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = (now["n"], now["x"])
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = checkpointed(small.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct())
