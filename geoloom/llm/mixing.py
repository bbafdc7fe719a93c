"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue of its documents in a shuffled order, gone through again where its target is larger than it. A copy's virtual finish time
is the words of its queue up to its end, divided by the source's target; the mix takes copies by finish time until its budget is full.

No window holds a source or the mix whole: running sums are taken within buckets (of the shuffle's key, of the virtual time), and the buckets'
sums, which are bounded in number, are summed before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.ranking import placed

from .common import checkpointed, written

#: Weights of the sources by code point, nulls last, over and over; times that a document is taken at most; the mix against all words.
WEIGHTS, PASSES, SHARE = (5, 2, 1), 2, (3, 2)
#: Hexadecimal digits of a shuffle key that make a bucket: a queue is numbered in 16 ** KEY_DIGITS pieces. Results don't depend on it.
KEY_DIGITS = 3
#: Pieces of the virtual time in which the mix is put in order; each holds about as many words. Results don't depend on it.
SLOTS = 4096
#: Sources up to this many are broadcast (a name is some tens of bytes); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000

_SOURCE = ("known", "name")


def sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """(doc_id, known, name, size, key): each document's source (no null in it), words, and key of the shuffle."""
    i = F.col(doc_id).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(i.cast("string"), F.lit("null"))))
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(i.alias("doc_id"), F.col(source).isNotNull().alias("known"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"), words.alias("size"), key.alias("key"))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: tuple[int, int] = SHARE) -> tuple[DataFrame, int]:
    """(known, name, source_size, target) from (known, name, source_size), and the budget in whole words.

    Sources share the budget by weight; where that is above passes times a source's size, its target stops there and the rest is shared among the
    others, until none is above. Each round is one row of sums: the level (budget that is left a unit of weight) only rises. All
    comparisons are in whole numbers. Sources of no words have a target of 0.
    """
    if share[0] > passes * share[1]:
        raise ValueError("the share of the mix is more than its passes give")
    ordered = placed(sizes.withColumn("unknown", ~F.col("known")), "unknown", "name").drop("unknown")
    weighed = checkpointed(ordered.withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights)).cast("int"))))
    whole = lambda c: c.cast("decimal(38,0)")
    size, weight = whole(F.col("source_size")), whole(F.col("weight"))
    total, left = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, above = share[0] * total, 0
    while True:
        # The level is rest / (share[1] * left); above it is who would get more than passes times the own size.
        full = size * whole(F.lit(passes * share[1])) * whole(F.lit(left)) < weight * whole(F.lit(rest)) if left else F.lit(True)
        used, others, n = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count_if(full)).first()
        if n == above:
            break
        rest, left, above = share[0] * total - passes * share[1] * used, others, n
    own = F.col("weight").cast("double") * float(rest) / float(share[1] * left) if left else F.lit(0.0)
    target = F.when(full, (F.col("source_size") * passes).cast("double")).otherwise(own)
    return weighed.select(*_SOURCE, "source_size", target.alias("target")), share[0] * total // share[1]


def queued(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: tuple[int, int] = SHARE) -> tuple[DataFrame, int]:
    """(doc_id, known, name, size, key, turn, begin, source_size, target): all documents with their place in their source's queue and the words before them; and the budget.

    Texts are read once. Documents of a source come by key, id and size; rows that are the same in all of these can stand for each other.
    """
    rows = written(sized(docs, doc_id, text, source, seed)).withColumn("bucket", F.substring("key", 1, KEY_DIGITS))
    buckets = rows.groupBy(*_SOURCE, "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy(*_SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*_SOURCE, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("w0"))
    here = Window.partitionBy(*_SOURCE, "bucket").orderBy("key", "doc_id", "size")
    placed_rows = rows.join(starts, [*_SOURCE, "bucket"]).select(
        "doc_id", *_SOURCE, "size", "key", (F.col("n0") + F.row_number().over(here)).alias("turn"),
        (F.col("w0") + F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("begin"),
    )
    goals, budget = targets(rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), weights=weights, passes=passes, share=share)
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return written(placed_rows.join(F.broadcast(goals) if few else goals, list(_SOURCE))), budget


def ordered(queue: DataFrame, budget: int, *, passes: int = PASSES) -> DataFrame:
    """(doc_id, known, name, turn, pass, begin, finish, position, words): the copies that the mix takes, by their position, the words before them in the mix.

    A copy that stands across its source's target is cut there and finishes at 1; the budget cuts the last copies of all. Copies that finish at the same time
    come by source and queue. A document of no words isn't in the mix.
    """
    passed = F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))
    copies = queue.select("doc_id", *_SOURCE, "turn", "size", "source_size", "target", "begin", passed.alias("pass"))
    copies = copies.withColumn("begin", F.col("begin") + F.col("pass") * F.col("source_size"))
    copies = copies.withColumn("words", F.least(F.col("size"), F.ceil("target") - F.col("begin"))).where("words > 0")
    copies = copies.withColumn("finish", F.least(F.lit(1.0), (F.col("begin") + F.col("words")) / F.col("target")))
    copies = copies.withColumn("slot", F.floor(F.col("finish") * SLOTS).cast("int")).drop("size", "source_size", "target")
    # At most SLOTS + 1 rows, whatever the input.
    slots = copies.groupBy("slot").agg(F.sum("words").alias("all"))
    starts = slots.select("slot", F.coalesce(F.sum("all").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    here = Window.partitionBy("slot").orderBy("finish", F.desc("known"), "name", "begin", "turn").rowsBetween(Window.unboundedPreceding, -1)
    position = F.col("start") + F.coalesce(F.sum("words").over(here), F.lit(0))
    mixed = copies.join(F.broadcast(starts), "slot").withColumn("position", position).withColumn("words", F.least(F.col("words"), F.lit(budget) - F.col("position"))).where("words > 0")
    return mixed.select("doc_id", *_SOURCE, "turn", "pass", "begin", "finish", "position", "words")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: doc_id, source, pass (from 0), finish, position and words of each copy taken; sort by position to read it. See queued() for the parameters."""
    queue, budget = queued(docs, **how)
    taken = ordered(queue, budget, passes=how.get("passes", PASSES))
    return taken.select("doc_id", F.when(F.col("known"), F.col("name")).alias("source"), "pass", "finish", "position", "words")


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target (its source's, a double) and taken, the words that the mix takes of it, repeats counted.

    A null text has no words, a null source is one source and the last, a null id is an id like others; repeated rows are documents of their own; other columns
    aren't read. No documents, no rows.
    """
    queue, budget = queued(docs, **how)
    words = ordered(queue, budget, passes=how.get("passes", PASSES)).groupBy(*_SOURCE, "turn").agg(F.sum("words").alias("taken"))
    return queue.join(words, [*_SOURCE, "turn"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
