"""What each of several filters removes of a corpus, in every order in which they can be applied.

A document is a mask with a bit for each filter that it fails. Documents are counted by part and mask first; each of those cells then meets each
step of each order, so the audit itself grows with the parts and the orders, not with the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The thresholds of the standard filters, the last three in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Filters at most: their orders are as many as the permutations.
MOST_FILTERS = 7

_SPACE = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def standard(docs: DataFrame, text: str, **also: Column) -> tuple[DataFrame, dict[str, Column]]:
    """The columns of also and the counts of a text as one table, and over it the conditions under which a text fails: A few words, B repeated words, C capitals, D symbols.

    A null text is empty; it fails A alone, as none of its words repeats.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    inner = F.btrim(whole, F.lit(_SPACE))
    cut = docs.select(*[c.alias(k) for k, c in also.items()], whole.alias("whole"), F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("words"))
    counted = cut.select(
        *also,
        F.unhex(F.sha2("whole", 256)).alias("digest"), F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.length("whole").alias("points"),
        (F.length("whole") - F.length(F.translate("whole", _CAPITALS, ""))).alias("capitals"), F.col("whole").rlike("[#$%&*|]").alias("symbols"),
    )
    c = lambda name: F.col(name).cast("long")
    return counted, {
        "A": c("n") < LEAST_WORDS,
        "B": 100 * c("distinct") < LEAST_DISTINCT * c("n"),
        "C": 100 * c("capitals") > MOST_CAPITALS * c("points"),
        "D": F.col("symbols"),
    }


def cells(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): how many documents fail just the filters of a mask, by standard() and, as the next bit, E.

    A document fails E if its text is also that of a lesser id in any part; null ids are neither lesser nor greater than others.
    Texts meet by their SHA-256. Copies are counted before they meet, so a group of copies of any size is a few rows for each task. Labels of a document that is
    listed again count once, each if any row has it; ids that aren't documents count nothing.
    """
    counted, fails = standard(docs, text, doc_id=F.col(doc_id).cast("long"), part=F.coalesce(F.col(part).cast("string"), F.lit("")))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails.values())), F.lit(0))
    slim = counted.select("doc_id", "part", "digest", mask.alias("mask"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    kind = ["digest", "part", "mask", "good", "toxic"]
    rows = slim.join(known, "doc_id", "left").fillna(False, ["good", "toxic"]).groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), least.alias("first"))
    leads = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = by_text.withColumn("originals", F.col("unknown") + F.when(leads, F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")), F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    split = originals.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
    only = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("c.n"))), F.lit(0))
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), only("good").alias("n_good"), only("toxic").alias("n_toxic"))


def interactions(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter does there.

    counted has part, mask, n, n_good and n_toxic; the filters are letters, the first one's bit the lowest. Each cell is unpivoted against all steps; a running or of its
    failures says what has removed it before. kept, removed, redundant, unique_fails, good_lost and toxic_lost are sums over
    cells; shapley is the removed of the step's filter over all orders. A part has all its rows even where they are zeros; no part, no row.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"filters are one to {MOST_FILTERS} different letters")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("filter")) - 1)
    steps = counted.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    steps = steps.withColumn("step", F.col("at") + 1).withColumn("fails", F.col("mask").bitwiseAND(bit))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    failed, met = F.col("fails") != 0, F.col("earlier") == 0
    total = lambda n, where: F.coalesce(F.sum(F.when(where, F.col(n))), F.lit(0)).alias
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~failed & met)("kept"),
        total("n", failed & met)("removed"),
        total("n", failed & ~met)("redundant"),
        total("n", failed & (F.col("mask") == F.col("fails")))("unique_fails"),
        total("n_good", failed & met)("good_lost"),
        total("n_toxic", failed & met)("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """interactions() of the standard filters and E over documents. Null texts are empty, null parts are the empty one; repeated rows count as often; other columns aren't read."""
    return interactions(cells(docs, labels, doc_id=doc_id, text=text, part=part))
