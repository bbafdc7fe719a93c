"""Join of documents whose sets of word shingles are alike, with Bayesian pruning of the candidates.

1. Documents with the same words are one text: all that follows works on distinct texts.
2. Texts that share a band of MinHash values are candidates. A band's texts are dealt into blocks, and a task takes two
   blocks at a time: it compares MinHash values in rounds and drops the pairs whose posterior probability of reaching
   the threshold falls below the tolerance. A pair is looked at in the first band that it shares, and nowhere else.
   Only the texts that are left with a partner come out, not the pairs.
3. The sets of those texts go to the same two blocks, where the pairs that are left are verified exactly. A task gives
   back counts and a spanning forest; counts add up, as every pair has one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import groupby
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import checkpointed, free_name, map_rows, written
from .components import components

THRESHOLD = 0.8
#: A pair is dropped when the posterior probability of THRESHOLD or more is below this.
TOLERANCE = 1e-9
#: MinHash values compared in a round.
ROUND = 32
#: Texts and shingles of a block at most, on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 192, 2_000_000
#: Rows up to which a table of ids and hashes (some tens of bytes a row) is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

LINKED = "cls binary, linked_docs long, linked_texts long, root binary"


@lru_cache(maxsize=32)
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The least number of matches among so many values that keeps a pair.

    Under a uniform prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1), and its
    probability of the threshold t or more is that of m or fewer successes in n + 1 trials of chance t.
    """
    total = 0.0
    for m in range(compared + 1):
        total += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared + 1


def survivors(one: np.ndarray, other: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of signatures that no round drops; same: both are one block, so each pair is taken once."""
    kept_i, kept_j = [], []
    for i in range(len(one)):
        j = np.arange(i + 1 if same else 0, len(other))
        matches = np.zeros(len(j), dtype=np.int32)
        for at in range(0, one.shape[1], ROUND):
            if not len(j):
                break
            end = min(at + ROUND, one.shape[1])
            matches += (other[j, at:end] == one[i, at:end]).sum(axis=1, dtype=np.int32)
            keep = matches >= least_matches(end, threshold, tolerance)
            j, matches = j[keep], matches[keep]
        kept_i.append(np.full(len(j), i))
        kept_j.append(j)
    return np.concatenate(kept_i), np.concatenate(kept_j)


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact number of common elements of the sets i[k] and j[k], for each k."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    every, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[where] > 1
    owner, at = owner[shared], column[where[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for begin in range(0, int(column[-1]) + 1, 8192):  # a slice of the elements at a time, each as a column of zeros and ones
        a, b = np.searchsorted(at, (begin, begin + 8192))
        part = np.zeros((len(sets), 8192), dtype=np.float32)
        part[owner[a:b], at[a:b] - begin] = 1
        out += (part @ part.T).astype(np.int64)
    return out[i, j]


def candidates(band: int, first: list[int], second: list[int], sigs: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a band's two blocks (indices of sigs) that no round drops and that share no earlier band."""
    if not first or not second:  # texts fall into blocks by their hash, so one of them can be empty
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j = survivors(sigs[first], sigs[second], first == second, threshold, tolerance)
    i, j = np.array(first)[i], np.array(second)[j]
    if len(i):
        own = np.concatenate([shingles.first_shared_band(sigs[i[k : k + 4096]], sigs[j[k : k + 4096]]) == band for k in range(0, len(i), 4096)])
        i, j = i[own], j[own]
    return i, j


def _two(texts: list[tuple]) -> tuple[list[int], list[int], np.ndarray]:
    """The places of the first and the second block's texts (in_a, in_b, signature), and all signatures."""
    return [k for k, t in enumerate(texts) if t[0]], [k for k, t in enumerate(texts) if t[1]], np.stack([np.frombuffer(t[2], dtype="<u2") for t in texts])


def compare(band: int, texts: list[tuple], threshold: float, tolerance: float) -> Iterator[tuple]:
    """LINKED rows for two blocks of a band; texts are (cls, copies, in the first block, in the second, signature, hashes)."""
    i, j = candidates(band, *_two([t[2:5] for t in texts]), threshold, tolerance)
    if not len(i):
        return
    sets = [np.frombuffer(t[5], dtype="<u8") for t in texts]
    sizes, limit = np.array([len(s) for s in sets]), Fraction(threshold).limit_denominator(10_000)
    common = overlaps(sets, i, j)
    alike = common * limit.denominator >= (sizes[i] + sizes[j] - common) * limit.numerator
    i, j = i[alike], j[alike]
    copies = np.array([t[1] for t in texts], dtype=np.int64)
    docs, n = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for a, b in ((i, j), (j, i)):
        np.add.at(docs, a, copies[b])
        np.add.at(n, a, 1)
    parent = list(range(len(texts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    for k in np.flatnonzero(n):
        yield texts[k][0], int(docs[k]), int(n[k]), texts[root(int(k))][0]


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; it must be cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def texts_of(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, key, cls, n, bands) of every document; key is a hash of the text as it is."""

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc, key, t in given:
            words = shingles.normalised(t)
            hashes = shingles.shingles(words, width)
            yield doc, key, shingles.identity(words), len(hashes), shingles.bands(shingles.signature(hashes)).tolist() if len(hashes) else []

    seen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    return map_rows(seen, rows, "doc_id long, key long, cls binary, n int, bands array<long>")


def _links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, width: int, threshold: float, tolerance: float) -> DataFrame:
    """LINKED rows, from each two blocks of each band with several texts."""
    buckets = classes.select("cls", "n", F.posexplode("bands").alias("no", "band"))
    members = F.count("*").alias("texts"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y")
    many = buckets.groupBy("no", "band").agg(*members).where("texts > 1")
    # Bands with the same texts have the same pairs: the first of them does for all.
    many = many.groupBy("texts", "shingles", "x", "y").agg(F.min(F.struct("no", "band")).alias("m")).select("m.band", "texts", "shingles")
    many = many.select("band", F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    found = checkpointed(buckets.join(many, "band").select("band", "no", "cls", "blocks"))

    def hashed(given: Iterator[tuple]) -> Iterator[tuple]:
        for t, cls, copies in given:
            hashes = shingles.shingles(shingles.normalised(t), width)
            yield cls, copies, shingles.signature(hashes).astype("<u2").tobytes(), hashes.astype("<u8").tobytes()

    wanted = found.select("cls").distinct().join(classes.select("cls", "first", "copies"), "cls").select("cls", "copies", F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key"))
    docs = docs.select(F.col(doc_id).cast("long").alias("__mine"), F.xxhash64(F.col(text)).alias("__hash"), F.col(text).alias("__text"))
    chosen = docs.join(_small(checkpointed(wanted)), F.col("__mine").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__key"))).select("__text", "cls", "copies")
    # Repeated rows are here as often; any one of them does.
    sets = written(map_rows(chosen, hashed, "cls binary, copies long, sig binary, hashes binary").dropDuplicates(["cls"]))

    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b")))
    dealt = found.join(sets.select("cls", "sig"), "cls").select("band", "no", "cls", "sig", own.alias("own"), F.explode(met).alias("at"))
    dealt = dealt.select("band", F.col("at.a").alias("a"), F.col("at.b").alias("b"), "no", "cls", (F.col("own") == F.col("at.a")).alias("in_a"), (F.col("own") == F.col("at.b")).alias("in_b"), "sig")

    def pruned(given: Iterator[tuple]) -> Iterator[tuple]:
        for task, group in groupby(given, key=lambda r: r[:4]):
            texts = list(group)
            i, j = candidates(task[3], *_two([r[5:8] for r in texts]), threshold, tolerance)
            for k in np.union1d(i, j).tolist():
                yield *task, *texts[k][4:7]

    def compared(given: Iterator[tuple]) -> Iterator[tuple]:
        for task, group in groupby(given, key=lambda r: r[:4]):
            yield from compare(task[3], [r[4:] for r in group], threshold, tolerance)

    task = ("band", "a", "b")
    left = map_rows(dealt.repartition(*task).sortWithinPartitions(*task), pruned, "band long, a int, b int, no int, cls binary, in_a boolean, in_b boolean")
    whole = checkpointed(left).join(sets, "cls").select(*task, "no", "cls", "copies", "in_a", "in_b", "sig", "hashes")
    return map_rows(whole.repartition(*task).sortWithinPartitions(*task), compared, LINKED)


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = shingles.WIDTH, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Links between documents whose sets of word shingles have a Jaccard similarity of threshold or more.

    One row for each document: doc_id, key (a hash of its text), class_id (the least doc_id of all documents connected to it by links),
    copy_of (the least doc_id of those with the same words), n_links (documents linked to it, copies included),
    n_text_links (different texts linked to it) and chosen (whether its text and id stand for the class).

    Words are lower-cased and bare of punctuation; a text of fewer than width words is one shingle. Texts without words
    (null and empty ones too) link to nothing, themselves included: each has its own id as class. Documents with a null id count like others,
    but an id of null is given only if no other is in the class. Repeated rows are copies of each other. Other columns are not read.
    Candidates come from 32 bands of 5 values: a pair at 0.8 shares none with a probability of 3e-6.
    """
    rows = written(texts_of(docs, doc_id, text, width))
    classes = written(rows.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    linked = checkpointed(_links(docs, classes, doc_id, text, width, threshold, tolerance))
    group = components(linked, "cls", "root").select(F.col("node").alias("cls"), F.col("root").alias("group"))
    counts = linked.groupBy("cls").agg(F.sum("linked_docs").alias("linked_docs"), F.sum("linked_texts").alias("linked_texts"))
    known = classes.select("cls", F.col("first.doc_id").alias("first"), "copies").join(counts, "cls", "left").join(group, "cls", "left").where("copies > 1 or linked_docs is not null")
    known = checkpointed(known.select("cls", "first", "copies", F.coalesce("linked_docs", F.lit(0)).alias("linked_docs"), F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"), F.coalesce("group", "cls").alias("group")))
    heads = known.groupBy("group").agg(F.min_by(F.struct("first", "cls"), F.struct(F.col("first").isNull(), "first", "cls")).alias("head"))
    # Only texts with copies or links are joined back; what is alone needs no more than its own row.
    known = known.join(heads, "group").select("cls", F.col("first").alias("copy_of"), (F.col("linked_docs") + F.col("copies") - 1).alias("n_links"), "linked_texts", F.col("head.first").alias("class_id"), (F.col("head.cls") == F.col("cls")).alias("head"))
    out = rows.select("doc_id", "key", "cls").join(known, "cls", "left")
    alone = F.col("n_links").isNull()
    return out.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("linked_texts", F.lit(0)).alias("n_text_links"),
        (alone | (F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("chosen"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class of join(), with all its columns: the one with the least id.

    Documents whose texts have no words all stay, as they are linked to nothing. Of repeated rows with the same id and text one stays.
    """
    found = checkpointed(join(docs, doc_id=doc_id, text=text, **how))
    key, mine, other_key, other_id = (free_name(docs, c) for c in ("key", "id", "their_key", "their_id"))
    marked = docs.withColumn(key, F.xxhash64(F.col(text))).withColumn(mine, F.col(doc_id).cast("long"))

    def matching(other: DataFrame):
        other = other.select(F.col("doc_id").alias(other_id), F.col("key").alias(other_key)).distinct()
        return _small(other), F.col(mine).eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))

    left = marked.join(*matching(found.where("not chosen")), "left_anti")
    again = found.where("chosen and n_links > 0").groupBy("doc_id", "key").count().where("count > 1")
    if again.isEmpty():
        return left.select(*docs.columns)
    once = left.join(*matching(again), "left_semi").dropDuplicates([key, mine])
    return left.join(*matching(again), "left_anti").unionByName(once).select(*docs.columns)
