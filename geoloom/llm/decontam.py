"""Benchmark decontamination: one Aho-Corasick automaton over the test items' word windows, run once over each text.

Texts and items are normalised alike (A-Z lower-cased, runs of other ASCII characters than letters and
digits become one space), so a window is a string between spaces. The automaton's places are counted
in words, and words are found again in the original text.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, kept, map_rows, written

WINDOW = 10
#: Words of the items in one automaton at most (about 60 nodes a window, 150 MB); more items are scanned in as many blocks.
BLOCK_WORDS = 40_000
#: Rows up to which a table of ids and hashes, or of hit documents, is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words in the original text, where A-Z are still in upper case.
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "doc_id long, key long, ranges array<struct<first:int,last:int>>, items array<long>"

def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def automaton(items: list[tuple[int | None, str | None]], window: int):
    """Every item's windows, each with its number of words and the ids of the items that hold it."""
    import ahocorasick

    held: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            held.setdefault(b" ".join(words[i : i + size]), (size, set()))[1].add(item)
    machine = ahocorasick.Automaton()
    for key, (size, ids) in held.items():
        machine.add_word(f" {key.decode('latin-1')} ", (len(key) + 1, size, frozenset(ids)))
    if held:
        machine.make_automaton()
    return machine if held else None


def hits(machine, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged ranges of hit words, and the items hit."""
    text = f" {b' '.join(words).decode('latin-1')} "
    found = [(end - back, size, ids) for end, (back, size, ids) in machine.iter(text)] if words and machine else []
    if not found:
        return [], set()
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ranges, items = set(), set()
    for start, size, ids in found:
        first = bisect_left(starts, start)
        ranges.add((first, first + size))
        items |= ids
    return merged(ranges), items


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> int:
    """Into how many blocks the items go; their words are counted first (over, as letters and digits between others)."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(text)) / 2 + 1)).first()[0] or 0
    return max(1, -(-int(total) // (3 * block_words)))


def scan(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Finds the windows of the benchmark's items in every whole document.

    One row for each document: doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids
    of the items with occurring windows, sorted), spans (start and end of the hit stretches in the original text, in
    characters) and contaminated. Null texts and items have no words; null item ids hit but aren't listed; repeated documents
    give a row each, repeated items count once. Other columns are not read. Empty tables give no rows or no hits.

    The items are sent to the executors in blocks of a bounded number of words, one block in most cases, so that only one automaton is in
    memory. With more, each further block scans the documents by itself and gives only what it hits, and the last scan adds those up.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    blocks = _blocks(items, "item", "text", block_words)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    part = lambda i: [tuple(r) for r in (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)).collect()]
    if blocks == 1:
        return _scan(source, part(0), window)
    found = [written(_hits(source.select("doc_id", F.xxhash64("text").alias("key"), "text"), part(i), window)) for i in range(1, blocks)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Repeated rows are hit alike, so any one of them does; the others' ranges are merged.
    every = every.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.flatten(F.collect_set("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    every = checkpointed(every)
    every = F.broadcast(every) if every.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else every
    joined = source.join(every, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    return _scan(joined.select("doc_id", "text", "ranges", "items"), part(0), window)


def _machine(name: str, sent, window: int):
    """The automaton of a block, made once for each worker."""
    return kept(name, lambda: automaton(sent.value, window))


def _hits(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """HITS of the documents (doc_id, key, text) that hold a window of these items."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        machine = _machine(name, sent, window)
        for doc, key, text in given:
            ranges, ids = hits(machine, words_of(text))
            if ranges:
                yield doc, key, [{"first": a, "last": b} for a, b in ranges], [x for x in ids if x is not None]

    return map_rows(docs, rows, HITS)


def _scan(docs: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """The rows of scan() for documents (doc_id, text and, of other items, ranges and items hit)."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        machine = _machine(name, sent, window)
        for doc, text, *before in given:
            words = words_of(text)
            ranges, ids = hits(machine, words)
            if before and before[0] is not None:
                ranges = merged({*ranges, *((r["first"], r["last"]) for r in before[0])})
                ids |= set(before[1])
            spans = []
            if ranges:
                places = [m.span() for m in ORIGINAL_WORD.finditer(text)]
                spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]
            n = sum(b - a for a, b in ranges)
            yield doc, len(words), n, sorted(x for x in ids if x is not None), spans, n > 0

    return map_rows(docs, rows, "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>, contaminated boolean")


def digest(found: DataFrame) -> DataFrame:
    """The scan with the items counted and hashed, in the order of their ids as strings."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns.

    Documents with null texts stay. The scan gives the hashes of contaminated texts, and rows with such a hash go; up to
    BROADCAST_ROWS hashes are broadcast, so that the documents themselves aren't shuffled.
    """
    key, other = F.xxhash64(F.col(text)), free_name(docs, "their_key")
    dirty = scan(docs.select(key.alias("k"), F.col(text).alias("t")), benchmark, doc_id="k", text="t", item_id=item_id, item_text=item_text, window=window, block_words=block_words)
    dirty = checkpointed(dirty.where("contaminated").select(F.col("doc_id").alias(other)).distinct())
    dirty = F.broadcast(dirty) if dirty.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dirty
    return docs.join(dirty, key == F.col(other), "left_anti")
