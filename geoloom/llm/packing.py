"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A remainder of length r belongs to the reciprocal-capacity class k = capacity // r, and a sequence of
class k always takes exactly k remainders. Each worker fills its own sequences, one open sequence for
each class, so nothing is shuffled and no state is shared: a task that is lost and run again makes
the same whole set of sequences, under numbers that hold its own partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows

CAPACITY = 4096
END_ID = 2
#: A remainder is kept whole if a sequence of its class would be this full at least; else its head is cut to the next class's size.
FILL = 63 / 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, class int"

Span = tuple[int, int]


def cut(length: int, capacity: int = CAPACITY, fill: float = FILL) -> Iterator[tuple[int, int]]:
    """(class, length) of the pieces that a document of so many tokens is cut into, in order.

    Whole sequences come first (class 1). What remains stays whole if capacity // k of it nearly fits
    class k, or else gives capacity // (k + 1) tokens to class k + 1 and goes on with the rest, which
    is at most 1 / k of what it was; below capacity / 64 every remainder fits its class.
    """
    while length >= capacity:
        yield 1, capacity
        length -= capacity
    while length:
        k = capacity // length
        if k * length >= fill * capacity or k + 1 > capacity:
            yield k, length
            return
        head = capacity // (k + 1)
        yield k + 1, head
        length -= head


def powers(length: int) -> Iterator[int]:
    """length as a sum of powers of two, the largest first."""
    while length:
        part = 1 << (length.bit_length() - 1)
        yield part
        length -= part


def fill_sequences(documents: Iterable[tuple[int | None, bytes]], capacity: int, fill: float, first: int) -> Iterator[tuple]:
    """The rows of PIECES for one worker's documents, given as (doc_id, ids as bytes)."""
    open_bins: dict[int, list[tuple]] = {}
    sequence = first

    def close(pieces: list[tuple], k: int) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, sequence, at, k
            at += len(ids) // 4

    for doc, ids in documents:
        total, start = len(ids) // 4, 0
        for k, length in cut(total, capacity, fill):
            pieces = open_bins.setdefault(k, [])
            pieces.append((doc, start, ids[4 * start : 4 * (start + length)], total))
            start += length
            if len(pieces) == k:
                yield from close(pieces, k)
                sequence += 1
                del open_bins[k]
    # What the open sequences hold is laid end to end and cut where a sequence is full; the last tokens go to lengths that need no padding.
    rest = [p for k in sorted(open_bins) for p in open_bins[k]]
    left = sum(len(p[2]) // 4 for p in rest)
    sizes = [capacity] * (left // capacity) + list(powers(left % capacity))
    for size in sizes:
        pieces, room = [], size
        while room:
            doc, start, ids, total = rest.pop(0)
            taken = min(room, len(ids) // 4)
            pieces.append((doc, start, ids[: 4 * taken], total))
            if taken < len(ids) // 4:
                rest.insert(0, (doc, start + taken, ids[4 * taken :], total))
            room -= taken
        yield from close(pieces, 0)
        sequence += 1


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    fill: float = FILL,
    encoder: Callable[[str], Callable[[str], bytes]] = tokens.word_ids,
) -> DataFrame:
    """Packs every document's ids, with end_id after them, into sequences of at most capacity tokens.

    One row for each piece: doc_id, start (of the piece in its document), length, ids (unsigned
    little-endian 32-bit integers), doc_tokens (of the document, with the end id), sequence_id, offset
    (of the piece in its sequence) and class (0: what was left in a worker's open sequences).

    Null and empty texts are documents of the end id alone. Null ids stay null; repeated rows are
    documents of their own. Other columns are not read. An empty table gives no rows. capacity must be
    a power of two. Memory: one batch, and an open sequence for each class (under 130 of them).
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        encode, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 36
        return fill_sequences(((doc, encode(t or "") + end) for doc, t in given), capacity, fill, first)

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), rows, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces without their ids, but with a checksum of them."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "class")
