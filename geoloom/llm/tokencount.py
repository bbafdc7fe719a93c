"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

A chunk is cut anywhere, so its last tokens may differ from those of the whole text. Two chunks that
overlap are spliced at a place where (a) both have a token boundary and (b) the text proves it stable:
white space after something else. There every match of the pattern ends, whatever stands to
either side, and no merge crosses it. Where an overlap has no such place it is doubled and read again,
up to the whole rest of the text, so the count is exact for any text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_rows

#: Characters of a chunk without its overlap, and of the first overlap tried.
CHUNK, OVERLAP = 8192, 64
#: A token count above this is flagged.
LIMIT = 512

STABLE = re.compile(r"(?<=\S)[ \t\n\x0b\x0c\r]")


class Encoding:
    """A chunk's tokens: starts[i] and ends[i] bound the characters of piece i, which has counts[i] tokens."""

    def __init__(self, starts: list[int], ends: list[int], counts: list[int]) -> None:
        self.starts, self.ends, self.counts = starts, ends, counts

    def boundary(self, at: int) -> int | None:
        """The number of tokens before at, or None if a token reaches over it."""
        from bisect import bisect_left

        i = bisect_left(self.starts, at)
        if i and self.ends[i - 1] > at:
            return None
        return sum(self.counts[:i])

    def total(self) -> int:
        return sum(self.counts)


def stretches(text: str) -> tuple[list[str], bool]:
    """Plain, spaced text cut before its spaces; whether the first stretch has a space too. The spaces themselves are left out."""
    words = text.split(" ")
    return (words, False) if words[0] else (words[1:], True)


def encode(path: str, text: str) -> Encoding:
    """Tokens with their offsets: from the worker's counts for plain, spaced text, else from the library."""
    if not tokens.plain(text):
        got = tokens.tokenizer(path).encode(text, add_special_tokens=False)
        return Encoding([a for a, _ in got.offsets], [b for _, b in got.offsets], [1] * len(got.ids))
    bare, after_space = tokens.word_counts(path)
    if not tokens.spaced(text):
        found = [(m.start(), m.end(), m[0]) for m in tokens.BYTE_PIECES.finditer(text)]
        return Encoding([a for a, _, _ in found], [b for _, b, _ in found], [bare[p] for _, _, p in found])
    words, first = stretches(text)
    counts = list(map(after_space.__getitem__, words))
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    if words and first:
        ends = [e + 1 for e in ends]
    elif words:
        counts[0] = bare[words[0]]
    return Encoding([0, *ends[:-1]] if words else [], ends, counts)


def count_short(path: str, text: str) -> int:
    if not tokens.plain(text):
        return len(tokens.tokenizer(path).encode(text, add_special_tokens=False).ids)
    bare, after_space = tokens.word_counts(path)
    if not text or not tokens.spaced(text):
        return sum(map(bare.__getitem__, tokens.BYTE_PIECES.findall(text)))
    words, first = stretches(text)
    if first:
        return sum(map(after_space.__getitem__, words))
    return bare[words[0]] + sum(map(after_space.__getitem__, words[1:]))


def count_tokens(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, times an overlap was widened) of one text.

    The chunk at hand starts at a place proven stable, so its tokens are the whole text's from there.
    It covers chunk + overlap characters; the next one is laid over its end and both are compared.
    """
    size = len(text)
    if size <= chunk + overlap:
        return count_short(path, text), 1, 0
    total, chunks, widened, begin = 0, 0, 0, 0
    while True:
        chunks += 1
        end, wide = begin + chunk, overlap
        if end + wide >= size:
            return total + count_short(path, text[begin:]), chunks, widened
        while True:
            left = encode(path, text[begin : end + wide])
            right = encode(path, text[end : end + wide])
            splice = None
            for m in STABLE.finditer(text, end + 1, end + wide - 1):
                at = m.start()
                before = left.boundary(at - begin)
                if before is not None and right.boundary(at - end) is not None:
                    splice = at
                    break
            if splice is not None:
                total, begin = total + before, splice
                break
            if end + wide >= size:
                return total + left.total(), chunks, widened
            widened += 1
            wide *= 2


def count(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The token count of every whole text under a byte-level vocabulary of the tokenizers library.

    One row for each document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit),
    n_chunks and n_widened. Null and empty texts have 0 tokens in 1 chunk. Null ids stay null; repeated rows
    give a row each; other columns are not read. A special token's string inside a text is that token, as
    is the library's default; it has no white space, so no splice cuts it.
    """

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc, size, t in given:
            n, chunks, widened = count_tokens(vocabulary, t or "", chunk, overlap)
            yield doc, size, n, n > limit, chunks, widened

    seen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return map_rows(seen, rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int")
