"""How alike two texts are by their matching blocks: the longest common block, and then those before and after it.

The longest block of two stretches is found by a suffix automaton of the one, through which the other is read once; each stretch
between blocks is such a search of its own, and one without a common character ends at once.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From so many characters of the second text on, characters that are more than a hundredth of it (and one) begin no block.
LONG, SHARE = 200, 100


class _Automaton:
    """The substrings of a text, without the characters left out: moves and links between states, and where each state's substrings first end."""

    def __init__(self, text: str, low: int, high: int, left_out: frozenset[str]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for at in range(low, high):
            c = text[at]
            if c in left_out:
                last = 0  # no block goes on over it
                continue
            last = self._add(c, at, last)

    def _new(self, size: int, end: int, moves: dict[str, int], link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        clone = self._new(self.size[p] + 1, self.end[q], dict(self.moves[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(c) == q:
            self.moves[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, c: str, at: int, last: int) -> int:
        if c in self.moves[last]:
            # After a character left out the text goes on from the beginning, where this may have been seen.
            q = self.moves[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        made = self._new(self.size[last] + 1, at, {}, 0)
        p = last
        while p >= 0 and c not in self.moves[p]:
            self.moves[p][c] = made
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][c]
            self.link[made] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return made

    def longest(self, text: str, low: int, high: int) -> tuple[int, int, int]:
        """(i, j, size) of the longest block of text[low:high]: the first in text, and of those the first in the automaton's."""
        state = size = 0
        best = (low, 0, 0)
        for at in range(low, high):
            c = text[at]
            while state and c not in self.moves[state]:
                state = self.link[state]
                size = self.size[state]
            if c in self.moves[state]:
                state = self.moves[state][c]
                size += 1
            if size > best[2]:
                best = (at - size + 1, self.end[state] - size + 1, size)
        return best


def matching_characters(a: str, b: str) -> int:
    """The sizes of all matching blocks of two texts together."""
    counts = Counter(b)
    left_out = frozenset(c for c, n in counts.items() if n > len(b) // SHARE + 1) if len(b) >= LONG else frozenset()
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, size = _Automaton(b, blo, bhi, left_out).longest(a, alo, ahi)
        if not size:
            i, j = alo, blo
        # A block goes on over equal characters that begin none.
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def ratio(a: str, b: str) -> float:
    """Twice the matching characters to all characters; 1 for two empty texts."""
    return 2.0 * matching_characters(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def changed_by(a: Column, b: Column) -> Column:
    """1 less the ratio of two captions without spaces around and in lower case, to four digits; 0 for two empty ones. Null is empty."""
    plain = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r")))
    x, y = plain(a), plain(b)
    return F.when((x == "") & (y == ""), F.lit(0.0)).when(x == y, F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), 1 - _ratios(x, y)), 4))
