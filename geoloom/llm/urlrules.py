"""URL filters by a bit-parallel automaton that runs all glob rules at once over each canonical URL.

Every rule is a glob over the canonical key `.host<sep>path<sep>rest`. The rules' characters are laid side by
side in 64-bit words, a bit for each place in a rule; one Shift-And step moves all of them over a
character, for a whole batch of URLs at a time, with carries from word to word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Between the parts of the key. Control characters of a URL are percent-encoded, so it is in none of the parts.
SEP = "\x01"
#: Cells (URLs by characters) of a batch that is run at once.
CELLS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and a path's beginning."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Glob:
    """A pattern over host, path and rest: `*` is any run of characters, `?` any one, and `/` in front of the first slash of the path."""

    verdict: str
    host: str = "*"
    path: str = "*"


# The rules that the query applies.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Hosts and paths of pages that aren't worth reading; they decide where no rule fits.
GLOBS = tuple(Glob("block", host=h) for h in ("*cheap-*", "*-pills.*", "*casino*", "*.ads.*", "*.adserver.*", "*.tracker.*", "*poker-*", "*viagra*", "*torrent*")) + tuple(
    Glob("block", path=p) for p in ("*/wp-login*", "*/cart/*", "*/checkout/*", "*.exe", "*.zip", "*/cgi-bin/*", "*/login?????*")
)

_URL = re.compile(r"(.*?)://([^/?#]*)([^?#]*)(.*)\Z", re.DOTALL)
_UPPER = {c: c + 32 for c in range(65, 91)}
_CONTROL = {c: f"%{c:02X}" for c in (*range(33), 127)}


def split(url: str | None) -> tuple[str, str, str]:
    """(host, path, rest) of a URL: the host in lower case, up to the path, query, fragment or end; all empty without `://`."""
    m = _URL.match(url) if url else None
    return (m[2].translate(_UPPER), m[3], m[4]) if m else ("", "", "")


def canonical(host: str, path: str, rest: str) -> str:
    """The key that rules run over: control characters and spaces encoded, the fragment left out."""
    return f".{host.translate(_CONTROL)}{SEP}{path.translate(_CONTROL)}{SEP}{rest.partition('#')[0].translate(_CONTROL)}"


def pattern(rule: Rule | Glob) -> str:
    """The glob over the whole key: a rule takes its host after a dot and its path as a beginning."""
    if isinstance(rule, Rule):
        return f"*.{rule.host}{SEP}{rule.path}*"
    return f".{rule.host}{SEP}{rule.path}{SEP}*"


class ShiftAnd:
    """All patterns as masks over one row of 64-bit words.

    Bit p is set when the pattern's p literals or `?` before it have matched; each pattern also has a bit for its
    beginning. loops holds the bits after which a `*` stands, which stay set over any character.
    """

    def __init__(self, patterns: Sequence[str]) -> None:
        place, begin, finish, loops, any_char = 0, [], [], [], []
        chars: dict[str, list[int]] = {}
        for glob in patterns:
            begin.append(place)
            for c in glob:
                if c == "*":
                    loops.append(place)
                    continue
                place += 1
                (any_char if c == "?" else chars.setdefault(c, [])).append(place)
            finish.append(place)
            place += 1
        self.words = place // 64 + 1
        self.begin, self.loops, self.finish = self.mask(begin), self.mask(loops), finish
        chars.setdefault(SEP, [])  # so that there is one character at least
        self.codes = np.array(sorted(map(ord, chars)), dtype=np.uint32)
        every = self.mask(any_char)
        self.masks = np.stack([self.mask(chars[chr(c)]) | every for c in self.codes] + [every])

    def mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def accepted(self, keys: Sequence[str]) -> np.ndarray:
        """For each key and pattern whether the pattern fits the whole key."""
        lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        order, out = np.argsort(lengths, kind="stable"), np.zeros((len(keys), len(self.finish)), dtype=bool)
        i = 0
        while i < len(order):  # URLs of like lengths together, so that one long one doesn't widen the rest
            j = i + 1
            while j < len(order) and (j + 1 - i) * lengths[order[j]] <= CELLS and lengths[order[j]] <= 2 * lengths[order[i]] + 64:
                j += 1
            out[order[i:j]] = self._run([keys[k] for k in order[i:j]], lengths[order[i:j]])
            i = j
        return out

    def _run(self, keys: list[str], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths.max())
        text = np.array(keys, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(keys), -1)
        at = np.searchsorted(self.codes, text)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == text, at, len(self.codes))
        state, one, top = np.tile(self.begin, (len(keys), 1)), np.uint64(1), np.uint64(63)
        last = np.zeros_like(state)
        last[lengths == 0] = self.begin
        for step in range(width):
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.masks[at[:, step]]) | (state & self.loops)
            done = lengths == step + 1
            last[done] = state[done]
        return np.stack([(last[:, b // 64] >> np.uint64(b % 64)) & one for b in self.finish], axis=1).astype(bool)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[Glob] = GLOBS, *, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on every page's url.

    One row for each page: page_id, host, path, rule (the longest that fits, as host and path; of equally long ones the
    one with the longer host) and verdict: the rule's, else block if any blocking glob fits, else that of another glob that fits, else default. A null url or one without
    `://` has an empty host and path, and the default verdict. Repeated rows give a row each; other columns are not read.
    The rules are part of the task's code; a few thousand characters of them take a few words for each URL.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict))
    machine_of = [pattern(r) for r in ranked] + [pattern(g) for g in globs]
    verdicts, glob_verdicts = [r.verdict for r in ranked], [g.verdict for g in globs]

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        machine = ShiftAnd(machine_of)

        def judged(held: list[tuple]) -> Iterator[tuple]:
            parts = [split(u) for _, u in held]
            fits = machine.accepted([canonical(*p) for p in parts])
            for (page, _), (host, path, _), fit in zip(held, parts, fits, strict=True):
                rule = next((i for i in range(len(ranked)) if fit[i]), None)
                if rule is not None:
                    yield page, host, path, ranked[rule].name, verdicts[rule]
                else:
                    of = {v for v, f in zip(glob_verdicts, fit[len(ranked) :], strict=True) if f}
                    yield page, host, path, None, "block" if "block" in of else min(of, default=default)

        held: list[tuple] = []
        for row in given:
            held.append(row)
            if len(held) == 4096:
                yield from judged(held)
                held = []
        if held:
            yield from judged(held)

    return map_rows(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url")), rows, "page_id long, host string, path string, rule string, verdict string")
