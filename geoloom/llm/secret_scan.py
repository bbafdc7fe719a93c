"""Secret scans: patterns, and values in a credential's place whose cheapest guess is still dear.

The cost of a value is the least, over all ways to cut it into words, dates, repeats, runs along the
keyboard or the alphabet and single characters, of the sum of the parts' costs (log10 of the guesses
an attacker who knows such parts would need).

Words have ranks: first the common passwords below, then the whole words of a public tokenizer's vocabulary in the
order of their ids, then the most frequent words of all documents (one aggregate, at most WORDS of them come back).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heappop, heappush
from math import log10

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows

# The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "guess")

#: Words that a credential stands after. The first group ends no other word, so it counts at the end of any identifier; the second must begin a word: after no letter, or
#: in upper case after one in lower case.
_WORD = (
    r"(?:(?ai:pwd|passwd|password|passphrase|passcode|passwort|kennwort|contrase(?:n|\u00f1)a|mot\x20de\x20passe|credentials?|(?:access|private|api|secret|signing|encryption)[_-]?key|client_?id|session_?id)"
    r"|(?<![A-Za-z])(?ai:pass|pin|mdp|auth(?:orization)?|bearer|login|secret|token)|(?<=[a-z])(?:Pass|Pin|Auth(?:orization)?|Bearer|Login|Secret|Token))"
)
#: Such a word, a sign (that may end its line), and a value in quotes or without spaces.
CONTEXT = re.compile(_WORD + r"""["']?\]?[ \t]*(?:=>|:=|[:=])[ \t]*(?:\r?\n[ \t]*)?(?:"([^"\n]+)"|'([^'\n]+)'|["']?(?:(?ai:bearer|basic|digest)[ \t]+)?([^\s"'<>,;]+))""")
#: Values elsewhere: between the user and the host of a URL, and as an element named so.
ELSEWHERE = (re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]*:([^\s/@]+)@"), re.compile(rf"<[\w.:-]*?{_WORD}>\s*([^<>\s]+)\s*</"))
#: What an authorization begins with, and words whose values in quotes may be phrases; elsewhere a text with spaces is prose.
SCHEME, PHRASE = re.compile(r"(?ai:bearer|basic|digest|token)[ \t]+"), re.compile(r"(?i:pass|pwd|kennwort|contrase|mdp|credential)")
#: No less than the characters of such a word with its quote and its sign: one may end a value.
TAIL = 32
#: Values that aren't literal: calls, lookups, variables and templates; and those that say so themselves.
CODE = re.compile(r"[A-Za-z_][A-Za-z_.]*[(\[]|\$[A-Za-z_{(]|\{\{|%[({]")
PLACEHOLDER = re.compile(r"(?i:(?:^|[-_.:/])(?:your|example|placeholder|changeme|insert|redacted|dummy|sample|todo|x{3,})(?:$|[-_.:/]))")
#: log10 of the guesses from which a value counts as a secret.
COST = 9.0
#: The most frequent words of the documents that are taken, and the least number of times that one must occur.
WORDS, LEAST_COUNT = 20_000, 20
#: Characters of a part that is less than all of a repeat or run at most; whole ones are taken at any length.
PART = 64
#: A cost from here on isn't told apart: no attacker tries so many, and a value's cut ends where all ways are as dear.
DEAREST = 60.0
#: Each level of hashes, by which units beyond PART are found, is of stretches so many times as long as the one before.
WIDER = 8

# Words that passwords are made of, the most common first.
COMMON = """password admin welcome login letmein master secret qwerty dragon monkey shadow sunshine princess football
baseball superman batman trustno hello freedom whatever summer winter spring autumn love iloveyou
access flower computer internet server system root user test guest demo example sample default changeme change
money soccer hockey killer george michael jordan daniel thomas robert andrew joshua charlie jessica jennifer
ashley amanda nicole pepper ginger cookie chocolate banana orange purple silver golden tiger eagle falcon
phoenix ranger hunter hammer thunder matrix star wars starwars pokemon google apple samsung yellow green black white blue red
pass word key token api private public data base null none true false your here insert placeholder redacted""".split()
LONGEST = 24
LEET = str.maketrans("4@301!$57", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: What stands between words, and the cost of one such character there.
BETWEEN, BETWEEN_COST = "-_. ", log10(4)


def _neighbours() -> dict[str, set[str]]:
    place = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return {c: {d for d, (s, j) in place.items() if d != c and abs(r - s) <= 1 and -1 <= j - i + (s - r) * 0.5 <= 1} for c, (r, i) in place.items()}


NEAR = _neighbours()
_Y, _M, _D, _SEP = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"([-/._]?)"
#: A year, and dates in three orders, each with one sign or none between its parts; any may begin at any place.
DATES = tuple((re.compile(f"(?=({p}))"), cost) for p, cost in ((_Y, log10(200)), *((f"{a}{_SEP}{b}\\2{c}", log10(200 * 372)) for a, b, c in ((_Y, _M, _D), (_D, _M, _Y), (_M, _D, _Y)))))
#: The ways that one character leads to the next in a run: the test, the cost of a run, and that of each character beyond three.
STEPS = (
    (lambda a, b: b in NEAR.get(a, ()), log10(47 * 2.5), 0.35),
    (lambda a, b: ord(b) - ord(a) == 1 and a.isalnum(), log10(26), 0.0),
    (lambda a, b: ord(a) - ord(b) == 1 and a.isalnum(), log10(52), 0.0),
)


@lru_cache(maxsize=4)
def public_words(path: str | None) -> tuple[str, ...]:
    """The whole words of three letters and more of a tokenizers file, in lower case, in the order of their ids; none without a file."""
    if path is None:
        return ()
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    bare = (re.fullmatch(r"(?:Ġ|▁)?([^\W\d_]{3,24})(?:</w>)?", w) for w in sorted(ids, key=ids.get) if w.endswith("</w>") or w[0] in "Ġ▁")
    return tuple(dict.fromkeys(m[1].lower() for m in bare if m))


def ranks(*lists: Iterable[str]) -> dict[str, int]:
    """The rank, from 1, of every word of these lists one after another."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(w for words in (COMMON, *lists) for w in words if 3 <= len(w) <= LONGEST))}


def corpus_words(docs: DataFrame, text: str = "text", most: int = WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The most frequent words of three letters and more of all documents; at most so many, each at least so often there.

    The driver gets counts of words by size first, and then hardly more words than asked for, however many partitions hold them.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{M}]+")).alias("w")).where(F.length("w").between(3, LONGEST))
    counts = checkpointed(words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    size = F.floor(F.log2("n") * 16).cast("int")
    left, lowest = most, 0
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        left, lowest = left - r["count"], r["size"]
        if left <= 0:
            break
    return [r["w"] for r in counts.where(size >= lowest).orderBy(F.desc("n"), "w").limit(most).collect()]


def _alone(c: str) -> float:
    """The cost of a character that nothing explains."""
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log10(26)
    return log10(33) if c.isascii() else 2.5


class _Value:
    """The parts that begin at each place of a value, found where they are asked for."""

    def __init__(self, value: str, rank: dict[str, int], known: dict[str, float]) -> None:
        self.value, self.rank, self.known = value, rank, known
        low = value.lower()
        if len(low) != len(value):  # a capital whose lower case is longer: only ASCII is lowered then
            low = "".join(c.lower() if c.isascii() else c for c in value)
        self.low, self.forms = low, {low, low.translate(LEET)}
        self.ends = [0] * len(STEPS)
        self.stretches: dict[int, tuple[int, int]] = {}  # of each unit's length the start and end of the last stretch met that repeats after it
        self.hashes: list[tuple[int, np.ndarray]] = []

    def _same(self, a: int, b: int) -> int:
        """How many characters from a on are those from b on, which is after a."""
        value, n, k, step = self.value, len(self.value), 0, PART
        while b + k + step <= n and value[a + k : a + k + step] == value[b + k : b + k + step]:
            k, step = k + step, step * 2
        while step > 1:
            step //= 2
            if b + k + step <= n and value[a + k : a + k + step] == value[b + k : b + k + step]:
                k += step
        return k

    def _stretch(self, i: int, unit: int) -> int:
        """The end of the stretch from i on that repeats after so many characters; 0 if they don't fit in it twice."""
        start, end = self.stretches.get(unit, (0, 0))
        if start <= i <= end - unit:  # the character at end differs from the one a unit before
            return end if i + 2 * unit <= end else 0
        if self.value[i] != self.value[i + unit]:
            return 0
        end = i + unit + self._same(i, i + unit)
        self.stretches[unit] = i, end
        return end if i + 2 * unit <= end else 0

    def _levels(self) -> list[tuple[int, np.ndarray]]:
        """Hashes of the stretches that begin at each place, of PART characters and of WIDER times as many again and again, as far as two fit."""
        if not self.hashes:
            h = np.frombuffer(self.value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) * np.uint32(0x9E3779B1)
            size, wanted = 1, PART
            while 2 * wanted <= len(self.value):
                while size < wanted:
                    h = h[:-size] * np.uint32(0x85EBCA6B) + h[size:]
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                    size *= 2
                self.hashes.append((size, h))
                wanted *= WIDER
        return self.hashes

    def _repeats(self, i: int) -> Iterator[tuple[int, int]]:
        """(length, end) of every unit that stands at i twice or more in a row, and of the stretch it repeats in; units beyond LONGEST, which no word covers, only if they aren't repeats themselves.

        A unit that fits twice in the stretch of a shorter one is a repeat itself (two periods of a stretch as long as both have their divisor as a period).
        """
        value, n, far = self.value, len(self.value), i
        for unit in range(1, min((n - i) // 2, PART) + 1):
            if (unit <= LONGEST or i + 2 * unit > far) and (end := self._stretch(i, unit)):
                far = max(far, end)
                yield unit, end
        least = max(PART, (far - i) // 2) + 1
        if i + 2 * least > n or value.find(value[i : i + PART], i + least) < 0:
            return
        for size, h in self._levels():
            if i + 2 * size > n:
                return
            # Both ends of the unit must be met again one unit later; what passes is compared whole.
            units = np.arange(max(least, size), min(size * WIDER, (n - i) // 2 + 1))
            units = units[h[i + units] == h[i]]
            units = units[h[i + units - size] == h[i + 2 * units - size]]
            while len(units):
                unit = int(units[0])
                end = i + unit + self._same(i, i + unit)
                if i + 2 * unit <= end:
                    yield unit, end
                    least = max(least, (end - i) // 2 + 1)
                units = units[units >= max(least, unit + 1)]

    def at(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, cost) of every word, date, repeat and run that begins at i, and of a sign between words."""
        value, low, n = self.value, self.low, len(self.value)
        for form in self.forms:
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                if r := self.rank.get(form[i:j]):
                    yield j, log10(r) + (value[i:j] != form[i:j]) * log10(2 * (j - i)) + 0.3
        if value[i] in BETWEEN and 0 < i < n - 1 and value[i - 1].isalpha() and value[i + 1].isalpha():
            yield i + 1, BETWEEN_COST
        for pattern, cost in DATES:
            if m := pattern.match(value, i):
                yield m.end(1), cost + (not m[1].isdigit()) * log10(4)
        for unit, stretch in self._repeats(i):
            times = (stretch - i) // unit
            price = guess_cost(value[i : i + unit], self.rank, self.known)
            if price < DEAREST:
                # The last ones too: a word may begin within the stretch.
                for k in {*range(2, min(times, max(8, PART // unit)) + 1), *range(max(2, times - LONGEST // unit), times + 1)}:
                    if k * unit >= 3:
                        yield i + k * unit, price + log10(k)
        for s, (step, cost, more) in enumerate(STEPS):
            if self.ends[s] <= i:
                last = i
                while last < n - 1 and step(low[last], low[last + 1]):
                    last += 1
                self.ends[s] = last + 1
            for j in {*range(i + 3, min(i + PART, self.ends[s]) + 1), self.ends[s]}:
                if j >= i + 3:
                    yield j, cost + log10(j - i) + (low[i:j] != value[i:j]) * 0.3 + more * (j - i - 2)


def guess_cost(value: str, rank: dict[str, int], known: dict[str, float] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of value, DEAREST at most.

    A repeat costs as much as its unit's own cheapest segmentation, and the number of times. Only places that are reached for less than DEAREST are looked at, so a long value that nothing explains
    ends soon. known has the costs of units met before.
    """
    known = {} if known is None else known
    n = len(value)
    # Long units are known by a digest, so that they aren't kept.
    name = value if n <= PART else blake2b(value.encode("utf-8", "surrogatepass")).hexdigest()
    if name in known:
        return known[name]
    best, todo = {0: 0.0}, [0]
    cut = _Value(value, rank, known) if n else None
    while todo:
        i = heappop(todo)
        if i == n:
            break
        so_far = best[i]
        for end, cost in ((i + 1, _alone(value[i])), *cut.at(i)):
            if (total := so_far + cost) < min(best.get(end, DEAREST), DEAREST):
                if end not in best:
                    heappush(todo, end)
                best[end] = total
    known[name] = best.get(n, DEAREST)
    return known[name]


def find(text: str, rank: dict[str, int], cost: float = COST) -> list[tuple[int, int, int, float | None]]:
    """(start, kind's number, end, cost) of every span in text, in order; patterns' spans have a cost only after a credential's word."""
    found: list[tuple[int, int, int, float | None]] = [(m.start(), 0, m.end(), guess_cost(m[2], rank)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    taken, at = [(a, b) for a, _, b, _ in found], 0

    def take(start: int, end: int) -> None:
        """Adds a value that is literal, not all in a span found before, and dear to guess."""
        value = text[start:end]
        if not CODE.match(value) and not PLACEHOLDER.search(value) and not any(a <= start and end <= b for a, b in taken) and (price := guess_cost(value, rank)) >= cost:
            found.append((start, 3, end, price))
            taken.append((start, end))

    if ":" in text or "=" in text:
        while m := CONTEXT.search(text, at):
            start, end = m.span(m.lastindex)
            if m.lastindex < 3:
                if scheme := SCHEME.match(text, start, end):
                    start = scheme.end()
                if re.search(r"\s", text[start:end]) and not PHRASE.search(text, m.start(), m.start(m.lastindex)):
                    end = start + len(text[start:end].split(None, 1)[0]) if text[start:end].strip() else start
            if end > start:
                take(start, end)
            at = max(m.start(m.lastindex), m.end() - TAIL)
    for pattern in ELSEWHERE:
        for m in pattern.finditer(text) if ":" in text or "</" in text else ():
            take(*m.span(1))
    return sorted(found, key=lambda x: x[:3])


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cost: float = COST, vocabulary: str | None = None, words: int = WORDS) -> DataFrame:
    """Finds secrets in every whole text.

    One row for each document: doc_id and findings, an array of (kind, start, end, guesses_log10) by start and
    then kind; places are in characters, the end exclusive. The kinds assign, access and hex are patterns and
    always kept; guess is a value after a credential's word, not all in one of those, whose cheapest guess needs
    10 ** cost tries at least, so that words, placeholders and common passwords are left alone; code (calls, variables) is too.
    Null texts are empty and have no findings; repeated rows give a row each; other columns are not read; an empty table gives no rows.

    vocabulary: the path of a tokenizers file whose whole words are known; words: how many frequent words of the documents are.
    """
    spark = docs.sparkSession
    frequent = corpus_words(docs, text, words) if words else []
    sent = spark.sparkContext.broadcast(frequent)

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        rank = ranks(public_words(vocabulary), sent.value)
        for doc, t in given:
            yield doc, [{"kind": KINDS[k], "start": a, "end": b, "guesses_log10": g} for a, k, b, g in find(t or "", rank, cost)]

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), rows, "doc_id long, findings array<struct<kind:string,start:int,end:int,guesses_log10:double>>")


def digest(found: DataFrame, cost: float = COST) -> DataFrame:
    """The scan's counts by kind, a hash of the patterns' spans, all spans, and a verdict.

    n_weak counts the assigned values that fewer than 10 ** cost guesses find (placeholders and common words); leaks is whether
    anything else was found.
    """
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    weak = lambda s: (s["kind"] == "assign") & (s["guesses_log10"] < cost)
    base = F.filter("findings", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("findings")).alias("spans"), of("guess"),
        F.size(F.filter("findings", weak)).cast("long").alias("n_weak"), F.exists("findings", lambda s: ~weak(s)).alias("leaks"),
    )
