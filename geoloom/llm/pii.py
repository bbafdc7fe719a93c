"""Format-preserving pseudonyms for personal numbers, dates and addresses.

A value that its own rules prove valid is mapped to its place among all valid values of its format, that
place is permuted by a keyed Feistel network, and the value at the new place is written in the old one's
layout. Equal values get equal pseudonyms in every document, other values other ones, and with the key
the map can be undone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

ROUNDS = 8
#: Only stands in where a query's session names no key: pseudonyms made with it can be undone by anyone.
OPEN_KEY = b"not a secret: set spark.geoloom.pii.key"
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    data = tweak + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    width = min(64, (size.bit_length() + 7) // 8 + 8)
    return int.from_bytes(blake2b(data, digest_size=width, key=key).digest(), "big") % size


def permute(key: bytes, tweak: bytes, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): ROUNDS Feistel rounds over two digits of nearly equal radix, walked on while outside."""
    if size < 2:
        return x
    left = isqrt(size - 1) + 1
    right = -(-size // left)
    while True:
        a, b = divmod(x, right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * _round(key, tweak, i, a, right)) % right
            else:
                a = (a + sign * _round(key, tweak, i, b, left)) % left
        x = a * right + b
        if x < size:
            return x


def luhn_digit(digits: str) -> str:
    """The check digit after these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def refill(layout: str, chars: str, is_slot: Callable[[str], bool]) -> str:
    """layout with its slots filled with chars, in order."""
    new = iter(chars)
    return "".join(next(new) if is_slot(c) else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def _mixed(chars: str) -> tuple[int, int]:
    """The place of chars among those with letters and digits at the same spots, and their number."""
    x, size = 0, 1
    for c in chars:
        radix = 10 if c.isdigit() else 26
        x, size = x * radix + (int(c) if c.isdigit() else ord(c.lower()) - 97), size * radix
    return x, size


def _unmixed(layout: str, x: int) -> str:
    out = []
    for c in reversed(layout):
        x, d = divmod(x, 10 if c.isdigit() else 26)
        out.append(str(d) if c.isdigit() else chr(d + (65 if c.isupper() else 97)))
    return "".join(reversed(out))


Permute = Callable[[bytes, int, int], int]


def email(value: str, p: Permute) -> str | None:
    local, at, domain = value.partition("@")
    plain = "".join(c for c in local if c.isascii() and c.isalnum())
    x, size = _mixed(plain)
    tweak = re.sub(r"[a-zA-Z]", "a", re.sub(r"[0-9]", "0", local)).encode()
    return refill(local, _unmixed(plain, p(b"email" + tweak, x, size)), lambda c: c.isascii() and c.isalnum()) + at + domain


def iban(value: str, p: Permute) -> str | None:
    plain = value.replace(" ", "")
    remainder = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    if not 15 <= len(plain) <= 34 or remainder(plain) != 1:
        return None
    body = plain[4:]
    x, size = _mixed(body)
    layout = re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", body)).encode()
    body = _unmixed(body, p(b"iban" + plain[:2].encode() + layout, x, size))
    check = f"{98 - remainder(plain[:2] + '00' + body):02d}"
    return refill(value, plain[:2] + check + body, lambda c: c != " ")


def card(value: str, p: Permute) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = f"{p(b'card%d' % len(d), int(d[:-1]), 10 ** (len(d) - 1)):0{len(d) - 1}d}"
    return refill(value, body + luhn_digit(body), _is_digit)


def ssn(value: str, p: Permute) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(p(b"ssn", place, 898 * 99 * 9999), 9999)
    area, group = divmod(x, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(value: str, p: Permute) -> str | None:
    d = _digits(value)
    if not 8 <= len(d) <= 15:
        return None
    kept = (1 if d[0] in "17" else 2) if value.startswith("+") else 0  # the country's code, or its beginning
    rest = f"{p(b'phone' + d[:kept].encode() + b'/%d' % len(d), int(d[kept:]), 10 ** (len(d) - kept)):0{len(d) - kept}d}"
    return refill(value, d[:kept] + rest, _is_digit)


def ip(value: str, p: Permute) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, p(b"ip", int.from_bytes(bytes(parts), "big"), 2**32).to_bytes(4, "big")))


def day(value: str, p: Permute) -> str | None:
    """A date within its century, written in the same order of day and month.

    Years that come first are followed by the month; between points the day comes first; else day and month come as only one
    order is valid, or the day first. Days beyond the 12th stay beyond it and others don't get there (the permutation is walked on
    until that holds), so that a date reads in the same orders as before, and each order has a permutation of its own dates.
    """
    sep = next(c for c in value if not c.isdigit())
    parts = value.split(sep)
    y, m, d = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    if y and sep != "." and int(parts[m]) > 12:
        m, d = d, m
    try:
        when = date(int(parts[y]), int(parts[m]), int(parts[d]))
    except ValueError:
        return None
    first = date(when.year // 100 * 100 or 1, 1, 1)
    size = (date(min(when.year // 100 * 100 + 99, 9999), 12, 31) - first).days + 1
    place, new = (when - first).days, None
    while new is None or (new.day > 12) != (when.day > 12):
        place = p(b"date%d" % first.year, place, size)
        new = first + timedelta(days=place)
    parts[y], parts[m], parts[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return sep.join(parts)


# The formats, the first of two that fit at a place being taken. Numbers stand alone: no letter, digit or sign of a longer number touches them.
_ALONE, _END = r"(?<![\w.@+-])", r"(?![\w@]|[-.]\d)"
FORMATS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), email),
    ("iban", re.compile(_ALONE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?" + _END), iban),
    ("card", re.compile(_ALONE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})" + _END), card),
    ("ssn", re.compile(_ALONE + r"\d{3}-\d{2}-\d{4}" + _END), ssn),
    ("ip", re.compile(_ALONE + r"\d{1,3}(?:\.\d{1,3}){3}" + _END), ip),
    ("date", re.compile(_ALONE + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})" + _END), day),
    ("phone", re.compile(r"(?<![\w.@+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,5}|\d{3}([ .-])\d{3}\1\d{4})" + _END), phone),
)
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of the values in the text as it was. back: undoes it.

    Values are taken from left to right; of overlapping ones the leftmost, then the first format, counts.
    """
    if not _HINT.search(text):
        return text, []

    def p(tweak: bytes, x: int, size: int) -> int:
        return permute(key, tweak, x, size, back)

    found = []
    for rank, (kind, pattern, new) in enumerate(FORMATS):
        for m in pattern.finditer(text):
            if (made := new(m[0], p)) is not None:
                found.append((m.start(), rank, m.end(), kind, made))
    out, spans, at = [], [], 0
    for start, _, end, kind, made in sorted(found):
        if start >= at:
            out += [text[at:start], made]
            spans.append((kind, start, end))
            at = end
    return "".join([*out, text[at:]]), spans


def protect(docs: DataFrame, key: bytes, *, doc_id: str = "doc_id", text: str = "text", open_key: bool = False) -> DataFrame:
    """Every document's text with pseudonyms for what is personal in it.

    One row for each document: doc_id, text and found, an array of (kind, start, end) in the text as it was. Kinds:
    email (letters and digits of the name), iban (valid check digits), card (valid Luhn digit), ssn, phone, ip (octets to
    255) and date (in the calendar, permuted within its century). Numbers that fail their check are left as they are. A null
    text stays null with nothing found; null ids stay null; repeated rows give a row each; other columns are not read; an empty
    table gives no rows. OPEN_KEY is refused but with open_key.
    """
    if key == OPEN_KEY and not open_key:
        raise ValueError("this key is no secret")
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        for doc, t in given:
            new, spans = pseudonymise(t, key) if t is not None else (None, [])
            yield doc, new, [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), rows, "doc_id long, text string, found array<struct<kind:string,start:int,end:int>>")


def digest(protected: DataFrame) -> DataFrame:
    """The protected texts with the numbers of values by kind, and the spans."""
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return protected.select("doc_id", "text", *[of(k) for k in KINDS], F.col("found").alias("spans"))
