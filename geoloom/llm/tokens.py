"""Exact, cached tokenisation by the pieces that a tokenizer's own pattern cuts.

Both byte-pair vocabularies used here merge only inside such pieces, so the ids of a text are the
ids of its pieces one after another. Pieces repeat, so each worker keeps their ids. Texts with
characters beyond those whose classes are stated here go through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from sys import byteorder

from .common import kept

#: Entries of a worker's cache; it starts anew when full.
CACHE_ENTRIES = 400_000
#: The fast path takes texts of characters below this one: their classes and lower case are the same in every Unicode version, and composing leaves them alone.
PLAIN_LIMIT = 0x180
#: Of these only the capital I with a dot above lower-cases to more than one character.
ODD = "İ"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_LIMIT) if unicodedata.category(chr(c))[0] == kind and chr(c) not in ODD)


# The tokenizers' patterns, with their character classes written out below PLAIN_LIMIT.
_L, _N, _S = _class("L"), _class("N"), " \t\n\x0b\x0c\r\x85\xa0"
# Alternatives that begin with letters come first, as most pieces do; no text fits two of them at a place but those in their own order.
WORD_PIECES = re.compile(rf"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_S}{_L}{_N}]+")
BYTE_PIECES = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile(rf"[^\x00-{chr(PLAIN_LIMIT - 1)}]|{ODD}")


def plain(text: str) -> bool:
    """Whether the pieces of text are those of the patterns above, and no special token's string is in it."""
    return (text.isascii() or not _BEYOND.search(text)) and "<|" not in text


def spaced(text: str) -> bool:
    """Whether plain text has no white space but line feeds and single spaces between other characters (or one at its start)."""
    return "  " not in text and " \n" not in text and "\n " not in text and text[-1:] != " " and not any(c in text for c in "\t\x0b\x0c\r\x85\xa0")


def _byte_letters() -> dict[int, int]:
    """For each byte, as a Latin-1 character, the letter that stands for it in the vocabularies: itself if it is printed, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_SEPARATORS = re.compile("[\x1c-\x1f]")


def tokenizer(path: str):
    """The library's tokenizer of a .json file, one in each worker; it uses no threads of its own."""
    return kept(f"tokenizer {path}", lambda: _loaded(path))


def _loaded(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


class _Words(dict):
    """A stretch of plain text whose pieces its surroundings can't change -> what made() makes of its ids.

    The text is before + key. pattern cuts it into pieces and the library's model merges each.
    """

    def __init__(self, path: str, pattern: re.Pattern, made: Callable[[list[int]], object], before: str = "") -> None:
        super().__init__()
        self.model, self.pattern, self.made, self.before = tokenizer(path).model, pattern, made, before

    def __missing__(self, key: str) -> object:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        letters = (self.before + key).encode().decode("latin-1")
        if letters.isascii():
            pieces = self.pattern.findall(letters)
        else:
            pieces = [p.encode().decode("latin-1") for p in self.pattern.findall(self.before + key)]
        made = self.made([t.id for p in pieces for t in self.model.tokenize(p.translate(_LETTERS))])
        if len(key) <= 64:
            self[key] = made
        return made


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


@lru_cache(maxsize=8)
def word_ids(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids, as little-endian unsigned 32-bit integers, for a vocabulary that lower-cases and drops white space."""
    ids = _Words(path, WORD_PIECES, _packed)
    library = tokenizer(path)

    def encode(text: str) -> bytes:
        if not plain(text):
            return _packed(library.encode(text, add_special_tokens=False).ids)
        if _SEPARATORS.search(text):  # split() takes these for white space
            return ids.__missing__(text.lower())
        return b"".join(map(ids.__getitem__, text.lower().split()))

    return encode


@lru_cache(maxsize=8)
def word_counts(path: str) -> tuple[dict[str, int], dict[str, int]]:
    """The worker's token counts of stretches of text under a byte-level vocabulary: of those as they are, and of those after a space."""
    return _Words(path, BYTE_PIECES, len), _Words(path, BYTE_PIECES, len, " ")
