"""Hashed word shingles and MinHash signatures of texts, vectorised over each text's characters."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WIDTH = 5
#: MinHash values of a signature, and how many of them make the key of a band.
PERMUTATIONS, ROWS = 160, 5

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SEPARATE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Powers up to this one are kept; those of a longer text are made for it alone.
_KEPT_POWERS = 1 << 18


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least n of both."""
        if len(cls.up) >= n:
            return cls.up, cls.down
        made = []
        for base in (_BASE, _INVERSE):
            step = np.full(max(n, _KEPT_POWERS), base, dtype=np.uint64)
            step[0] = 1
            made.append(np.cumprod(step, dtype=np.uint64))
        if n <= _KEPT_POWERS:
            cls.up, cls.down = made
        return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str | None) -> bytes:
    """The text's words (letters, digits and characters beyond ASCII, in lower case) between single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SEPARATE).split())


def identity(words: bytes) -> bytes:
    """What texts with the same words share."""
    return blake2b(words, digest_size=16).digest()


def shingles(words: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of width consecutive words; of all words where there are fewer; none without words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    chars = np.frombuffer(words, dtype=np.uint8)
    up, down = _Powers.to(len(chars) + 1)
    gaps = np.flatnonzero(chars == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(chars)]))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[chars] * up[: len(chars)], dtype=np.uint64)))
    word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    size = min(width, len(word))
    made = np.zeros(len(word) - size + 1, dtype=np.uint64)
    for j in range(size):
        made += word[j : len(word) - size + 1 + j] * _PLACE[j]
    return np.unique(mix(made + np.uint64(size)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """PERMUTATIONS MinHash values of at least one hash: the lower 16 bits of the least 32-bit values.

    Two different least values have the same lower bits once in 65,536 times, so matches are hardly more than with all
    bits, and never fewer.
    """
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096, None] * _A + _B).min(axis=0), out=out)
    return out.astype(np.uint16)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS values; keys of different bands differ."""
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64) * _PLACE[40]
    for j in range(ROWS):
        keys = mix(keys + rows[:, j] * _PLACE[20 + j] + np.uint64(j))
    return keys.view(np.int64)


def first_shared_band(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row of two arrays of signatures the first band in which they are equal; they must share one."""
    return (one == other).reshape(len(one), -1, ROWS).all(axis=2).argmax(axis=1)
