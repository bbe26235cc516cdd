"""Vectorised 64-bit fingerprints of byte strings, words and word windows.

A fingerprint of bytes is a polynomial over a random value per byte, modulo 2**64
with an odd base, taken from prefix sums; so all substrings of one length, or all
words of a text, are hashed by a few array operations.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: What separates plain words: ASCII apart from letters and digits.
NO_WORD = np.zeros(256, dtype=bool)
NO_WORD[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NO_WORD[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        _powers = np.full(size, _BASE, dtype=np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        _inverses = np.full(size, _INVERSE, dtype=np.uint64)
        _inverses[0] = 1
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``spans`` takes the fingerprint of any substring."""
    n = len(data)
    powers, _ = _grown(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * powers[:n], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the substrings [start, end)."""
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without ``gaps``, by default ASCII white space."""
    edge = np.diff(np.concatenate(([True], gaps[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def words(text: bytes, gaps: np.ndarray = _SPACE) -> np.ndarray:
    """Fingerprints of the words of a text, A-Z lower-cased."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = word_bounds(data, gaps)
    return spans(prefix_sums(data), starts, ends)


def among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``; unlike a set operation it does not read all of ``known`` each time."""
    if not len(known):
        return np.zeros(values.shape, dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def word_prefixes(
    text: bytes, lengths: tuple[int, ...], known: np.ndarray | None = None, gaps: np.ndarray = NO_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word, A-Z lower-cased: fingerprints of the whole and of its prefixes of some falling lengths in bytes, and its bounds.

    The first row is of whole words, told apart from equal prefixes; 0 where a word is shorter.
    With ``known``, sorted fingerprints that hold with any unit its prefixes as well, a word whose
    shortest prefix is not among them has no unit there, and gets zeros.
    """
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = word_bounds(data, gaps)
    sums = prefix_sums(data)
    out = np.zeros((1 + len(lengths), len(starts)), dtype=np.uint64)
    size = ends - starts
    asked = np.arange(len(starts))
    if known is not None:
        long = np.flatnonzero(size >= lengths[-1])
        long = long[among(known, spans(sums, starts[long], starts[long] + lengths[-1]))]
        asked = np.sort(np.concatenate((np.flatnonzero(size < lengths[-1]), long)))
    out[0, asked] = mix(spans(sums, starts[asked], ends[asked]))
    for row, length in zip(out[1:], lengths, strict=True):
        some = asked[size[asked] >= length]
        row[some] = spans(sums, starts[some], starts[some] + length)
    return out, starts, ends


def windows(items: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of ``width`` consecutive items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    powers, _ = _grown(width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += items[k : k + n] * powers[k + 1]
    return mix(out)
