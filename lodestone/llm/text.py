"""Vectorised hashing of the words of many texts at once, shared by the operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: \x20 and \x09-\x0D separate words, which is what ``bytes.split()`` cuts at too.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are not part of a plain word: ASCII other than letters and digits.
NOT_ALNUM = np.ones(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    NOT_ALNUM[_c] = False
NOT_ALNUM[128:] = False

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data``, with where each starts and ends.

    The hash of a word is a polynomial in an odd base, so it can be summed at the
    word's place in the buffer and moved to the origin by the inverse base.
    """
    buf = np.frombuffer(data, np.uint8)
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separator[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    terms = (buf.astype(np.uint64) + np.uint64(1)) * inside[1:-1].astype(np.uint64)
    terms *= _power("up", _R, len(buf))
    sums = np.add.reduceat(terms, starts)
    return mix(sums * _power("down", _R_INV, len(buf))[starts]), starts, ends


def run_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of every run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    salted = mix(words ^ np.uint64(salt)) if salt else words
    np.cumsum(salted * _power("up", _R, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _power("down", _R_INV, len(words))[:n])


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in ascending order; sorting is faster here than hashing them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def blocks(lengths: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of rows holding about ``most`` bytes each, one row at least."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if lengths:
        out.append((begin, len(lengths)))
    return out


def text_blocks(column: pa.Array, most: int) -> Iterator[list[str | None]]:
    """The texts of a column in lists of about ``most`` bytes each, so that a batch is never held as Python objects whole."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in blocks(sizes, most):
        yield column.slice(a, b - a).to_pylist()


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
