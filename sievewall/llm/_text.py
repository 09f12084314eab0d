"""Whole batches of texts as numpy arrays: bytes, code points, words, hashes.

The hash of a stretch is a polynomial in an odd base modulo 2**64 over random
64-bit values of its bytes (or code points), then mixed. With running sums of
``value * base**i`` and powers of the inverse of the base, the hash of any
stretch costs a subtraction and a product, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values over all others."""
    x = np.array(x, np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def keys(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values of ``seed``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + mix(np.array([seed], np.uint64)))


_VALUES = keys(11, 256)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i in 0..n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _powers[:] = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][: n + 1], _powers[1][: n + 1]


def running(values: np.ndarray) -> np.ndarray:
    """Running sums, from which ``stretch`` takes the hash of any stretch."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Rows ``first``.. of a batch: their UTF-8 bytes, and where each row's begin (one more than rows)."""

    first: int
    data: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ends) - 1


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """The texts of an Arrow column in bounded pieces of whole rows. Null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield Chunk(row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row])
        row = last


@dataclass
class Words:
    """Words of a chunk: hash, first byte, byte after the last, and where each row's words begin."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ends: np.ndarray


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that aren't ASCII letters or digits; bytes over 127 belong to words.
NOT_ALNUM = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_a:_b] = False


def words(chunk: Chunk, breaks: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Maximal runs without ``breaks``, within rows; ASCII capitals count as small letters if ``lower``."""
    data = _LOWER[chunk.data] if lower else chunk.data
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[chunk.ends] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(stretch(running(_VALUES[data]), start, end), start, end, np.searchsorted(start, chunk.ends))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row, the first word of each, and where each row's begin.

    A row with fewer words, but at least one, has all its words as its only shingle.
    """
    count = np.diff(w.ends)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ends = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    first = np.arange(ends[-1]) + np.repeat(w.ends[:-1] - ends[:-1], n)
    length = np.repeat(np.minimum(count, k), n)
    return stretch(running(w.hashes), first, first + length), first, ends


def rows_of(ends: np.ndarray) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def distinct(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row in ascending order, and where each row's begin."""
    hashes = hashes.copy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes) + 1, bool)
    new[1:-1] = hashes[1:] != hashes[:-1]
    new[ends] = True
    out = np.concatenate([[0], np.cumsum(new[:-1])])[ends]
    return hashes[new[:-1]], out


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays of distinct values have in common."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, ends: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each row's values; ``empty`` for rows without any."""
    out = np.full(len(ends) - 1, empty, values.dtype)
    some = np.diff(ends) > 0
    if some.any():
        out[some] = ufunc.reduceat(values, ends[:-1][some])
    return out


def minhash(hashes: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A matrix: for each row and seed, the least 32-bit hash of the row's values."""
    out = np.full((len(ends) - 1, len(seeds)), 0xFFFFFFFF, np.uint32)
    for k, seed in enumerate(seeds):
        salted = (((hashes ^ seed) * (seed | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = reduce_rows(np.minimum, salted, ends, np.uint32(0xFFFFFFFF))
    return out


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts end to end, and where each text's begin."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return data, ends


def text_lists(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """As ``chunks``, but Python strings with the number of the first row."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and size + len(text) > limit:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts
