"""Token ids of whole batches by a byte-level BPE of the ``tokenizers`` library.

BPE never merges across the pieces that the vocabulary's split pattern cuts, so
ids need computing once for each different piece. Cutting, hashing and looking up
are array operations; only pieces that a worker hasn't met go to the library.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from . import _text

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pieces that a worker keeps; beyond that it starts again.
KEPT = 1_000_000
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_FEED, _BLANK, _QUOTE = 10, 32, 39


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c in "LN":
            out[i] = LETTER if c == "L" else NUMBER
    out[_WHITE] = SPACE
    return out


def pieces(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of the split pattern begin, over code points of texts end to end.

    The pattern: contractions after an apostrophe; an optional blank and letters, numbers, or other
    characters; white space, whose last character goes to a following piece if it is a blank.
    """
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[ends] = True
    last = first[1:]
    begins = first[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before = np.zeros(n, bool)  # the last white space before something else in the same text
    before[:-1] = space[:-1] & ~space[1:]
    before &= ~last
    begins |= before
    joins = np.flatnonzero(before & (cp == _BLANK)) + 1
    begins[joins] = False
    quote = np.flatnonzero((cp == _QUOTE) & begins & ~last)
    if len(quote):
        one = np.isin(cp[quote + 1], [115, 116, 109, 100])
        nxt = np.minimum(quote + 2, n - 1)
        two = ~last[quote + 1] & (quote + 2 < n)
        pair = cp[quote + 1] * np.uint32(256) + cp[nxt]
        two &= np.isin(pair, [114 * 256 + 101, 118 * 256 + 101, 108 * 256 + 108]) & (cp[quote + 1] < 256) & (cp[nxt] < 256)
        for at, size in ((quote[one], 1), (quote[two & ~one], 2)):
            begins[at + 1] = False
            after = at + 1 + size
            begins[after[after < n]] = True
    return np.flatnonzero(begins)


class Ids:
    """Token ids by ``path``, a file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._values = _text.keys(23, 0x10000)
        self._reset()

    def _reset(self) -> None:
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.known, self.flat, self.cuts = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of single pieces. Pieces of letters go to the library many at once, with line feeds between."""
        out: list[list[int]] = [[]] * len(texts)
        words = [i for i, t in enumerate(texts) if t.lstrip(" ").isalpha()]
        rest = sorted(set(range(len(texts))) - set(words))
        for a in range(0, len(words), 512):
            some = words[a : a + 512]
            found: list[list[int]] = [[]]
            for x in self.tokenizer.encode_batch(["\n".join(texts[i] for i in some)], add_special_tokens=False)[0].ids:
                if x == self.feed[0]:
                    found.append([])
                else:
                    found[-1].append(x)
            for i, ids in zip(some, found, strict=True):
                out[i] = ids
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        cp, ends = _text.points(texts)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        start = pieces(cp, ends)
        stop = np.append(start[1:], len(cp))
        values = self._values[cp & 0xFFFF] + cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = _text.stretch(_text.running(values), start, stop)
        if len(self.known) > KEPT:
            self._reset()
        at = self.index.get_indexer(key)
        if (at < 0).any():
            lost = np.flatnonzero(at < 0)
            new, where = np.unique(key[lost], return_index=True)
            whole = "".join(texts)
            ids = self._encode([whole[start[i] : stop[i]] for i in lost[where]])
            self.known = np.concatenate([self.known, new])
            self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum([len(x) for x in ids])])
            self.flat = np.concatenate([self.flat, np.fromiter((y for x in ids for y in x), np.uint32)])
            self.index = pd.Index(self.known)
            at[lost] = self.index.get_indexer(key[lost])
        size = self.cuts[at + 1] - self.cuts[at]
        total = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        flat = self.flat[np.arange(total[-1]) + np.repeat(self.cuts[at] - total[:-1], size)]
        return flat, total[np.searchsorted(start, ends)]


@lru_cache(4)
def ids_of(path: str) -> Ids:
    """One for each worker process and path."""
    return Ids(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
