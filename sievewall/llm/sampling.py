"""Sampled SentencePiece segmentations, and lossless decoding.

A text's lattice has an edge for each piece of the vocabulary at each place where
it stands. Forward filtering sums the weights of all paths to each place; backward
sampling then draws one piece after another from the end, each in proportion to the
weight of all paths through it, so a segmentation comes with exactly its share of
the total weight. Pieces never hold a blank after other characters, so the lattice
falls apart at blanks: each different word's is filtered once, and all words of a
batch are sampled side by side. Words of more than ``LONG`` characters (texts without
blanks) are filtered and sampled one place after another instead, in linear time.

Draws are hashes of the row's key, the word's number and the step, of ``BITS`` bits, and
each place's shares are whole numbers of as many bits that follow from its word alone. So
a row's segmentation depends on nothing but its key, its text and the seed.

A piece's weight is 1 / (id + 2) ** ``power``: a byte-pair vocabulary lists pieces
by rank, not by probability. Characters without a piece, and the blank's own mark,
become byte pieces, so every text decodes to itself. An empty or null text has no ids;
a row without a key takes a hash of its text as key.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text

MARK = "▁"
#: Words whose filtered lattices a worker keeps; beyond that it starts again.
KEPT = 200_000
#: Characters from which on a word goes alone.
LONG = 1024
#: Bits of a draw; the number of a place stands above them.
BITS = 36
_STEP = 0xD1B54A32D192ED03
_VALUES = _text.keys(53, 0x10000)


def _points_values(cp: np.ndarray) -> np.ndarray:
    return _VALUES[cp & 0xFFFF] + cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _forward(edges: np.ndarray, before: np.ndarray, log: np.ndarray) -> np.ndarray:
    """The running shares of each place's edges in one long word's lattice."""
    total, out = [], []
    edges, before, log = edges.tolist(), before.tolist(), log.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        sums = [log[k] + (total[before[k]] if before[k] >= 0 else 0.0) for k in range(a, b)]
        most, run = max(sums), []
        for x in sums:
            run.append(math.exp(x - most) + (run[-1] if run else 0.0))
        total.append(most + math.log(run[-1]))
        out += [x / run[-1] for x in run]
    return np.array(out)


class Sampler:
    def __init__(self, path: str, power: float = 1.0) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_: dict[int, tuple[int, float]] = {}
        self.raw: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece, weight = sp.id_to_piece(i), -power * math.log(i + 2)
            if sp.is_byte(i):
                self.raw.append(bytes([int(piece[1:-1], 16)]))
                self.bytes_[int(piece[1:-1], 16)] = (i, weight)
                continue
            plain = piece.replace(MARK, " ")
            usable = not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)) and " " not in plain.lstrip(" ")
            self.raw.append(plain.encode() if usable else b"")
            if usable:
                self.pieces[plain] = (i, weight)
        self.longest = max(map(len, self.pieces))
        starts = sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)})  # every beginning of a piece
        cp, ends = _text.points(starts)
        self.start_index = pd.Index(_text.stretch(_text.running(_points_values(cp)), ends[:-1], ends[1:]))
        self.start_ids, self.start_weights = (np.array(x) for x in zip(*(self.pieces.get(x, (-1, 0.0)) for x in starts), strict=True))
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_cuts = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])])
        self._reset()

    def _reset(self) -> None:
        self.index, self.known = pd.Index(np.zeros(0, np.uint64)), np.zeros(0, np.uint64)
        self.ends = np.zeros(0, np.int64)  # each word's last place
        self.cum, self.before, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # edges, by the place they lead to
        self.edges = np.zeros(1, np.int64)  # where each place's edges begin

    def _edges(self, cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of all words' lattices: the place each leads to, the place before (-1: the word's beginning), id, log weight.

        A place is the number of the character before it. Ids below zero stand for the bytes of a character without a piece.
        """
        row = _text.rows_of(ends)
        left = ends[1:][row] - np.arange(len(cp))  # characters from here to the word's end
        sums = _text.running(_points_values(cp))
        to, start, which, weight = [], [], [], []
        i = np.arange(len(cp))
        for size in range(1, self.longest + 1):
            found = self.start_index.get_indexer(_text.stretch(sums, i, i + size))
            whole = np.where(found >= 0, self.start_ids[found], -1) >= 0
            if size == 1:
                other = i[~whole]
                codes, at = np.unique(cp[other], return_inverse=True)
                cost = np.array([sum(self.bytes_[x][1] for x in chr(c).encode("utf-8", "surrogatepass")) for c in codes])
                to.append(other)
                start.append(other)
                which.append(-1 - cp[other].astype(np.int64))
                weight.append(cost[at] if len(codes) else np.zeros(0))
            to.append(i[whole] + size - 1)
            start.append(i[whole])
            which.append(self.start_ids[found[whole]])
            weight.append(self.start_weights[found[whole]])
            i = i[found >= 0]
            i = i[left[i] > size]
        place, start, ids, log = (np.concatenate(x) for x in (to, start, which, weight))
        before = np.where(start > ends[:-1][row[start]], start - 1, -1)
        order = np.argsort(place, kind="stable")
        return place[order], before[order], ids[order], log[order]

    def _learn(self, words: list[str], keys: np.ndarray) -> None:
        cp, ends = _text.points(words)
        place, before, ids, log = self._edges(cp, ends)
        cuts = np.searchsorted(place, np.arange(len(cp) + 1))
        depth = np.arange(len(cp)) - ends[:-1][_text.rows_of(ends)]
        total, cum = np.zeros(len(cp)), np.zeros(len(place))
        alone = np.diff(ends) > LONG
        order = np.flatnonzero(~alone[_text.rows_of(ends)[place]])
        order = order[np.argsort(depth[place[order]], kind="stable")]
        steps = np.flatnonzero(np.r_[True, np.diff(depth[place[order]]) > 0, True]) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(steps[:-1], steps[1:], strict=True):  # all words' first places, then all second ones, ...
            own = order[a:b]
            at, prior = place[own], before[own]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            size = np.diff(np.append(first, len(own)))
            sums = log[own] + np.where(prior >= 0, total[prior], 0.0)
            most = np.maximum.reduceat(sums, first)
            run = np.exp(sums - np.repeat(most, size))
            for k in range(1, size.max()):  # each place's sums by itself, so that they don't depend on other words
                next_ = first[size > k] + k
                run[next_] += run[next_ - 1]
            whole = run[first + size - 1]
            total[at[first]] = most + np.log(whole)
            cum[own] = run / np.repeat(whole, size)
        for w in np.flatnonzero(alone):
            a, b = cuts[ends[w]], cuts[ends[w + 1]]
            cum[a:b] = _forward(cuts[ends[w] : ends[w + 1] + 1] - a, np.where(before[a:b] >= 0, before[a:b] - ends[w], -1), log[a:b])
        places = len(self.edges) - 1
        self.cum = np.concatenate([self.cum, ((place + places).astype(np.int64) << BITS) + (cum * (1 << BITS)).astype(np.int64)])
        self.before = np.concatenate([self.before, np.where(before >= 0, before + places, -1)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.edges = np.concatenate([self.edges, self.edges[-1] + cuts[1:]])
        self.ends, self.known = np.concatenate([self.ends, places + ends[1:] - 1]), np.concatenate([self.known, keys])
        self.index = pd.Index(self.known)

    def sample(self, texts: list[str], row_keys: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin."""
        led = [f" {t}" if t else "" for t in texts]
        cp, ends = _text.points(led)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        blank = cp == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(cp))
        key = _text.stretch(_text.running(_points_values(cp)), start, stop)
        if len(self.known) > KEPT:
            self._reset()
        at = self.index.get_indexer(key)
        if (at < 0).any():
            lost = np.flatnonzero(at < 0)
            new, where = np.unique(key[lost], return_index=True)
            whole = "".join(led)
            self._learn([whole[start[i] : stop[i]] for i in lost[where]], new)
            at[lost] = self.index.get_indexer(key[lost])
        cuts = np.searchsorted(start, ends)
        row = _text.rows_of(cuts)
        own = _text.mix(row_keys.astype(np.uint64)[row] + _text.mix((np.arange(len(start)) - cuts[:-1][row]).astype(np.uint64) ^ np.uint64(seed)) * np.uint64(_text.BASE))
        size = np.zeros(len(start), np.int64)
        alone = {int(i): self._backward(int(self.ends[at[i]]), int(stop[i] - start[i]), own[i]) for i in np.flatnonzero(stop - start > LONG)}
        live = np.flatnonzero(stop - start <= LONG)
        place = self.ends[at[live]]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            draw = (_text.mix(own[live] + np.uint64((len(steps) + 1) * _STEP & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)
            edge = np.searchsorted(self.cum, (place << BITS) + draw, "right")
            steps.append((live, self.ids[edge]))
            size[live] += 1
            place = self.before[edge]
            live, place = live[place >= 0], place[place >= 0]
        for i, ids in alone.items():
            size[i] = len(ids)
        total = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(total[-1], np.int32)
        for i, (who, ids) in enumerate(steps):
            out[total[who + 1] - 1 - i] = ids
        for i, ids in alone.items():
            out[total[i] : total[i + 1]] = ids[::-1]
        return self._bytes(out, total[cuts])

    def _backward(self, place: int, length: int, own: np.uint64) -> list[int]:
        """Ids of a sampled path of one long word, the last one first."""
        first = place - length + 1
        base = int(self.edges[first])
        edges = (self.edges[first : place + 2] - base).tolist()
        cum, before, ids = (x[base : base + edges[-1]].tolist() for x in (self.cum, self.before, self.ids))
        out: list[int] = []
        while place >= 0:
            k = len(out) & 0xFFF
            if not k:
                number = np.arange(len(out) + 1, len(out) + 0x1001, dtype=np.uint64)
                draws = (_text.mix(own + number * np.uint64(_STEP)) >> np.uint64(64 - BITS)).tolist()
            edge = bisect_right(cum, (place << BITS) + draws[k], edges[place - first], edges[place - first + 1])
            out.append(ids[edge])
            place = before[edge]
        return out

    def _bytes(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        code = -1 - ids
        size = np.where(ids >= 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        total = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        for i in np.flatnonzero(ids < 0):
            out[total[i] : total[i + 1]] = [self.bytes_[x][0] for x in chr(code[i]).encode("utf-8", "surrogatepass")]
        return out, total[cuts]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The text of each slice of ids."""
        size = self.raw_cuts[ids + 1] - self.raw_cuts[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.raw_flat[np.arange(total[-1]) + np.repeat(self.raw_cuts[ids] - total[:-1], size)].tobytes()
        ends = total[cuts].tolist()
        return [flat[a + 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(4)
def sampler(path: str, power: float = 1.0) -> Sampler:
    """One for each worker process and path."""
    return Sampler(path, power)


_IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
_TOLD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())])


def _run(path: str, seed: int, power: float, out) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path, power)
        for batch in batches:
            for first, texts in _text.text_lists(batch.column(1)):
                docs = batch.column(0).slice(first, len(texts))
                keys = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) if d is None else d & 0xFFFFFFFFFFFFFFFF for d, t in zip(docs.to_pylist(), texts, strict=True)], np.uint64)
                yield out(own, docs, texts, *own.sample(texts, keys, seed))

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return _io.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, path: str, seed: int = 0, power: float = 1.0) -> DataFrame:
    """(doc_id, ids) of a sampled segmentation of each row of ``docs`` (doc_id, text)."""

    def out(_, ids, texts, flat, cuts):
        return _io.to_batch(_IDS, {"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))})

    return _rows(docs).mapInArrow(_run(path, seed, power, out), _IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids); null ids decode to an empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            yield _io.to_batch(schema, {"doc_id": batch.column(0), "text": sampler(path).decode(np.concatenate([*ids, np.zeros(0, np.int64)]), cuts)})

    return _io.pick(encoded, "doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, seed: int = 0, power: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, lossless): a check sum of each row's sampled ids, and whether they decode to its text."""

    def out(own, ids, texts, flat, cuts):
        crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        same = [a == b for a, b in zip(own.decode(flat, cuts), texts, strict=True)]
        return _io.to_batch(_TOLD, {"doc_id": ids, "n_tokens": np.diff(cuts), "ids_crc32": crc, "lossless": same})

    return _rows(docs).mapInArrow(_run(path, seed, power, out), _TOLD)
