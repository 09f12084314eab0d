"""Best-fit packing of token sequences with large-item matching.

Documents become pieces of at most ``capacity`` tokens (the first may be shorter).
How pieces share bins depends on their lengths alone, so the plan is made on the
histogram of lengths, which has at most ``capacity`` entries at any input size:

* pieces above a third of the capacity: at most two share a bin. Greedy matching,
  longest first, each with the longest that still fits beside it;
* smaller pieces, longest first, each into the bin with the least gap that holds
  them; a new bin only where none does.

The plan is a list of runs: so many pieces of one length at one offset of bins
with consecutive numbers. A piece takes its place by its rank among the pieces of
its length. Ranks come from counts for each length and slice of the rows (the
slice is a hash, so a length that a third of the pieces have is spread), so no
task sees all pieces of a length.

A null text is empty and packs as the closing id alone. Rows that share an id and a text
are told apart by no column; their places are dealt in any order.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text, tokens

CAPACITY, CLOSING, SLICES = 2048, 0, 512

_PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("slice", T.IntegerType())])
_PLACE = T.StructType([*_PIECE.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


@dataclass
class Run:
    """Pieces of one length, by rank from ``rank`` on: bins from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    offset: int


@dataclass
class Plan:
    runs: list[Run] = field(default_factory=list)
    bins: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append(Run(length, rank, count, first, offset))
        self.used[length] = rank + count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Runs for all pieces of a histogram {length: how many}."""
    out, left = Plan(), {k: v for k, v in counts.items() if v}
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: stretches of bins (first, how many)
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect.bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else None
        n = left[a] if b is None else left[a] // 2 or 1 if a == b else min(left[a], left[b])
        if a == b and left[a] == 1:  # itself alone is left of its length: the next shorter one joins it
            b = large[i - 1] if i > 0 else None
        out.put(a, n, out.bins, 0)
        left[a] -= n
        if b is not None:
            out.put(b, n, out.bins, a)
            left[b] -= n
        if gap := capacity - a - (b or 0):
            gaps.setdefault(gap, []).append((out.bins, n))
        out.bins += n
        large = [k for k in large if left[k]]
    open_gaps = sorted(gaps)
    for k in sorted((k for k in left if left[k]), reverse=True):
        while left[k]:
            i = bisect.bisect_left(open_gaps, k)
            if i == len(open_gaps):
                n = -(-left[k] // (capacity // k))
                gaps.setdefault(capacity, []).append((out.bins, n))
                out.bins += n
                open_gaps.append(capacity)
            gap = open_gaps[i]
            first, n = gaps[gap].pop()
            fit = gap // k
            whole = min(n, left[k] // fit)
            bins, each = (whole, fit) if whole else (1, left[k])
            if bins < n:
                gaps[gap].append((first + bins, n - bins))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.remove(gap)
            for j in range(each):
                out.put(k, bins, first, capacity - gap + j * k)
            left[k] -= bins * each
            if rest := gap - each * k:
                if rest not in gaps:
                    bisect.insort(open_gaps, rest)
                gaps.setdefault(rest, []).append((first, bins))
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """The pieces of every document: which, where, how long, a check sum of its ids, and the slice it is ranked in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokens.ids_of(path)
        for batch in batches:
            for first, texts in _text.text_lists(batch.column(1)):
                flat, ends = ids_of(texts)
                rows: list[tuple] = []
                for i, doc in enumerate(batch.column(0).slice(first, len(texts)).to_pylist()):
                    own = np.append(flat[ends[i] : ends[i + 1]], np.uint32(closing)).astype("<u4")
                    cut = [0, *range(len(own) % capacity or capacity, len(own), capacity), len(own)] if len(own) > capacity else [0, len(own)]
                    for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        crc = zlib.crc32(own[a:b].tobytes())
                        rows.append((doc, j, a, b - a, crc, (crc * 0x9E3779B1 >> 8) % SLICES if doc is None else (doc * 0x9E3779B1 + j >> 4) % SLICES))
                yield _io.to_batch(_PIECE, dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)))

    return _io.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _PIECE)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = _io.materialize(pieces(docs, path, capacity, closing), "pieces")
    # at most capacity x SLICES numbers, whatever the input: the histogram of lengths by slice
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, tuple] = {}
    for r in sorted(plan(totals, capacity).runs, key=lambda r: (r.length, r.rank)):
        by_length.setdefault(r.length, ([], [], []))
        for to, value in zip(by_length[r.length], (r.rank, r.bin, r.offset), strict=True):
            to.append(value)
    runs = docs.sparkSession.sparkContext.broadcast({k: tuple(np.array(x, np.int64) for x in v) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                ranks, first, offsets = runs.value[int(k)]
                run = np.searchsorted(ranks, rank[at], "right") - 1
                bins[at], offset[at] = first[run] + rank[at] - ranks[run], offsets[run]
            yield _io.to_batch(_PLACE, {c: batch.column(c) for c in _PIECE.names[:5]} | {"sequence_id": bins, "offset": offset})

    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - F.lit(1)).join(before.drop("n"), ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select(*_PIECE.names[:5], F.col("rank").cast("long")).mapInArrow(place, _PLACE)
