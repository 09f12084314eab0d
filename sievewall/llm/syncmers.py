"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its s-mers is
that of its first or its last one. Whether a k-mer is chosen depends on nothing
around it, so texts that share a passage choose the same anchors in it, wherever
it stands. A fingerprint is all of a text's anchors, each with its position.

Two texts are aligned by the longest chain of equal anchors whose positions ascend in
both. What the texts begin and end with alike is aligned at once; in between, of anchors
that stand at several places the nth from the front or from the back is matched with the
nth of the other text, so that the pairs don't grow with the square. The likeness
is twice the chain's length over the anchors of both, so a passage counts wherever it
stands, by its share, and passages that have changed places don't all count. The query
gives each fingerprint's size and digest.

A text shorter than k has its whole as its only anchor. A null text is empty; an
empty text has an empty fingerprint, alike (1) to an empty one only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text

K, S = 16, 9
_VALUES = _text.keys(31, 0x10000)
_LEAST = -(1 << 63)


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the closed syncmers of all texts, their positions in their text, and where each text's begin."""
    cp, ends = _text.points(texts)
    n = len(cp)
    sums = _text.running(_VALUES[cp & 0xFFFF] + cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found = np.zeros(n + 1, bool)
    if n >= k:
        start = np.arange(n - s + 1)
        small = _text.stretch(sums, start, start + s)
        least, width = small, 1
        while width < k - s + 1:
            step = min(width, k - s + 1 - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        chosen = (least == small[: n - k + 1]) | (least == small[k - s :])
        found[: n - k + 1] = chosen
        for a in range(1, k):  # no k-mer runs over the end of its text
            cut = ends[1:] - a
            found[cut[cut >= 0]] = False
    length = np.diff(ends)
    short = (length > 0) & (length < k)
    found[ends[:-1][short]] = True
    found = found[:n]
    at = np.flatnonzero(found)
    cuts = np.searchsorted(at, ends)
    row = _text.rows_of(cuts)
    return _text.stretch(sums, at, np.minimum(at + k, ends[1:][row])), at - ends[:-1][row], cuts


def marks_of(texts: list[str]) -> list[np.ndarray]:
    """All anchors of each text in order: hash (32 bits) and position."""
    hashes, at, cuts = anchors(texts)
    both = np.stack([hashes >> np.uint64(32), at.astype(np.uint64)], 1).astype(np.uint32)
    return [both[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays begin with alike."""
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value with its number among its equals, from the front and from the back."""
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
    n = np.diff(np.r_[first, len(x)])
    front = np.empty(len(x), np.uint64)
    front[order] = np.arange(len(x)) - np.repeat(first, n)
    last = np.empty(len(x), np.uint64)
    last[order] = np.repeat(n - 1, n)
    high = x.astype(np.uint64) << np.uint64(32)
    return high | front, high | (last - front)


def aligned(x: np.ndarray, y: np.ndarray) -> int:
    """The length of the longest chain of equal values that ascends in both."""
    head = _same(x, y)
    x, y = x[head:], y[head:]
    tail = _same(x[::-1], y[::-1])
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return head + tail
    pairs = [np.intersect1d(a, b, assume_unique=True, return_indices=True)[1:] for a, b in zip(_numbered(x), _numbered(y), strict=True)]
    i, j = np.divmod(np.unique(np.concatenate([i * len(y) + (len(y) - 1 - j) for i, j in pairs])), len(y))  # of one i, the last j first
    ends: list[int] = []
    for at in (len(y) - 1 - j).tolist():
        k = bisect_left(ends, at)
        ends[k : k + 1] = [at]
    return head + tail + len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return 2 * aligned(a[:, 0], b[:, 0]) / (len(a) + len(b))


def told(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text), sorted in each partition so that the row after a document is the next document.

    Documents are dealt to buckets of consecutive ids by quantiles; each bucket ends in a copy (a ghost)
    of the first document of the next bucket, the last one's of the first. Ids that repeat are
    ordered by a hash of the text; null ids come first.
    """
    spark = docs.sparkSession
    rows = _io.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    n = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})  # n numbers at most
    splits = F.array(*[F.lit(x) for x in cuts]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(splits, lambda x: x <= F.col("key")))) if len(cuts) < 8 else rows.withColumn("bucket", _bucket(F.col("key"), cuts))
    first = rows.groupBy("bucket").agg(F.min(F.struct("key", "hash")).alias("least")).orderBy("bucket").collect()  # a row for each bucket
    if not first:
        return rows.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text", "hash")
    ends = spark.createDataFrame([(r["bucket"], first[i - 1]["bucket"], r["least"]["key"], r["least"]["hash"]) for i, r in enumerate(first)], "bucket int, before int, least_key long, least_hash long")
    rows = rows.join(F.broadcast(ends), "bucket")
    leads = (F.col("key") == F.col("least_key")) & (F.col("hash") == F.col("least_hash"))
    places = F.when(leads, F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("ghost"))))
    dealt = rows.withColumn("at", F.explode(places)).select("at.bucket", "at.ghost", "doc_id", "text", "key", "hash")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "ghost", "key", "hash").drop("key")


def _bucket(key, cuts: list[int]):
    """How many cuts are at most ``key``, by a tree of comparisons."""
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    return F.when(key < cuts[mid], _bucket(key, cuts[:mid])).otherwise(F.lit(mid + 1) + _bucket(key, cuts[mid + 1 :]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its fingerprint, its edited text's, and how near they and the next document's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def work(more: bool) -> Iterator[pa.RecordBatch]:
            """All held rows that have a next one; a row waits while its next may still come."""
            rows = [i for i, x in enumerate(held) if not x[1] and (i + 1 < len(held))]
            if rows:
                own = [x[3] for x in held]
                edited = [own[i][: len(own[i]) - len(own[i]) // 4] + own[i + 1][: len(own[i]) // 4] for i in rows]
                marks = marks_of([*own, *edited])
                late = marks[len(own) :]
                yield _io.to_batch(_SCHEMA, {
                    "doc_id": [held[i][2] for i in rows], "n_chars": [len(own[i]) for i in rows], "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                    "fingerprint": [told(marks[i]) for i in rows], "edited_fingerprint": [told(x) for x in late],
                    "near_edited": [likeness(marks[i], x) for i, x in zip(rows, late, strict=True)], "near_next": [likeness(marks[i], marks[i + 1]) for i in rows],
                })
            held[:] = held[-1:] if more else []

        for batch in batches:
            for bucket, ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
                if len(held) and held[-1][1] and (held[-1][0] != bucket):
                    yield from work(False)  # the bucket is complete
                    size = 0
                if not (ghost and held and held[-1][1]):
                    held.append((bucket, ghost, doc_id, text or ""))
                    size += len(text or "")
                if size > _text.CHUNK:
                    yield from work(True)
                    size = len(held[-1][3]) if held else 0
        yield from work(False)

    return with_next(docs).select("bucket", "ghost", "doc_id", "text").mapInArrow(run, _SCHEMA)
