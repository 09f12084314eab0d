"""Document quality by Bradley-Terry pairwise ranking.

The model gives every text a strength, linear in features of the text alone. It
learns from preference pairs, a good text against a poor one: the probability
that the good one wins is the logistic function of the difference of strengths,
so the loss is the logistic loss on feature differences. Strengths then become
scores by a quantile: the cut is the quantile of the strengths of the sampled
rows at which most of them fall on their label's side (good and poor weighing
alike), and a strength at the cut scores ``THRESHOLD``.

Learning uses at most ``SAMPLE`` labelled rows, those with the least hash of
their id, so each row's chance is the same whatever the size of the input;
scoring covers all rows. Labels, language, source and id are no features.

Nulls: a null text is empty; an empty text has a score. A row without an id is
scored, and isn't held out. Labels that are null aren't learned from. With no
label of one of the kinds, all strengths are zero and every text is kept.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text

SAMPLE, PAIRS, THRESHOLD, FOLDS, HELD_OUT = 20_000, 100_000, 0.7, 4, 2
_SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("strength", T.DoubleType())])
_FEATURES = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("features", T.BinaryType())])

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _COMMA, _MARK, _HIGH, _FEED = range(9)
_KIND = np.full(256, _MARK, np.uint8)
for _of, _bytes in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SPACE, b" \t\r\x0b\x0c"), (_STOP, b".!?"), (_COMMA, b",;:'\"()-"), (_HIGH, range(128, 256)), (_FEED, b"\n")):
    _KIND[list(_bytes)] = _of


def features(chunk: _text.Chunk) -> np.ndarray:
    """A row of numbers for each text."""
    ends, data = chunk.ends, chunk.data
    kind = _KIND[data]
    size = np.maximum(np.diff(ends), 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[ends[1:]] - sums[ends[:-1]]) / size

    shares = [share(kind == k) for k in range(9)]
    w = _text.words(chunk)
    n = np.diff(w.ends)
    some = np.maximum(n, 1).astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    row = _text.rows_of(w.ends)
    mean = np.bincount(row, length, len(n)) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, len(n)) / some - mean**2, 0))

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, mask, len(n)) / some

    last, first = kind[w.end - 1], kind[w.start]
    different, cuts = _text.distinct(w.hashes, w.ends)
    pairs, _, pair_ends = _text.shingles(w, 2)
    different_pairs = np.diff(_text.distinct(pairs, pair_ends)[1]) / np.maximum(np.diff(pair_ends), 1)
    same = np.zeros(len(w.hashes))
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    stops = share(kind == _STOP) * size
    out = [
        np.log1p(np.diff(ends)), np.log1p(n), *shares, mean, spread, np.diff(cuts) / some, different_pairs, of_words(same),
        of_words(last == _MARK), of_words(last == _STOP), of_words(last == _COMMA), of_words((first == _UPPER) & (last == _UPPER)), of_words(first == _UPPER), of_words(length <= 1), of_words(length > 20),
        np.log1p(some / (stops + 1)), np.log1p(size / (share(kind == _FEED) * size + 1)), (n == 0).astype(float),
    ]
    base = np.stack(out, 1)
    return np.concatenate([base, np.sqrt(np.abs(base[:, 2:25])), base[:, 2:25] ** 2], 1)


def learn(x: np.ndarray, good: np.ndarray, seed: int = 8) -> dict:
    """A model from features and marks: weights, the features' scale, the cut and the slope of scores."""
    centre, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(1), np.ones(1))
    z = np.clip((x - centre) / scale, -6, 6)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return {"centre": [0.0], "scale": [1.0], "weights": [0.0], "cut": -1.0, "slope": 1.0}
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(a, PAIRS)] - z[rng.choice(b, PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        step = difference.T @ p / PAIRS - 1e-3 * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / PAIRS + 1e-3 * np.eye(len(w))
        change = np.linalg.solve(curve, step)
        w += change * min(1.0, 5 / (np.abs(change).max() + 1e-12))
    strength = z @ w
    order = np.argsort(strength, kind="stable")
    right = np.concatenate([[0], np.cumsum(np.where(good[order], -1 / len(a), 1 / len(b)))])
    q = int(np.argmax(right))
    s = strength[order]
    cut = s[0] - 1.0 if q == 0 else s[-1] + 1.0 if q == len(s) else (s[q - 1] + s[q]) / 2
    return {"centre": centre.tolist(), "scale": scale.tolist(), "weights": w.tolist(), "cut": float(cut), "slope": float(2 / (strength.std() + 1e-6)), "quantile": q / len(s)}


def scores(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Strengths, and scores from 0 to 1."""
    if len(model["weights"]) == 1:
        strength = np.zeros(len(x))
    else:
        strength = np.clip((x - np.array(model["centre"])) / np.array(model["scale"]), -6, 6) @ np.array(model["weights"])
    at = np.log(THRESHOLD / (1 - THRESHOLD))
    return strength, 1 / (1 + np.exp(-np.clip(at + model["slope"] * (strength - model["cut"]), -30, 30)))


def in_fold(doc_id, folds: int = FOLDS):
    """crc32 of the id as text, modulo ``folds``, as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of at most ``sample`` labelled rows outside the held-out fold."""
    marks = _io.pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(in_fold(F.col("doc_id")) != HELD_OUT)
    # ``sample`` ids at most: the only rows of documents that are read into the fit
    marks = marks.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    texts = _io.pick(docs, "doc_id", "text").join(F.broadcast(marks), docs["doc_id"] == F.col("id"))
    # of rows that share an id one counts, the one with the least hash; so no more rows than labels come to the driver
    texts = texts.groupBy("id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("quality", "m.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _text.chunks(batch.column(1)):
                yield _io.to_batch(_FEATURES, {"quality": batch.column(0).slice(chunk.first, chunk.rows), "features": _io.binaries(features(chunk))})

    found = texts.mapInArrow(run, _FEATURES).toArrow()
    x = _io.matrix(found.column("features").combine_chunks(), len(_names()), np.float64)
    good = found.column("quality").to_numpy() == 1
    order = np.lexsort(x.T[::-1]) if len(x) else np.zeros(0, int)  # whatever order the rows come in, the model is the same
    order = order[np.argsort(good[order], kind="stable")]
    return learn(x[order], good[order])


def _names() -> range:
    return range(features(_text.Chunk(0, np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted (and the strength) of every row of ``docs``."""
    told = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = json.loads(told)
        for batch in batches:
            for chunk in _text.chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.first, chunk.rows)
                strength, value = scores(features(chunk), own)
                held = [x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in ids.to_pylist()]
                yield _io.to_batch(_SCORE, {"doc_id": ids, "held_out": held, "score": value, "predicted": (value >= THRESHOLD).astype(np.int32), "strength": strength})

    return _io.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _SCORE)


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``THRESHOLD``, all columns as they are."""
    told = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = json.loads(told)
        for batch in batches:
            kept = [scores(features(chunk), own)[1] >= THRESHOLD for chunk in _text.chunks(batch.column("text"))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
