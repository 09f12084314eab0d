"""MinHash near-deduplication of documents by chosen paths.

A document's set is its distinct shingles of ``k`` words. Documents link where
the Jaccard similarity of their sets is at least ``similarity``, confirmed on the
full sets; a component keeps its document with the least id.

1. Every text becomes a size, a 128-bit key of its set, eight bits of ``WIDTH``
   minwise values, and its nodes in the first level of all trees, in one pass.
   Documents of equal sets become one item.
2. Chosen-path trees find the pairs to compare. A node selects coordinates of the
   minwise values from its own path, 1.25 in the mean (1 / 0.8, so that the expected
   number of children that two documents of similarity 0.8 share is one at every
   level); a document goes to the child named by each coordinate and its value there.
   Nodes of more than ``LEAF`` items branch again, down to ``DEPTH`` levels; what is
   smaller, or as deep, is compared exhaustively (``groups``). Roots select different
   coordinates, so a pair at 0.8 in nodes that needn't branch is missed with a
   probability of 0.2 ** 15; if all its nodes branch twice, below 0.001.
   Comparison within a node is of minwise values, with a margin of five standard
   deviations below ``similarity``; nodes that hold the same items are compared once.
3. What the nodes join are coarse components. Within each, the full sets are compared;
   a pair whose two ends are joined by confirmed links already needs no comparison.

No bucket has a cap. Nulls: a null text is empty. Empty texts and texts without
words have no set and link with nothing. Rows without an id link with nothing and
have no component. Rows that share an id count as one vertex of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text, groups
from .graph import components

WIDTH, TREES, LEAF, DEPTH = 128, 12, 256, 3

_SKETCH = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("nodes", T.ArrayType(T.LongType()))])
_NODE = T.StructType([T.StructField("group", T.LongType()), T.StructField("item", T.LongType())])


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for chunk in _text.chunks(column):
        hashes, _, ends = _text.shingles(_text.words(chunk), k)
        yield chunk.first, *_text.distinct(hashes, ends)


def _low(minwise: np.ndarray) -> np.ndarray:
    return (minwise & np.uint32(0xFF)).astype(np.uint8)


def _child(node: np.ndarray, pick: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _text.mix(_text.mix(node + pick.astype(np.uint64)) ^ value.astype(np.uint64)).view(np.int64)


def roots(minwise: np.ndarray, trees: int) -> np.ndarray:
    """The nodes of each row in the first level of all trees: every fourth root selects two coordinates, no two the same."""
    pick = np.arange(trees + trees // 4)
    tree = np.r_[np.arange(trees), np.arange(trees // 4) * 4]
    return _child(_text.keys(17, trees)[tree][None, :], pick[None, :], minwise[:, pick])


def sketches(docs: DataFrame, k: int, trees: int) -> DataFrame:
    seeds = _text.keys(9, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, ends in _sets(batch.column(1), k):
                n = np.diff(ends)
                totals = [_text.reduce_rows(np.add, _text.mix(hashes ^ np.uint64(x)), ends, np.uint64(0)).view(np.int64) for x in (3, 5)]
                minwise = _text.minhash(hashes, ends, seeds)
                nodes = roots(minwise, trees)
                nodes = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * nodes.shape[1], nodes.ravel())
                yield _io.to_batch(_SKETCH, {"doc_id": batch.column(0).slice(first, len(n)), "n_shingles": n, "s1": totals[0], "s2": totals[1], "sig": _io.binaries(_low(minwise)), "nodes": nodes})

    return _io.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, _SKETCH)


def branch(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each entry: the entry's number, and the child's name."""
    h = _text.mix(node.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    rows = np.concatenate([np.arange(len(h)), np.flatnonzero(h % np.uint64(4) == 0)])
    second = (np.arange(len(rows)) >= len(h)).astype(np.uint64)
    pick = ((h[rows] >> (np.uint64(8) + np.uint64(24) * second)) % np.uint64(WIDTH)).astype(np.int64)
    return rows, _child(h[rows], pick, sig[rows, pick])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, item) of the level below (group, item, sig)."""
    for batch in batches:
        rows, child = branch(batch.column("group").to_numpy(), _io.matrix(batch.column("sig"), WIDTH, np.uint8))
        yield _io.to_batch(_NODE, {"group": child, "item": batch.column("item").to_numpy()[rows]})


def _near(sig: np.ndarray, least: float):
    def alike(i: int, others: np.ndarray) -> np.ndarray:
        score = (sig[others] == sig[i]).mean(1)
        return np.where(score >= least, score, -1.0)

    return alike


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, item, side, label, cuts in groups.cells(batches):
            sig = _io.matrix(t.column("sig").combine_chunks(), WIDTH, np.uint8)
            src, dst = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for i, j in groups.forest(side[a:b], label[a:b], _near(sig[a:b], least), lambda i, j: True):
                    src.append(a + i)
                    dst.append(a + j)
            yield groups.to_edges(item, src, dst)

    return run


def _confirm(k: int, similarity: float, least: float):
    top, seeds = round(similarity * 1000), _text.keys(9, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, item, side, label, cuts in groups.cells(batches):
            src, dst = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets, sig = [], []
                for _, hashes, ends in _sets(t.column("text").slice(a, b - a).combine_chunks(), k):
                    sets += [hashes[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                    sig.append(_low(_text.minhash(hashes, ends, seeds)) if b - a > 2 else np.zeros((len(ends) - 1, 1), np.uint8))
                size, near = np.array([len(x) for x in sets]), _near(np.concatenate(sig), least)

                def alike(i, others, size=size, near=near):
                    fits = np.minimum(size[others], size[i]) * 1000 >= top * np.maximum(size[others], size[i])
                    return np.where(fits, near(i, others), -1.0)

                def confirm(i, j, sets=sets):
                    x, y = sets[i], sets[j]
                    both = _text.shared(x, y)
                    return both > 0 and both * 1000 >= top * (len(x) + len(y) - both)

                for i, j in groups.forest(side[a:b], label[a:b], alike, confirm):
                    src.append(a + i)
                    dst.append(a + j)
            yield groups.to_edges(item, src, dst)

    return run


def _candidates(classes: DataFrame, least: float) -> DataFrame:
    """Edges between items (item, sig, nodes) that nodes of the trees hold alike."""
    items = classes.select("item", "sig")
    level, keys, sizes, passing = classes.select(F.explode("nodes").alias("group"), "item"), [], [], []
    for depth in range(1, DEPTH + 1):
        stats = level.groupBy("group").agg(F.count("*").alias("size"), F.min("item").alias("low"), F.sum(F.xxhash64("item").cast("decimal(20,0)")).alias("all")).where("size > 1")
        stats = _io.materialize(stats.groupBy("size", "low", "all").agg(F.min("group").alias("group")).select("group", "size"), "sizes")
        passing.append(stats)
        large = F.lit(False) if depth == DEPTH else F.col("size") > LEAF
        keys.append(level)
        sizes.append(stats.where(~large))
        if depth == DEPTH or stats.where(large).isEmpty():
            break
        level = _io.materialize(level.join(stats.where(large).select("group"), "group").join(items, "item").mapInArrow(_grow, _NODE), "nodes")
        passing.append(level)
    found = groups.link(_union(keys), _union(sizes), items, _compare(least))
    for written in passing:
        _io.discard(written)
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text)."""
    least = similarity - 5 * (similarity * (1 - similarity) / WIDTH) ** 0.5
    sketch = _io.materialize(sketches(docs, k, trees), "sketches")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = _io.materialize(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("item"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes")), "classes")
    coarse = _io.materialize(components(_candidates(classes, least)).toDF("item", "group"), "coarse")
    sizes = _io.materialize(coarse.groupBy("group").agg(F.count("*").alias("size")), "sizes")
    texts = _io.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("item"), "text")
    joined = components(groups.link(coarse, sizes, texts, _confirm(k, similarity, least))).toDF("item", "component")
    named = classes.select("s1", "s2", "item").join(joined, "item", "left").select("s1", "s2", F.coalesce("component", "item").alias("component"))
    rows = sketch.select("doc_id", "n_shingles", "s1", "s2")
    plain, rest = rows.where("n_shingles > 0 and doc_id is not null"), rows.where("n_shingles = 0 or doc_id is null")
    out = plain.join(named, ["s1", "s2"]).select("doc_id", "n_shingles", "component").union(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
