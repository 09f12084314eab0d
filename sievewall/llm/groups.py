"""Links within groups of rows, whatever their size, without a group in one task.

A group of at most ``tile`` rows is one cell, in which all rows are compared. A larger
one is compared in two rounds:

1. Its rows are dealt to blocks of about ``tile``; each block is one cell, and gets a few
   rows of the whole group (pivots, the same for every block) besides its own.
2. The links found so far give labels. Where a group has rows of more than one label, all
   rows that haven't its commonest label are compared with all others of another label, in
   cells of two blocks. In a group of copies that the pivots join, few rows are left; only
   where most of a large group's rows are alike enough to be compared and link with nothing
   does the work grow with the square.

Rows whose labels are equal already need no comparison, as links are only needed up to
what they join. A cell yields links that join all that its links join, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io
from .graph import components

TILE, PIVOTS = 2048, 16
EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

Compare = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _block(n, seed: int = 7):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("item")), n)


def _cells(keys: DataFrame, tile: int) -> DataFrame:
    """(cell, side, item, label) of the first round."""
    n = F.ceil(F.col("size") / tile).cast("long")
    pivot = (n > 1) & (_block(F.col("size"), 3) < PIVOTS)
    blocks = F.when(pivot, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array(_block(n)))
    dealt = keys.select("item", "group", F.explode(blocks).alias("b"))
    return dealt.select(F.xxhash64("group", "b").alias("cell"), F.lit(2).alias("side"), "item", F.col("item").alias("label"))


def _late_cells(keys: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """(cell, side, item, label) of the second round: side 0 has rows without the commonest label, side 1 has all."""
    told = keys.join(labels, "item", "left").withColumn("label", F.coalesce("label", "item"))
    counts = told.groupBy("group", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy("group").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select("group", F.col("top.label").alias("major"), (F.col("all") - F.col("top.n")).alias("rest")).where("rest > 0")
    told = told.join(top, "group")
    n, late = F.ceil(F.col("size") / tile).cast("long"), F.ceil(F.col("rest") / tile).cast("long")
    zero = F.lit(0).cast("long")
    right = F.transform(F.sequence(zero, late - 1), lambda c: F.struct(F.lit(1).alias("side"), _block(n).alias("b"), c.alias("c")))
    left = F.transform(F.sequence(zero, n - 1), lambda b: F.struct(F.lit(0).alias("side"), b.alias("b"), _block(late, 5).alias("c")))
    places = F.when(F.col("label") == F.col("major"), right).otherwise(F.concat(left, right))
    dealt = told.select("item", "label", "group", F.explode(places).alias("p"))
    return dealt.select(F.xxhash64("group", "p.b", "p.c").alias("cell"), "p.side", "item", "label")


def link(keys: DataFrame, sizes: DataFrame, payload: DataFrame, compare: Compare, tile: int = TILE) -> DataFrame:
    """Edges (src, dst) that join what the links within groups join.

    keys: (group, item); sizes: (group, size), written already, groups that aren't there are passed over;
    payload: item and what ``compare`` needs of it. ``compare`` gets cell, side, item, label and the payload,
    sorted by cell and side; rows of sides 0 and 1 are compared across, rows of side 2 with all.
    """

    def done(cells: DataFrame) -> DataFrame:
        dealt = cells.join(payload, "item").repartition("cell").sortWithinPartitions("cell", "side")
        return _io.materialize(dealt.mapInArrow(compare, EDGE), "links")

    first = done(_cells(keys.join(sizes, "group"), tile))
    large = sizes.where(F.col("size") > tile)
    if large.isEmpty():
        return first
    labels = _io.materialize(components(first).toDF("item", "label"), "labels")
    return first.union(done(_late_cells(keys.join(large, "group"), labels, tile)))


def forest(side: np.ndarray, label: np.ndarray, alike, confirm) -> list[tuple[int, int]]:
    """Confirmed links that join all that links join, among the rows of a cell.

    ``alike(i, others)`` says how alike row i may be to others (below 0: not at all);
    ``confirm(i, j)`` decides. Rows of one label are joined already.
    """
    label, out = np.unique(label, return_inverse=True)[1], []
    for i in range(len(side)):
        if side[i] == 1:  # the rest are of side 1: they have met all rows of side 0
            break
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if side[i] == 0:
            others = others[side[others] == 1]
        if not len(others):
            continue
        score = alike(i, others)
        order = np.argsort(-score, kind="stable")
        for j in others[order[: int((score >= 0).sum())]].tolist():
            if label[j] != label[i] and confirm(i, j):
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole cells of a sorted partition, many at once: table, item, side, label, and where each cell begins."""
    for table in _io.whole_groups(batches, "cell"):
        t = table.combine_chunks()
        cell, item, side, label = (t.column(c).to_numpy() for c in ("cell", "item", "side", "label"))
        yield t, item, side, label, np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])


def to_edges(item: np.ndarray, src: list[int], dst: list[int]) -> pa.RecordBatch:
    return _io.to_batch(EDGE, {"src": item[np.array(src, np.int64)], "dst": item[np.array(dst, np.int64)]})
