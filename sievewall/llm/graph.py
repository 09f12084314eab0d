"""Connected components of graphs over whole numbers, by local union-find and alternating stars.

Every partition first joins its own edges and hands on one star for each of its
components, so that no more edges than vertices of a partition remain. If what
remains is at most ``LOCAL`` edges, a bound on a count that was taken, one task joins
it. Otherwise rounds of stars follow: every vertex points its larger neighbours at the
smallest id it knows of (large star), then its smaller ones (small star); the number
of rounds grows with the logarithm of the longest path, and partitions join their
edges again after each, until no more than ``LOCAL`` remain or nothing changes.
A vertex with very many neighbours never meets them in one task: its minimum is a
partial aggregate, and the join back may be split. Each round is written to the
shared folder; nothing but two numbers a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import discard, materialize, to_batch

#: Edges that one task joins: 16 MB of ids.
LOCAL = 1 << 20

_EDGE = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
_FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("component", T.LongType())])


def least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers below ``n`` that each one is joined to by edges a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _stars(size: int, schema: T.StructType, all_: bool = False):
    """Edges (u, v) as stars: each vertex (without ``all_`` but the least of its component) with that least one; in pieces of ``size`` edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work() -> pa.RecordBatch:
            both = np.concatenate(held, 1)
            ids, codes = np.unique(both, return_inverse=True)
            codes = codes.reshape(both.shape)
            label = least(len(ids), codes[0], codes[1])
            own = np.arange(len(ids)) if all_ else np.flatnonzero(label != np.arange(len(ids)))
            held.clear()
            return to_batch(schema, dict(zip(schema.names, (ids[own], ids[label[own]]), strict=True)))

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if held and sum(x.shape[1] for x in held) + part.num_rows > size:
                    yield work()
                held.append(np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()]))
        if held:
            yield work()

    return run


def components(edges: DataFrame, src: str = "src", dst: str = "dst", local: int = LOCAL) -> DataFrame:
    """(id, component) of every vertex that has an edge to another; component is the least id reachable.

    Edges with a null end, loops and repeated edges have no effect; no edges give no rows.
    """
    plain = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now, seen = materialize(plain.mapInArrow(_stars(LOCAL, _EDGE), _EDGE), "edges"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state[0] <= local:
            return now.coalesce(1).mapInArrow(_stars(max(local, 1), _FOUND, True), _FOUND)
        if state == seen:
            return now.toDF("id", "component").union(now.select("v", "v").distinct())
        before, now, seen = now, materialize(_small(_large(_down(now))).mapInArrow(_stars(LOCAL, _EDGE), _EDGE), "edges"), state
        discard(before)


def _down(e: DataFrame) -> DataFrame:
    """Each edge once, from the larger id to the smaller."""
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least_ = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return _down(e.join(least_, e["v"] == least_["k"]).select(F.col("u").alias("u"), F.col("m").alias("v")))


def _small(e: DataFrame) -> DataFrame:
    least_ = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    joined = e.join(least_, e["u"] == least_["k"])
    return _down(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least_.select("k", "m")))
