"""Near-duplicate embeddings by quantised tile products.

Each vector is scaled to unit length and quantised to int8: u = s q + e, with the
norm of the error e kept. For two vectors

    |u.v - s_u s_v q_u.q_v| <= |e_u| + |e_v| + |e_u| |e_v|

holds rigorously, as |u| = |v| = 1 and |s q| <= 1 + |e|. Products of tiles of
quantised vectors thus settle nearly all pairs: below the threshold whatever the
error, or above it whatever the error; only the pairs between are computed again,
in double precision.

Equal vectors become one class with a weight. Pairs of classes are pruned by pivots, at
most ``PIVOTS`` of them for each vector length, taken by hash. A class is at home at the
pivot whose product with it is largest. If x is at home at a and y at b, the plane halfway
between a and b lies between them, x at a distance of x.(a - b) / |a - b| from it, its
gap to b, and y at its gap to a; so |x - y| is at least the sum of both gaps, and a
pair with a cosine of t or more has |x - y| <= sqrt(2 - 2 t). Thus x is sent only to the
homes to which its gap is that small, and there it meets only rows whose gap leaves enough.

Each home is cut into blocks of at most two tiles; a cell is a pair of blocks. Every
pair of classes that the gaps leave open meets in one cell, and a task holds two blocks
at a time. It returns, for each class that has links in its cell, how many vectors it
links to and the least id that it is joined to there, never pairs. Vectors of lengths
beyond the ``WIDTHS`` most frequent ones meet in blocks without pivots.

The number of cells still grows with the square of the number of classes; the pivots cut the
share of pairs that is multiplied, the more so the more classes (hence pivots) there are.

Vectors that are null or zero, or hold null or non-finite components, link with
nothing, as do vectors of different lengths. Rows without an id link with nothing
and have no component. Rows that share an id count as one vertex of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text
from .graph import components

TILE, ROWS = 4096, 512
#: Bounds on what goes to the driver and back to all tasks: pivots of one length of vectors, lengths that have pivots, numbers in all pivots of one length.
PIVOTS, WIDTHS, NUMBERS = 1024, 4, 1 << 22
#: Slack for the rounding of single precision in the scaled products and gaps, far above what it can reach.
ROUNDING = 1e-5

_FOUND = T.StructType([T.StructField("item", T.LongType()), T.StructField("links", T.LongType()), T.StructField("rep", T.LongType())])


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, int8 values, scales, norms of the error)."""
    unit = unit_rows(vectors)
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = unit - q * scale[:, None]
    return unit, q, scale, np.sqrt((error * error).sum(1)) + 1e-12


def links(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which rows of one quantised block link to which of another."""
    (ua, qa, sa, ea), (ub, qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    near = qa.astype(kind) @ qb.astype(kind).T
    near *= sa.astype(kind)[:, None]
    near *= sb.astype(kind)[None, :]
    bound = ((ea[:, None] + eb[None, :]) + ea[:, None] * eb[None, :]).astype(kind) + kind(ROUNDING)
    sure = near - bound >= threshold
    near += bound
    i, j = np.nonzero((near >= threshold) & ~sure)
    for k in range(0, len(i), 65536):
        x, y = i[k : k + 65536], j[k : k + 65536]
        sure[x, y] = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
    return sure


def _spans(label: np.ndarray, rows: np.ndarray, cols: np.ndarray, mask: np.ndarray) -> None:
    """Join, in ``label``, what the mask links between numbered rows and columns."""
    some, other = mask.any(1), mask.any(0)
    rows, cols, mask = rows[some], cols[other], mask[some][:, other]
    while len(rows):
        mask = mask & (label[rows][:, None] != label[cols][None, :])
        some = mask.any(1)
        if not some.any():
            return
        rows, mask = rows[some], mask[some]
        for i, j in zip(rows, cols[mask.argmax(1)], strict=True):
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)


def reach(threshold: float) -> float:
    """The largest distance of two unit vectors that link, and slack for rounding."""
    return float(np.sqrt(max(2 - 2 * threshold, 0))) + ROUNDING


def _tile(threshold: float):
    far = reach(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _io.whole_groups(batches, "cell"):
            t = table.combine_chunks()
            cell, item, side, weight, width, gap = (t.column(c).to_numpy() for c in ("cell", "item", "side", "weight", "width", "gap"))
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own, w, near = side[lo:hi], weight[lo:hi].astype(np.float64), gap[lo:hi]
                cross = own[0] != 2
                left, right = (np.flatnonzero(own == 0), np.flatnonzero(own == 1)) if cross else (np.arange(hi - lo), np.arange(hi - lo))
                if cross:
                    left, right = left[np.argsort(near[left])], right[np.argsort(near[right])]
                    if not len(left) or not len(right) or near[left[0]] + near[right[0]] > far:
                        continue
                block = quantise(_io.matrix(t.column("vector").slice(lo, hi - lo).combine_chunks(), int(width[lo]), np.float32).astype(np.float64))
                count, label = np.zeros(hi - lo), np.arange(hi - lo)
                cols = tuple(x[right] for x in block)
                for k in range(0, len(left), ROWS):
                    rows = left[k : k + ROWS]
                    meet = int(np.searchsorted(near[right], far - near[rows[0]], "right")) if cross else len(right)
                    if not meet:
                        break
                    mask = links(tuple(x[rows] for x in block), tuple(x[:meet] for x in cols), threshold)
                    if not cross:
                        mask[np.arange(len(rows)), rows] = False
                    if mask.any():
                        count[rows] += mask @ w[right[:meet]]
                        if cross:
                            count[right[:meet]] += w[rows] @ mask
                        _spans(label, rows, right[:meet], mask)
                some = np.flatnonzero(count)
                if len(some):
                    ids = item[lo:hi]
                    order = np.lexsort((ids, label))
                    least = np.zeros(hi - lo, np.int64)
                    first = np.r_[True, label[order][1:] != label[order][:-1]]
                    least[order] = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
                    yield _io.to_batch(_FOUND, {"item": ids[some], "links": count[some].astype(np.int64), "rep": least[some]})

    return run


_PACKED = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("width", T.IntegerType())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and the bytes of their vectors; no bytes for vectors that link with nothing."""
    for batch in batches:
        ends = np.zeros(len(batch) + 1, np.int64)
        lists = batch.column(1)
        np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=ends[1:])
        flat = lists.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float32)
        bad = ~np.isfinite(values)
        sums = np.concatenate([[0], np.cumsum(bad)])
        biggest = np.zeros(len(batch), np.float32)
        some = np.diff(ends) > 0
        if some.any():
            biggest[some] = np.maximum.reduceat(np.abs(np.where(bad, 0, values)), ends[:-1][some])
        good = (sums[ends[1:]] == sums[ends[:-1]]) & (biggest > 0)
        values = values + np.float32(0)  # negative zeros equal zeros
        raw = [values[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], good, strict=True)]
        yield _io.to_batch(_PACKED, {"vec_id": batch.column(0), "vector": raw, "width": np.diff(ends).astype(np.int32)})


class Homes:
    """The pivots of one length of vectors, and the blocks of each one's home."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = unit_rows(pivots)
        between = np.sqrt(np.maximum(2 - 2 * (self.pivots @ self.pivots.T), 0))
        self.between = np.where(between < 1e-4, np.inf, between).astype(np.float32)  # pivots as good as equal part nothing: gap 0
        self.first = self.number = np.zeros(0, np.int64)

    def at_home(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(products with the pivots, number of the home)."""
        products = unit @ self.pivots.T
        return products, products.argmax(1)

    def gaps(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the home, gap to each other home)."""
        products, home = self.at_home(unit)
        return home, (products[np.arange(len(unit)), home][:, None] - products) / self.between[home]

    def place(self, counts: np.ndarray, most: int, first: int) -> int:
        """Number the blocks of all homes from ``first`` on; returns the next free number."""
        self.number = np.maximum(-(-counts // most), 1)
        self.first = first + np.cumsum(self.number) - self.number
        return int(first + self.number.sum())

    def cells(self, items: np.ndarray, unit: np.ndarray, far: float) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, cell, side, gap): where each row goes, some rows at a time."""
        of = np.repeat(np.arange(len(self.number)), self.number)
        for k in range(0, len(items), step := max(1, (1 << 22) // len(of))):
            home, gap = self.gaps(unit[k : k + step])
            own = self.first[home] + (_text.mix(items[k : k + step].astype(np.uint64)) % self.number[home].astype(np.uint64)).astype(np.int64)
            row, other = np.nonzero((gap <= far)[:, of])
            gap, mine, other = gap[row, of[other]], own[row], other + self.first[0]
            cell = (np.minimum(mine, other) << 31) | np.maximum(mine, other)
            yield row + k, cell, np.where(mine == other, 2, np.where(mine < other, 0, 1)), gap


_HOMES = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("home", T.IntegerType())])
_CELLS = T.StructType(
    [
        T.StructField("cell", T.LongType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("gap", T.FloatType()),
        T.StructField("item", T.LongType()),
        T.StructField("weight", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("vector", T.BinaryType()),
    ]
)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        widths = batch.column(batch.schema.get_field_index("width")).to_numpy()
        for width in np.unique(widths):
            own = batch.filter(pa.array(widths == width))
            yield int(width), own, unit_rows(_io.matrix(own.column(own.schema.get_field_index("vector")), int(width), np.float32))


def _homes(known: dict[int, Homes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, own, unit in _by_width(batches):
            yield _io.to_batch(_HOMES, {"width": np.full(len(own), width), "home": known[width].at_home(unit)[1]})

    return run


def _deal(known: dict[int, Homes], far: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, own, unit in _by_width(batches):
            item, weight, vector = (own.column(own.schema.get_field_index(c)) for c in ("item", "weight", "vector"))
            for row, cell, side, gap in known[width].cells(item.to_numpy(), unit, far):
                for k in range(0, len(row), step := max(1, (1 << 25) // (4 * width + 64))):
                    at = pa.array(row[k : k + step])
                    plain = {"cell": cell[k : k + step], "side": side[k : k + step], "gap": gap[k : k + step].astype(np.float32)}
                    yield _io.to_batch(_CELLS, plain | {"item": item.take(at), "weight": weight.take(at), "width": np.full(len(at), width), "vector": vector.take(at)})

    return run


def _without_pivots(items: DataFrame, tile: int) -> DataFrame:
    """Each pair of blocks of one length of vectors as a cell; its number is negative, those of homes aren't."""
    sizes = items.groupBy("width").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("n"))
    dealt = items.join(sizes, "width").withColumn("own", F.pmod(F.xxhash64(F.lit(7), "item"), F.col("n")).cast("int"))
    cell = F.xxhash64("width", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(-(1 << 63)))
    side = F.when(F.col("other") == F.col("own"), 2).when(F.col("other") > F.col("own"), 0).otherwise(1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.select(cell.alias("cell"), side.alias("side"), F.lit(0.0).cast("float").alias("gap"), "item", "weight", "width", "vector")


def cells(items: DataFrame, threshold: float, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """Where each class goes: (cell, side, gap, item, weight, width, vector)."""
    sizes = items.groupBy("width").count().orderBy(F.desc("count"), "width").limit(WIDTHS + 1).collect()
    known: dict[int, Homes] = {}
    for width, size in sizes[:WIDTHS]:
        # eight homes at least, so that there are some dozens of cells to deal out
        number = max(1, min(max(8, -(-size // tile)), pivots, NUMBERS // width))
        taken = items.where(F.col("width") == width).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(number).toArrow()
        known[width] = Homes(_io.matrix(taken.column(0).combine_chunks(), width, np.float32))
    some, rest = (items, None) if len(sizes) <= WIDTHS else (items.where(F.col("width").isin(*known)), items.where(~F.col("width").isin(*known)))
    counts = {w: np.zeros(len(h.pivots), np.int64) for w, h in known.items()}
    for width, home, count in some.select("width", "vector").mapInArrow(_homes(known), _HOMES).groupBy("width", "home").count().collect():
        counts[width][home] = count
    free = 0
    for width, homes in known.items():
        free = homes.place(counts[width], 2 * max(1, min(tile, (1 << 21) // width)), free)
    dealt = some.select("item", "weight", "width", "vector").mapInArrow(_deal(known, reach(threshold)), _CELLS)
    return dealt if rest is None else dealt.union(_without_pivots(rest, tile))


def near_embeddings(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding)."""
    rows = _io.pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = _io.materialize(rows.mapInArrow(_packed, _PACKED).withColumn("digest", F.sha2("vector", 256)), "vectors")
    some = rows.where("vector is not null and vec_id is not null")
    classes = some.groupBy("digest", "width").agg(F.min("vec_id").alias("item"), F.count("*").alias("weight"))
    items = some.join(classes, ["digest", "width"]).where("vec_id = item").select("item", "weight", "width", "vector").dropDuplicates(["item", "width", "vector"])
    items = _io.materialize(items, "classes")
    found = _io.materialize(cells(items, threshold, tile, pivots).repartition("cell").sortWithinPartitions("cell").mapInArrow(_tile(threshold), _FOUND), "tiles")
    counts = found.groupBy("item").agg(F.sum("links").alias("links"))
    joined = components(found.select("item", "rep"), "item", "rep").toDF("item", "component")
    named = classes.join(counts, "item", "left").join(joined, "item", "left").select("digest", "width", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "item").alias("component"))
    plain, rest = rows.where("vector is not null and vec_id is not null"), rows.where("vector is null or vec_id is null")
    out = plain.join(named, ["digest", "width"]).select("vec_id", "n_links", "component").union(rest.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
