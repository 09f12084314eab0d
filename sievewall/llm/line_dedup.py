"""Fuzzy line deduplication by MinHash.

Lines are what line feeds separate. Two lines link where the Jaccard similarity of
their sets of character shingles (``K`` code points; a shorter line is its own only
shingle) is at least ``similarity``. At 0.8 a line of 49 code points links to one with
a character in its middle changed, and one of 85 with a word of five letters changed;
of shorter lines only some edits link. A component of links keeps its first line, by
document id, then line number; the others go. Lines of white space alone stay.

1. Equal lines become one class, by a 128-bit hash, named by its first line.
2. A class's signature: one-permutation MinHash, empty bins filled from others chosen
   by hash, in ``BANDS`` bands of ``ROWS``. A pair at 0.8 shares a band with a
   probability above 0.996, one at 0.9 above 0.99999.
3. Classes that share a band are compared exactly, on their whole sets, within the
   band's group; pairs whose ends are joined by confirmed links already are passed
   over, and so are bands that hold the same classes as another. Large groups are
   compared in blocks (``groups``). No group has a cap.
4. Union-find over the confirmed links is distributed (``graph``).

A null text is empty. Lines of rows without an id link with nothing and stay. Repeated
rows, of one id and text, are one document: both keep or lose a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _io, _text, groups
from .graph import components

K, BANDS, ROWS = 5, 14, 5
#: Code points that are hashed at once.
AT_ONCE = 1 << 17
#: Bands of a shuffle partition, in the mean, that a task may hold in a hash table.
HASHED = 1 << 20
_VALUES = _text.keys(41, 0x10000)
_BAND = T.StructType([T.StructField("group", T.LongType()), T.StructField("item", T.LongType())])


def shingle_sets(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of each text, not distinct, and where each text's begin."""
    found, cuts, first = [], [np.zeros(1, np.int64)], 0
    while first < len(texts):  # as much at once as stays in a processor's cache
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= AT_ONCE:
            size += len(texts[last])
            last += 1
        hashes, ends = _shingles(texts[first:last], k)
        found.append(hashes)
        cuts.append(cuts[-1][-1] + ends[1:])
        first = last
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate(cuts)


def _shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    cp, ends = _text.points(texts)
    values = _VALUES[cp & 0xFFFF]
    if len(cp) and cp.max() > 0xFFFF:
        values += cp.astype(np.uint64) >> np.uint64(16) << np.uint64(48)
    length = np.diff(ends)
    short = (length > 0) & (length < k)
    cuts = np.zeros(len(ends), np.int64)
    np.cumsum(np.where(short, 1, np.maximum(length - k + 1, 0)), out=cuts[1:])
    windows = max(len(cp) - k + 1, 0)
    whole = np.zeros(len(cp), np.uint64)
    rolled = whole[:windows]
    rolled += values[:windows]
    for j in range(1, k):
        rolled *= np.uint64(_text.BASE)
        rolled += values[j : j + windows]
    rolled ^= rolled >> np.uint64(32)
    rolled *= np.uint64(0xC4CEB9FE1A85EC53)
    rolled ^= rolled >> np.uint64(32)
    keep = np.ones(len(cp), bool)
    for j in range(1, k):  # windows that run over the end of their text
        keep[np.maximum(ends[1:][length > 0] - j, 0)] = False
    if short.any():
        chars = np.repeat(short, length)
        own = np.concatenate([[0], np.cumsum(length[short])])
        whole[ends[:-1][short]] = _text.stretch(_text.running(values[chars]), own[:-1], own[1:])
        keep[ends[:-1][short]] = True
    return whole[keep], cuts


def signatures(hashes: np.ndarray, cuts: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of each text (of at least one shingle), with every bin filled."""
    rows = len(cuts) - 1
    bin_ = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    out = np.full(rows * bins, 0x1FFFFFFFF, np.int64)
    np.minimum.at(out, _text.rows_of(cuts) * bins + bin_.astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))
    out = out.reshape(rows, bins)
    full = out < 0x1FFFFFFFF
    r, b = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        other = (_text.mix((b + attempt * bins).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        hit = full[r, other]
        out[r[hit], b[hit]] = out[r[hit], other[hit]]
        r, b = r[~hit], b[~hit]
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _text.text_lists(batch.column("line")):
            sig = signatures(*shingle_sets(texts), BANDS * ROWS).astype(np.uint64)
            ids = batch.column("item").slice(first, len(texts)).to_numpy()
            node = np.empty((len(texts), BANDS), np.uint64)
            for i in range(BANDS):
                h = np.full(len(texts), i + 1, np.uint64)
                for j in range(ROWS):
                    h = _text.mix(h * np.uint64(_text.BASE) + sig[:, i * ROWS + j])
                node[:, i] = h
            yield _io.to_batch(_BAND, {"group": node.ravel().view(np.int64), "item": np.repeat(ids, BANDS)})


def _compare(similarity: float):
    top = round(similarity * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, item, side, label, starts in groups.cells(batches):
            hashes, cuts = _text.distinct(*shingle_sets(t.column("line").to_pylist()))
            sizes, cuts = np.diff(cuts), cuts.tolist()
            src, dst = [], []

            def confirm(i, j, hashes=hashes, cuts=cuts):
                x, y = hashes[cuts[i] : cuts[i + 1]], hashes[cuts[j] : cuts[j + 1]]
                both = _text.shared(x, y)
                return both > 0 and both * 1000 >= top * (len(x) + len(y) - both)

            pairs = starts[:-1][np.diff(starts) == 2]  # most cells
            fits = np.minimum(sizes[pairs], sizes[pairs + 1]) * 1000 >= top * np.maximum(sizes[pairs], sizes[pairs + 1])
            for a in pairs[fits & ((side[pairs] == 2) | (side[pairs] != side[pairs + 1])) & (label[pairs] != label[pairs + 1])].tolist():
                if confirm(a, a + 1):
                    src.append(a)
                    dst.append(a + 1)
            more = np.flatnonzero(np.diff(starts) > 2)
            for a, b in zip(starts[more].tolist(), starts[more + 1].tolist(), strict=True):
                own = sizes[a:b]

                def alike(i, others, own=own):
                    x, y = np.minimum(own[others], own[i]), np.maximum(own[others], own[i])
                    return np.where(x * 1000 >= top * y, x / np.maximum(y, 1), -1.0)

                for i, j in groups.forest(side[a:b], label[a:b], alike, lambda i, j, a=a: confirm(a + i, a + j)):
                    src.append(a + i)
                    dst.append(a + j)
            yield groups.to_edges(item, src, dst)

    return run


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, line_no, line) of all lines; doc: a hash of the whole text."""
    rows = _io.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", _doc("text").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


def _doc(text: str | Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(5), "line", F.length("line")))


def _has_text(line: str = "line"):
    return F.btrim(F.col(line), F.lit(" \t\n\x0b\f\r")) != ""


def _told(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, doc, line_no, keep_doc_id, keep_line_no) of each line."""
    lines = _keyed(_lines(docs))
    linking = lines.where(_has_text() & F.col("doc_id").isNotNull())
    first = F.min(F.struct(F.col("doc_id").alias("d"), F.col("line_no").alias("n"))).alias("first")
    classes = linking.groupBy("k1", "k2").agg(first, F.first("line").alias("line"), F.count("*").alias("lines"))
    classes = _io.materialize(classes.select(F.monotonically_increasing_id().alias("item"), "k1", "k2", "first.d", "first.n", "lines", "line"), "lines")
    bands = _io.materialize(classes.select("item", "line").mapInArrow(_bands, _BAND), "bands")
    # counts are combined before the shuffle, and a hot band is split by the skewed join: no task meets all of one
    shared = _io.materialize(bands.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "shared")
    hashed = shared.count() <= HASHED * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _io.materialize(bands.join(shared.hint("shuffle_hash") if hashed else shared, "group"), "members")
    _io.discard(bands)
    _io.discard(shared)
    sizes = members.groupBy("group").agg(F.count("*").alias("size"), F.min("item").alias("low"), F.sum(F.xxhash64("item").cast("decimal(20,0)")).alias("all"))
    sizes = _io.materialize(sizes.groupBy("size", "low", "all").agg(F.min("group").alias("group")).select("group", "size"), "sizes")
    links = groups.link(members, sizes, classes.select("item", "line"), _compare(similarity))
    joined = _io.materialize(components(links).toDF("item", "component"), "joined")
    _io.discard(members)
    _io.discard(sizes)
    own = classes.select("item", "k1", "k2", "d", "n", "lines")
    least = joined.join(own, "item").groupBy("component").agg(F.min(F.struct("d", "n")).alias("least"))
    # a line that is the only one of its class, and isn't joined to another, keeps itself
    named = own.join(joined.join(least, "component"), "item", "left").where("lines > 1 or component is not null").select("k1", "k2", F.coalesce("least.d", "d").alias("cd"), F.coalesce("least.n", "n").alias("cn"))
    links_at = _has_text() & F.col("doc_id").isNotNull()  # the others have no key, and are dealt out evenly
    found = lines.select("doc_id", "doc", "line_no", F.when(links_at, F.col("k1")).alias("k1"), F.when(links_at, F.col("k2")).otherwise(F.xxhash64("doc", "line_no")).alias("k2")).join(named, ["k1", "k2"], "left")
    return found.select("doc_id", "doc", "line_no", F.coalesce("cd", "doc_id").alias("keep_doc_id"), F.coalesce("cn", "line_no").alias("keep_line_no"))


def line_components(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, kept), a row for each line of ``docs`` (doc_id, text)."""
    return _told(docs, similarity).drop("doc").withColumn("kept", F.expr(_KEPT))


_KEPT = "(doc_id <=> keep_doc_id and line_no = keep_line_no)"


def drop_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the lines that aren't kept. A text that loses all its lines becomes empty; a null text stays null.

    Lines are dropped by id and text, so rows that share an id but not their text lose only their own.
    """
    gone = _told(docs, similarity).where(f"not {_KEPT}").groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("_gone")).toDF("_id", "_doc", "_gone")
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, texts = batch.column(len(schema)), batch.column(at).to_pylist()
            for i in np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = set(lost[i].as_py())
                texts[i] = "\n".join(line for n, line in enumerate(texts[i].split("\n")) if n not in own)
            columns = batch.columns[: len(schema)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[: len(schema)]))

    own = docs.select(*[docs[c] for c in docs.columns])
    joined = own.join(gone, (own["doc_id"].cast("long") == gone["_id"]) & (_doc(own["text"]) == gone["_doc"]), "left")
    return joined.select(*[own[c] for c in docs.columns], gone["_gone"]).mapInArrow(run, schema)
