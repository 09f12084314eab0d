"""Tables in the shared folder, and Arrow batches as numpy arrays.

Intermediate results that are read more than once are written as Parquet to the
folder that the cluster names in ``spark.checkpoint.dir``: this cuts lineage, and
any executor can read them again after another is lost.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
#: The tables written in this context, by path.
_written: ContextVar[dict[str, SparkSession] | None] = ContextVar("written", default=None)
_lock, _writers = threading.Lock(), [0]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one if it is unset and Spark is local."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {KEY} to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sievewall-"))
    return _own[0]


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it ends; the setting is put back when no thread writes any more."""
    with _lock:
        if not _writers[0]:
            _writers[1:] = [spark.conf.get(CLEANUP)]
            spark.conf.set(CLEANUP, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(CLEANUP, _writers.pop())


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written.

    The shuffle files of the write go when it ends: what was written replaces them. The table goes
    with the ``scope`` it was written in, unless ``keep``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievewall/{uuid.uuid4().hex}/{tag}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    files, folder = _folder(spark, path)
    files.deleteOnExit(folder)
    if not keep and (written := _written.get()) is not None:
        written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)
    files.cancelDeleteOnExit(folder)


def path_of(written: DataFrame) -> str:
    """The path of a table that ``materialize`` wrote."""
    return written.inputFiles()[0].rsplit("/", 1)[0]


def discard(written: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote; nothing that is still to run may read it."""
    path = path_of(written)
    _delete(written.sparkSession, path)
    for known in [x for x in _written.get() or () if x.rsplit("/", 2)[1:] == path.rsplit("/", 2)[1:]]:
        _written.get().pop(known)


@contextmanager
def scope() -> Iterator[None]:
    """Tables written within are deleted at its end: what needs them must have run by then."""
    token = _written.set({})
    try:
        yield
    finally:
        own = _written.get()
        _written.reset(token)
        for path, spark in own.items():
            try:
                _delete(spark, path)
            except Exception:  # noqa: S112  the session may have ended; what is left goes with the JVM
                continue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only; so extra columns, whatever their names, can't clash."""
    return df.select(*[df[c] for c in columns])


def to_batch(schema: T.StructType, columns: dict[str, object]) -> pa.RecordBatch:
    """A record batch of ``schema`` from numpy arrays, lists or Arrow arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    arrays = [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in want]
    return pa.RecordBatch.from_arrays(arrays, schema=want)


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """Binary values of one length as the rows of a matrix, without a copy for each."""
    if not len(column):
        return np.zeros((0, width), dtype)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return np.ascontiguousarray(data).view(dtype).reshape(len(column), width)


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = (np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def ragged(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``values``, cut at ``ends`` (one more than slices), as binary values."""
    cuts = (np.asarray(ends, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of a partition sorted by ``key``, cut anew so that no group is split over two."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(column, column[-1], "left"))
        if cut or rest and rest[-1].column(rest[-1].schema.get_field_index(key))[-1].as_py() != column[0]:
            if cut:
                rest.append(batch.slice(0, cut))
            yield pa.Table.from_batches(rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)
