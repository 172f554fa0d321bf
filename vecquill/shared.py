"""Helpers that every operator may use: intermediate tables in the shared
folder, and Arrow batches as numpy arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Whether an execution's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in
    ``spark.checkpoint.dir``. Where none is set, a session whose executors all
    run on this machine gets a temporary one; on a cluster that is an error, as
    executors would each write to a folder of their own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="vecquill-")
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted with the intermediate tables."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, never a
    recomputation, and the plan behind is computed exactly once. The write's
    shuffle files are deleted when it ends, not when the driver collects garbage.
    """
    path = scratch(df.sparkSession, "vq")
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vecquill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, once all that is built on
    them has been materialised itself."""
    for df in tables:
        entry = (df.sparkSession, df._vecquill_path)
        _written[:] = [w for w in _written if w[1] != entry[1]]
        _delete(*entry)


def release() -> None:
    """Delete every table that ``materialise`` wrote in this process, and every
    ``scratch`` path. Frames that still read them become unreadable; runs by
    itself at exit."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(release)


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float32) -> np.ndarray:
    """Rows of equal length, stored as lists or as packed little-endian
    float32 binaries, as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    if n == 0:
        return np.zeros((0, 0), dtype)
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
        flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return flat.view("<f4").reshape(n, -1).astype(dtype, copy=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(dtype, copy=False)


def packed(rows: np.ndarray) -> pa.Array:
    """The inverse of ``matrix``: a float32 matrix as a binary column."""
    rows = np.ascontiguousarray(rows, "<f4")
    n, width = len(rows), rows.shape[1] * 4 if rows.ndim == 2 else 0
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal values in the first ``keys`` columns, from
    batches sorted by them. Only the current group is held; with ``most``, a
    group comes in several tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    current = None
    size = 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        columns = [ints(batch.column(i)) for i in range(keys)]
        change = np.zeros(n - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for start, end in zip(edges, edges[1:]):
            key = tuple(c[start].item() for c in columns)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current, size = [], key, 0
            elif most and size >= most:
                yield current, pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(start, end - start))
            size += end - start
    if held:
        yield current, pa.Table.from_batches(held)
