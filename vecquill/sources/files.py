"""Vector files: headerless float32, fixed-width rows with ids, JSON rows.

Binary files are read by ranges: a table of row ranges is spread over the
executors, each of which opens the file at its own place, so no task and no
row ever holds a whole file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the id in a fixed-width row.
ID_BYTES = 32
RANGE_BYTES = 8 << 20


def _length(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Create or replace a file on any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for s in range(0, len(data), 1 << 22):
            out.write(bytearray(data[s : s + (1 << 22)]))
    finally:
        out.close()


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):  # with one slash, as Hadoop writes it, or with three
        path = "/" + path[5:].lstrip("/")
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def _ranges(spark: SparkSession, path: str, width: int, rows: int, decode, schema: str) -> DataFrame:
    each = max(1, RANGE_BYTES // width)
    parts = max(1, -(-rows // each))

    def run(batches):
        with _open(path) as f:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    begin, end = part * each, min(rows, (part + 1) * each)
                    f.seek(begin * width)
                    data = f.read((end - begin) * width)
                    if len(data) < (end - begin) * width:
                        raise RuntimeError("vectors mmap: file too small")
                    yield decode(begin, data)

    return spark.range(0, parts, 1, min(parts, 10_000)).mapInArrow(run, schema)


def _lists(flat: np.ndarray, dim: int) -> pa.Array:
    n = len(flat) // dim
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(flat))


def raw_vectors(spark: SparkSession, path: str, dim: int, external_ids: list[str] | DataFrame) -> DataFrame:
    """(pos, external_id, vec) of a row-major little-endian float32 file. The
    number of ids says how many rows are read; the file may be longer, a
    shorter one is an error. Ids come as a list, or as (pos, external_id)."""
    ids = external_ids
    if not isinstance(ids, DataFrame):
        ids = spark.createDataFrame([(i, str(e)) for i, e in enumerate(ids)], "pos bigint, external_id string")
    n = ids.count()
    if _length(spark, path) < n * dim * 4:
        raise RuntimeError("vectors mmap: file too small")

    def decode(begin, data):
        flat = np.frombuffer(data, "<f4")
        count = len(flat) // dim
        return pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + count)), _lists(flat, dim)], names=["pos", "vec"])

    return _ranges(spark, path, dim * 4, n, decode, "pos bigint, vec array<float>").join(ids, "pos").select("pos", "external_id", "vec")


def _text(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("ascii", "replace")


def fixed_width(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(pos, external_id, vec) of a file of rows with a 32-byte ASCII id,
    filled up with NULs, and ``dim`` float32. A broken last row is an error."""
    width = ID_BYTES + 4 * dim
    size = _length(spark, path)
    if size % width:
        raise ValueError(f"{size % width} bytes left over after the last row")

    def decode(begin, data):
        rows = np.frombuffer(data, np.dtype([("id", f"S{ID_BYTES}"), ("vec", "<f4", (dim,))]))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(begin, begin + len(rows))), pa.array([_text(i) for i in rows["id"].tolist()], pa.string()), _lists(np.ascontiguousarray(rows["vec"]).ravel(), dim)], names=["pos", "external_id", "vec"])

    return _ranges(spark, path, width, size // width, decode, "pos bigint, external_id string, vec array<float>")


def decode_chunks(chunks: Iterable[bytes], dim: int) -> Iterator[tuple[str, np.ndarray]]:
    """Rows of a fixed-width stream that arrives in chunks of any size."""
    width = ID_BYTES + 4 * dim
    carry = bytearray()
    for chunk in chunks:
        carry += chunk
        whole = len(carry) // width * width
        for at in range(0, whole, width):
            yield _text(bytes(carry[at : at + ID_BYTES])), np.frombuffer(bytes(carry[at + ID_BYTES : at + width]), "<f4")
        del carry[:whole]
    if carry:
        raise ValueError(f"{len(carry)} bytes left over after the last row")


def encode_rows(rows: Iterable[tuple[str, Iterable[float]]]) -> bytes:
    """Fixed-width rows; ids are cut to 32 bytes."""
    return b"".join(str(i).encode("ascii", "replace")[:ID_BYTES].ljust(ID_BYTES, b"\0") + np.asarray(v, "<f4").tobytes() for i, v in rows)


JSON_ROW = "index_name string, external_id string, vector array<float>"


def json_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(index_name, external_id, vec, problem) of JSON texts. ``problem`` is
    null for rows that may be ingested; an empty id counts as missing."""
    row = F.from_json(F.col(column), JSON_ROW)
    out = lines.select(row.alias("r")).select(F.col("r.index_name").alias("index_name"), F.col("r.external_id").alias("external_id"), F.col("r.vector").alias("vec"))
    missing = F.when(F.col("index_name").isNull(), "missing index_name").when(F.coalesce(F.col("external_id"), F.lit("")) == "", "missing external_id").when(F.col("vec").isNull(), "missing vector")
    return out.withColumn("problem", missing)


def to_json_rows(rows: DataFrame, index_name: str) -> DataFrame:
    """(value): the inverse of ``json_rows`` for (external_id, vec)."""
    return rows.select(F.to_json(F.struct(F.lit(index_name).alias("index_name"), "external_id", F.col("vec").alias("vector"))).alias("value"))


def answers_json(found: DataFrame) -> DataFrame:
    """(qid, value): each query's ids, nearest first, as a JSON array. Takes
    (qid, rank, external_id); a query's ids are as many as its ``k``."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "external_id")))
    return found.groupBy("qid").agg(F.to_json(F.transform(ordered, lambda r: r["external_id"])).alias("value"))
