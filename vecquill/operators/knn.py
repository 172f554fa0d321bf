"""Exact nearest neighbours under squared L2, ties by row id (or by any
columns of whole numbers).

Batches of queries are broadcast in blocks of bounded size. Each task keeps the
k best rows per query over its whole partition, so the shuffle carries k rows
per query and partition however many rows there are. Distances that decide are
differences in double precision; the matrix product only shortlists.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import l2_sqr
from ..shared import ints, materialise, matrix

#: Bytes of query vectors in one broadcast.
BLOCK_BYTES = 32 << 20
#: Bytes of the best rows that a task keeps for a block of queries.
BEST_BYTES = 64 << 20
#: Rows compared at once.
ROWS = 32768

_FOUND = "qid bigint, idx bigint, dist double"


class Best:
    """The k best rows for each of a block of queries, by distance, then by
    the keys in their order. Rows may carry a value of any kind."""

    def __init__(self, queries: np.ndarray, own: np.ndarray | None, k: int, keys: int = 1, carries: bool = False):
        self.q = queries.astype(np.float64)
        self.sq = (self.q * self.q).sum(1)
        self.own, self.k = own, k
        self.dist = np.full((len(queries), k), np.inf)
        self.keys = [np.full((len(queries), k), np.iinfo(np.int64).max) for _ in range(keys)]
        self.values = np.full((len(queries), k), None, object) if carries else None

    @property
    def idx(self) -> np.ndarray:
        return self.keys[0]

    def add(self, ids: np.ndarray | list[np.ndarray], x: np.ndarray, values: np.ndarray | None = None) -> None:
        keys = [ids] if isinstance(ids, np.ndarray) else ids
        x = x.astype(np.float64)
        sx = (x * x).sum(1)
        step = int(max(16, (1 << 22) // max(1, len(x))))
        for s in range(0, len(self.q), step):
            q = self.q[s : s + step]
            d = sx[None] - 2 * (q @ x.T)
            d += self.sq[s : s + step, None]
            limit = self.dist[s : s + step, -1]
            room = self.k + (self.own is not None)
            if len(x) > room:
                limit = np.minimum(limit, np.partition(d, room - 1, axis=1)[:, room - 1])
            slack = 1e-12 * (self.sq[s : s + step] + sx.max(initial=0)) + 1e-300
            i, j = np.nonzero(d <= (limit + 2 * slack)[:, None])
            if self.own is not None:
                ok = self.own[s + i] != keys[0][j]
                i, j = i[ok], j[ok]
            e = np.empty(len(i))
            for t in range(0, len(i), 65536):
                gap = q[i[t : t + 65536]] - x[j[t : t + 65536]]
                e[t : t + 65536] = np.einsum("ij,ij->i", gap, gap)
            rows = np.unique(i)
            n, m = len(rows), len(i)
            # merge with what is known
            qi = np.r_[np.searchsorted(rows, i), np.repeat(np.arange(n), self.k)]
            dd = np.r_[e, self.dist[s + rows].ravel()]
            both = [np.r_[key[j], known[s + rows].ravel()] for key, known in zip(keys, self.keys)]
            order = np.lexsort((*reversed(both), dd, qi))
            rank = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
            at, rank = order[rank < self.k], rank[rank < self.k]
            if self.values is not None:
                held = self.values[s + rows].ravel()
                old = at >= m
                value = np.empty(len(at), object)
                value[old], value[~old] = held[at[old] - m], values[j[at[~old]]]
                self.values[s + rows[qi[at]], rank] = value
            self.dist[s + rows[qi[at]], rank] = dd[at]
            for key, known in zip(both, self.keys):
                known[s + rows[qi[at]], rank] = key[at]

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        found = np.isfinite(self.dist)
        i, _ = np.nonzero(found)
        columns = {"qid": pa.array(qid[i])} | {("idx", "idx2")[n]: pa.array(key[found]) for n, key in enumerate(self.keys)}
        if self.values is not None:
            columns["value"] = pa.array(self.values[found].tolist(), pa.string())
        columns["dist"] = pa.array(self.dist[found])
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _check_k(k: int) -> None:
    if k < 1:
        raise RuntimeError("k must be ≥ 1")


def _dim(df: DataFrame, vec: str) -> int | None:
    """The length of some vector; None without rows. Reads one row."""
    row = df.select(F.size(vec)).first()
    return row[0] if row else None


def _of_dim(vec: str, dim: int, message: str):
    """The column, with an error at the first vector of another length. It is
    part of the scan, so no extra pass over the data is needed."""
    return F.when(F.size(vec) == dim, F.col(vec)).otherwise(F.raise_error(F.lit(message)).cast("array<float>"))


def knn(x: DataFrame, q: DataFrame, k: int, idx: str = "idx", vec: str = "vec", qid: str = "qid", query: str = "q", itself: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, rank, idx, dist): the ``k`` nearest rows of ``x`` for every query,
    rank from 0; fewer where ``x`` is smaller. With ``itself`` false, a row is
    no neighbour of the query with its own id.

    No rows on either side give no result. Sides of different length are a
    RuntimeError; should lengths differ within a side, the job fails. Vectors
    that are null are left out. Columns other than the four named are ignored.
    """
    rows = x.select(F.col(idx).cast("bigint").alias("i"), F.col(vec).cast("array<float>").alias("v"))
    return _nearest(rows, q, k, qid, query, 1, itself, block_bytes).select("qid", "rank", "idx", "dist")


def knn_carrying(x: DataFrame, q: DataFrame, k: int, ties: tuple[str, str], value: str, vec: str = "vec", qid: str = "qid", query: str = "q", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, rank, value, dist) like ``knn``, for rows that two columns of
    whole numbers put in order; the text ``value`` of each row comes along,
    so ``x`` is read once. Nulls and lengths as in ``knn``."""
    rows = x.select(*(F.col(c).cast("bigint").alias(f"i{n}") for n, c in enumerate(ties)), F.col(value).alias("value"), F.col(vec).cast("array<float>").alias("v"))
    return _nearest(rows, q, k, qid, query, 2, True, block_bytes).select("qid", "rank", "value", "dist")


def _nearest(x: DataFrame, q: DataFrame, k: int, qid: str, query: str, keys: int, itself: bool, block_bytes: int) -> DataFrame:
    """``x`` is (keys..., value if there are two keys, v)."""
    _check_k(k)
    carries = keys > 1
    schema = "qid bigint, idx bigint, idx2 bigint, value string, dist double" if carries else _FOUND
    x = x.where("v is not null")
    q = q.select(F.col(qid).cast("bigint").alias("i"), F.col(query).cast("array<float>").alias("v")).where("v is not null")
    spark = x.sparkSession
    dim = _dim(x, "v")
    if dim is None:
        return spark.createDataFrame([], schema + ", rank bigint")
    # a first block tells whether there are more queries than one broadcast takes
    each = max(1, min(block_bytes // max(1, dim * 4), BEST_BYTES // (24 * k)))
    first = q.limit(each + 1).toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], schema + ", rank bigint")
    lengths = pc.list_value_length(first.column(1)).to_numpy()
    if (lengths != dim).any():
        raise RuntimeError("Dim mismatch between X and Q" if (lengths == lengths[0]).all() else "X and Q must be 2-D float32")
    blocks = 1 if first.num_rows <= each else -(-q.count() // each)
    x, q = (df.withColumn("v", _of_dim("v", dim, "X and Q must be 2-D float32")) for df in (x, q))
    w = Window.partitionBy("qid").orderBy("dist", *("idx", "idx2")[:keys])
    found: list[DataFrame] = []
    for b in range(blocks):
        some = first if blocks == 1 else q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow()
        if not some.num_rows:
            continue
        shared = spark.sparkContext.broadcast((ints(some.column(0)), matrix(some.column(1))))

        def run(batches, shared=shared):
            ids, queries = shared.value
            best = None
            held, n = [], 0

            def flush():
                nonlocal best
                if best is None:
                    best = Best(queries, None if itself else ids, k, keys, carries)
                columns = [np.concatenate(c) for c in zip(*held)]
                best.add(columns[:keys], columns[-1], columns[keys] if carries else None)

            for batch in batches:
                if batch.num_rows:
                    own = [ints(batch.column(c)) for c in range(keys)]
                    own += [np.array(batch.column(keys).to_pylist(), object)] if carries else []
                    held.append([*own, matrix(batch.column(batch.num_columns - 1))])
                    n += batch.num_rows
                if n >= ROWS:
                    flush()
                    held, n = [], 0
            if held:
                flush()
            if best is not None:
                yield best.rows(ids)

        part = x.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w).cast("bigint") - 1).where(F.col("rank") < k)
        if blocks > 1:  # each block's broadcast is freed before the next
            part = materialise(part)
            shared.unpersist()
        found.append(part)
    return reduce(DataFrame.unionByName, found)


def knn_within(x: DataFrame, q: DataFrame, group: str, k: int, idx: str = "idx", vec: str = "vec", qid: str = "qid", query: str = "q", block_rows: int = 65536) -> DataFrame:
    """(qid, idx, dist): the ``k`` nearest rows of each query's own group, as
    many as there are. Queries are broadcast in blocks of about
    ``block_rows``; rows stay where they are. Null groups match nothing, null
    vectors are left out, vectors of unequal length make the job fail."""
    _check_k(k)
    x = x.select(F.col(group).alias("g"), F.col(idx).cast("bigint").alias("i"), F.col(vec).cast("array<float>").alias("v")).where("v is not null and g is not null")
    q = q.select(F.col(group).alias("g"), F.col(qid).cast("bigint").alias("i"), F.col(query).cast("array<float>").alias("v")).where("v is not null and g is not null").dropDuplicates(["i"])
    dim = _dim(q, "v")
    if dim is None:
        return x.sparkSession.createDataFrame([], _FOUND)
    x, q = (df.withColumn("v", _of_dim("v", dim, "Dim mismatch between X and Q")) for df in (x, q))
    blocks = max(1, -(-q.count() // block_rows))
    out = None
    for b in range(blocks):
        some = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)).toArrow()
        names = np.array(some.column(0).to_pylist(), object)
        ids, v = ints(some.column(1)), matrix(some.column(2))
        shared = x.sparkSession.sparkContext.broadcast({g: (ids[names == g], v[names == g]) for g in set(names)})

        def run(batches, shared=shared):
            state: dict = {}
            for batch in batches:
                words = batch.column(0).dictionary_encode()
                codes, own, rows = ints(words.indices), ints(batch.column(1)), matrix(batch.column(2))
                for code, g in enumerate(words.dictionary.to_pylist()):
                    if g in shared.value:
                        at = codes == code
                        if g not in state:
                            state[g] = Best(shared.value[g][1], None, k)
                        state[g].add(own[at], rows[at])
            for g, best in state.items():
                yield best.rows(shared.value[g][0])

        w = Window.partitionBy("qid").orderBy("dist", "idx")
        part = x.mapInArrow(run, _FOUND).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
        out = part if out is None else out.unionByName(part)
    return out


def all_knn(x: DataFrame, k: int, idx: str = "idx", vec: str = "vec", **options) -> DataFrame:
    """The ``k`` nearest other rows for every row; nulls and empty input as in
    ``knn``. The work is quadratic; ``operators.ann`` prunes it."""
    return knn(x, x, k, idx, vec, idx, vec, itself=False, **options)


def nearest_one(x: DataFrame, q, k: int, vec: str = "vec", ties: tuple[str, ...] = ("idx",)) -> DataFrame:
    """``x`` with its distance from one constant query, the ``k`` nearest in
    order; stays in the JVM and plans as TakeOrderedAndProject."""
    return x.withColumn("dist", l2_sqr(F.col(vec), q)).orderBy("dist", *ties).limit(k)


def brute_knn_batch(x, q, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact neighbours of arrays on the driver: (indices, squared distances)
    of shape (queries, min(k, rows)), by distance, then index."""
    x, q = np.asarray(x, np.float32), np.asarray(q, np.float32)
    if x.ndim != 2 or q.ndim != 2:
        raise RuntimeError("X and Q must be 2-D float32")
    if x.shape[1] != q.shape[1]:
        raise RuntimeError("Dim mismatch between X and Q")
    _check_k(k)
    k = min(k, len(x))
    if not k or not len(q):
        return np.zeros((len(q), k), np.int32), np.zeros((len(q), k), np.float32)
    best = Best(q, None, k)
    for s in range(0, len(x), ROWS):
        best.add(np.arange(s, min(len(x), s + ROWS)), x[s : s + ROWS])
    return best.idx.astype(np.int32), best.dist.astype(np.float32)


def all_knn_batch(x, k: int) -> np.ndarray:
    """Indices of the min(k, rows - 1) nearest other rows of every row of an
    array on the driver."""
    x = np.asarray(x, np.float32)
    if x.ndim != 2:
        raise RuntimeError("X and Q must be 2-D float32")
    _check_k(k)
    k = min(k, len(x) - 1)
    if k < 1:
        return np.zeros((len(x), 0), np.int32)
    best = Best(x, np.arange(len(x)), k)
    for s in range(0, len(x), ROWS):
        best.add(np.arange(s, min(len(x), s + ROWS)), x[s : s + ROWS])
    return best.idx.astype(np.int32)
