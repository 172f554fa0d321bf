"""Optional approximate search: k-means cells with partition pruning, and
locality-sensitive hashing. Exact search is the default everywhere else."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import ints, matrix
from .knn import _FOUND, Best


class Cells:
    """Rows partitioned by their nearest k-means center. The fit uses at most
    about ``sample`` rows; every row is indexed."""

    def __init__(self, spark: SparkSession, path: str, centers: np.ndarray):
        self.spark, self.path, self.centers = spark, path, centers

    @classmethod
    def write(cls, x: DataFrame, path: str, cells: int = 16, sample: int = 100_000, seed: int = 0, idx: str = "idx", vec: str = "vec") -> Cells:
        rows = x.select(F.col(idx).cast("bigint").alias("idx"), F.col(vec).cast("array<float>").alias("vec"))
        n = rows.count()
        fit = rows.sample(fraction=min(1.0, sample / max(1, n)), seed=seed) if n > sample else rows
        model = KMeans(k=cells, seed=seed, featuresCol="f").fit(fit.select(array_to_vector("vec").alias("f")))
        centers = np.array(model.clusterCenters())
        shared = x.sparkSession.sparkContext.broadcast(centers)

        def run(batches):
            c = shared.value
            for b in batches:
                if b.num_rows:
                    v = matrix(b.column(1), np.float64)
                    cell = ((c * c).sum(1)[None] - 2 * v @ c.T).argmin(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], names=["idx", "vec", "cell"])

        assigned = rows.mapInArrow(run, "idx bigint, vec array<float>, cell int")
        assigned.repartition("cell", F.pmod(F.xxhash64("idx"), F.lit(8))).write.partitionBy("cell").mode("overwrite").parquet(path)
        return cls(x.sparkSession, path, centers)

    def search(self, q: DataFrame, k: int, probes: int = 4, qid: str = "qid", query: str = "q", most: int = 65536) -> DataFrame:
        """(qid, rank, idx, dist) among the ``probes`` nearest cells of each
        query; at most ``most`` queries at once. Only probed cells are read."""
        rows = q.select(F.col(qid).cast("bigint"), F.col(query).cast("array<float>")).limit(most + 1).toArrow()
        if rows.num_rows > most:
            raise ValueError(f"more than {most} queries; pass them in blocks")
        ids, v = ints(rows.column(0)), matrix(rows.column(1))
        if not len(ids):
            return self.spark.createDataFrame([], "qid bigint, rank bigint, idx bigint, dist double")
        d = (self.centers**2).sum(1)[None] - 2 * v.astype(np.float64) @ self.centers.T
        near = np.argsort(d, axis=1, kind="stable")[:, :probes]
        shared = self.spark.sparkContext.broadcast((ids, v, near))

        def run(batches):
            ids, v, near = shared.value
            best: dict[int, tuple[np.ndarray, Best]] = {}
            for b in batches:
                cells = ints(b.column(2))
                for cell in np.unique(cells).tolist():
                    if cell not in best:
                        asked = np.flatnonzero((near == cell).any(1))
                        best[cell] = asked, Best(v[asked], None, k)
                    asked, state = best[cell]
                    own = np.flatnonzero(cells == cell)
                    if len(asked):
                        state.add(ints(b.column(0))[own], matrix(b.column(1))[own])
            for asked, state in best.values():
                yield state.rows(ids[asked])

        x = self.spark.read.parquet(self.path).where(F.col("cell").isin(np.unique(near).tolist())).select("idx", "vec", "cell")
        w = Window.partitionBy("qid").orderBy("dist", "idx")
        found = x.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(w).cast("bigint") - 1)
        return found.where(F.col("rank") < k).select("qid", "rank", "idx", "dist")


def fit_centers(x: DataFrame, cells: int, sample: int, seed: int, vec: str = "vec") -> np.ndarray:
    """K-means centers of at most about ``sample`` rows."""
    n = x.count()
    fit = x.sample(fraction=sample / n, seed=seed) if n > sample else x
    return np.array(KMeans(k=cells, seed=seed, featuresCol="f").fit(fit.select(array_to_vector(vec).alias("f"))).clusterCenters())


def nearest_cells(v: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first."""
    d = (centers**2).sum(1)[None] - 2 * v.astype(np.float64) @ centers.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def held(v: np.ndarray, centers: np.ndarray, k: int = 10, queries: int = 256) -> list[float]:
    """The share of the ``k`` nearest other rows that the 1, 2, ... nearest
    cells hold, by brute force of some rows against all given ones. In a sample
    neighbours lie farther apart than in all data, so the share is rather low."""
    asked = np.arange(len(v))[:: max(1, len(v) // queries)][:queries]
    best = Best(v[asked], asked, min(k, max(1, len(v) - 1)))
    best.add(np.arange(len(v)), v)
    found = np.isfinite(best.dist)
    order = nearest_cells(v[asked], centers, len(centers))
    cell = nearest_cells(v, centers, 1)[:, 0]
    place = np.argsort(order, axis=1)[np.nonzero(found)[0], cell[best.idx[found]]]
    return (np.cumsum(np.bincount(place, minlength=len(centers))) / max(1, len(place))).tolist()


def with_cell(rows: DataFrame, centers: np.ndarray, vec: str = "vec") -> DataFrame:
    """``rows`` with the nearest cell as their last column."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)
    at = rows.columns.index(vec)

    def run(batches):
        for b in batches:
            cell = nearest_cells(matrix(b.column(at)), shared.value, 1)[:, 0].astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def probe(rows: DataFrame, queries: DataFrame, centers: np.ndarray, probes: int, k: int, qid: str = "qid", query: str = "q", most: int = 32768) -> DataFrame:
    """(qid, rank, value, dist) among the ``probes`` nearest cells of each query;
    rows are (cell, i0, i1, value, v), ties by (i0, i1). Queries are broadcast
    in blocks of about ``most``; only probed cells are read."""
    q = queries.select(F.col(qid).cast("bigint").alias("i"), F.col(query).cast("array<float>").alias("v")).where("v is not null")
    first = q.limit(most + 1).toArrow()
    blocks = 1 if first.num_rows <= most else -(-q.count() // most)
    schema = "qid bigint, idx bigint, idx2 bigint, value string, dist double"
    found = []
    for block in range(blocks):
        some = first if blocks == 1 else q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toArrow()
        ids, v = ints(some.column(0)), matrix(some.column(1))
        if not len(ids):
            continue
        if v.shape[1] != centers.shape[1]:
            raise RuntimeError("Dim mismatch between X and Q")
        near = nearest_cells(v, centers, probes)
        shared = rows.sparkSession.sparkContext.broadcast((ids, v, near))

        def run(batches, shared=shared):
            ids, v, near = shared.value
            best: dict[int, tuple[np.ndarray, Best]] = {}
            for b in batches:
                cells = ints(b.column(0))
                for cell in np.unique(cells).tolist():
                    if cell not in best:
                        asked = np.flatnonzero((near == cell).any(1))
                        best[cell] = asked, Best(v[asked], None, k, 2, True)
                    asked, state = best[cell]
                    own = np.flatnonzero(cells == cell)
                    if len(asked):
                        part = b.take(pa.array(own))
                        state.add([ints(part.column(1)), ints(part.column(2))], matrix(part.column(4)), np.array(part.column(3).to_pylist(), object))
            for asked, state in best.values():
                yield state.rows(ids[asked])

        w = Window.partitionBy("qid").orderBy("dist", "idx", "idx2")
        part = rows.where(F.col("cell").isin(np.unique(near).tolist())).mapInArrow(run, schema)
        found.append(part.withColumn("rank", F.row_number().over(w).cast("bigint") - 1).where(F.col("rank") < k))
    if not found:
        return rows.sparkSession.createDataFrame([], "qid bigint, rank bigint, value string, dist double")
    return reduce(DataFrame.unionByName, found).select("qid", "rank", "value", "dist")


def hashed(x: DataFrame, q: DataFrame, k: int, radius: float, tables: int = 8, width: float = 2.0, seed: int = 0, idx: str = "idx", vec: str = "vec", qid: str = "qid", query: str = "q") -> DataFrame:
    """(qid, rank, idx, dist): the ``k`` nearest within squared distance
    ``radius`` among rows that share a bucket of random projections."""
    a = x.select(F.col(idx).cast("bigint").alias("idx"), array_to_vector(vec).alias("f"))
    b = q.select(F.col(qid).cast("bigint").alias("qid"), array_to_vector(query).alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(a)
    near = model.approxSimilarityJoin(b, a, float(np.sqrt(radius)), "l2")
    found = near.select(F.col("datasetA.qid").alias("qid"), F.col("datasetB.idx").alias("idx"), (F.col("l2") * F.col("l2")).alias("dist"))
    w = Window.partitionBy("qid").orderBy("dist", "idx")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint") - 1).where(F.col("rank") < k).select("qid", "rank", "idx", "dist")
