"""Problem 3: a varied subset by distributed farthest-first k-center.

Each block of records greedily selects representatives, always the record
farthest from those selected; the selections are pooled and selected from
again, in as many levels as it takes for one task to hold a collection's pool.
The greedy rule makes the result cover the collection within a constant factor
of the best radius, and a crowded region gets no more representatives than its
extent calls for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, ints, materialise, matrix, packed, sorted_groups
from .vectors import squared

#: Records that one greedy selection takes from at once.
BLOCK = 32768

_ROWS = "c string, id bigint, vec binary, place int, gap double"


def farthest_first(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows selected, in order, and the distance of each from those before it
    (infinite for the first, which is the least id). Ties go to the smaller
    id. Ends early when only copies of selected vectors are left."""
    order = np.argsort(ids, kind="stable")
    x = x[order].astype(np.float64)
    open_ = np.full(len(x), np.inf)
    rows, gaps = [], []
    at = 0
    while len(rows) < k and len(x):
        if rows:
            at = int(open_.argmax())
            if open_[at] <= 0:
                break
        rows.append(at)
        gaps.append(float(np.sqrt(open_[at])))
        d = x - x[at]
        np.minimum(open_, np.einsum("ij,ij->i", d, d), out=open_)
    return order[rows], np.array(gaps)


def _emit(name, ids, x, k):
    rows, gaps = farthest_first(ids, x, k)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows), pa.string()), pa.array(ids[rows]), packed(x[rows]), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(gaps)], names=["c", "id", "vec", "place", "gap"]
    )


def _base(records: DataFrame, id_: str, collection: str, vector: str) -> DataFrame:
    return records.select(F.col(collection).alias("c"), F.col(id_).cast("bigint").alias("id"), F.col(vector).alias("v"))


def select(records: DataFrame, k: int, id_: str = "req_id", collection: str = "index_name", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(collection, place, id, gap, represents, radius): for each collection
    ``k`` representatives of its usable records, in order of selection.

    ``gap`` is the distance from those selected before. ``represents`` counts
    the records whose nearest representative this is, ``radius`` is the
    largest distance among them. A collection with fewer distinct vectors than
    ``k`` gives one representative for each. A record delivered twice counts
    once; empty input gives an empty result.
    """
    base = _base(records, id_, collection, vector)
    chosen = _chosen(base, k, block)
    total = _assigned(base, chosen).groupBy("c", "id").agg(F.count(F.lit(1)).alias("represents"), F.max("far").alias("radius"))
    out = chosen.join(total, ["c", "id"]).select("c", F.col("place").cast("bigint").alias("place"), "id", "gap", "represents", "radius")
    return out.withColumnRenamed("c", collection).withColumnRenamed("id", id_)


def members(records: DataFrame, k: int, id_: str = "req_id", collection: str = "index_name", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(collection, id, representative, place, distance): the selection in
    full, every usable record with the representative that stands for it; the
    rows with id = representative are the selected ones."""
    base = _base(records, id_, collection, vector)
    chosen = _chosen(base, k, block)
    out = _assigned(base, chosen).join(chosen.select("c", "id", F.col("place").cast("bigint").alias("place")), ["c", "id"])
    return out.select(F.col("c").alias(collection), F.col("member").alias(id_), F.col("id").alias("representative"), "place", F.col("far").alias("distance"))


def _chosen(base: DataFrame, k: int, block: int) -> DataFrame:
    """The selected rows of each collection. A block holds at least four times
    what it selects, so that every level shrinks the pool."""
    block = max(block, 4 * k)

    def blocks(batches):
        held, n = [], 0

        def flush():
            t = pa.Table.from_batches(held)
            words = t.column(0).combine_chunks().dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            codes, ids, x = ints(words.indices), ints(t.column(1)), matrix(t.column(2))
            for code, name in enumerate(words.dictionary.to_pylist()):
                own = codes == code
                yield _emit(name, ids[own], x[own], k)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= block:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    pool = materialise(base.mapInArrow(blocks, _ROWS))

    def again(batches):
        for _, t in sorted_groups(batches, 2):
            yield _emit(t.column(2)[0].as_py(), ints(t.column(3)), matrix(t.column(4)), k)

    def level(rows: DataFrame, salt) -> DataFrame:
        keyed = rows.select(F.xxhash64("c").alias("h"), salt.cast("int").alias("salt"), "c", "id", "vec")
        return keyed.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(again, _ROWS)

    while True:
        most = pool.groupBy("c").count().agg(F.max("count")).first()[0] or 0
        if most <= block:
            break
        # each group selects k of `block` rows, so a level shrinks the pool by block / k
        old, pool = pool, materialise(level(pool, F.pmod(F.xxhash64("id"), F.lit(-(-most // (block // 2))))))
        discard(old)
    chosen = materialise(level(pool, F.lit(0)))
    discard(pool)
    return chosen


def _assigned(base: DataFrame, chosen: DataFrame, at_once: int = 65536) -> DataFrame:
    """(c, id, member, far): every record once, with its nearest
    representative (ties: the one selected first). Representatives are
    broadcast, about ``at_once`` of them at a time; beyond that, collections
    are processed in groups."""
    n = chosen.count()
    groups = max(1, -(-n // at_once))
    counts = None
    for g in range(groups):
        some = chosen.where(F.pmod(F.xxhash64("c"), F.lit(groups)) == g).orderBy("c", "place").select("c", "id", "vec").toArrow()
        words = np.array(some.column(0).to_pylist(), object)
        ids = ints(some.column(1))
        x = matrix(some.column(2), np.float64) if some.num_rows else np.zeros((0, 1))
        shared = base.sparkSession.sparkContext.broadcast({w: (ids[words == w], x[words == w]) for w in set(words)})

        def run(batches, shared=shared):
            for batch in batches:
                words = np.array(batch.column(0).to_pylist(), object)
                own_ids, x = ints(batch.column(1)), matrix(batch.column(2), np.float64)
                for name in sorted(set(words) & set(shared.value)):
                    rows = np.flatnonzero(words == name)
                    ids, m = shared.value[name]
                    d = squared(x[rows], m)
                    near = d.argmin(1)
                    gap = x[rows] - m[near]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(ids[near]), pa.array(own_ids[rows]), pa.array(np.sqrt(np.einsum("ij,ij->i", gap, gap)))], names=["c", "id", "member", "far"])

        # one row per record, so that a second delivery isn't counted
        part = base.mapInArrow(run, "c string, id bigint, member bigint, far double")
        counts = part if counts is None else counts.unionByName(part)
    return counts.dropDuplicates(["c", "member"])
