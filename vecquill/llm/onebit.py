"""Problem 5: nearest records by randomly rotated one-bit codes.

Within a cell (see ``vectors``) each record's residual from the cell's middle
is rotated at random into more dimensions and reduced to the signs, packed
into 64-bit words, and one correction scalar, the inner product of the unit
residual with its own code. Records are sorted by the residual's norm. A query
goes through three stages, each for what the one before leaves:

1. blocks of records whose norms alone keep them farther away than the k-th
   best known are skipped; in the others the bits that differ between the
   codes are counted, and bound the angle;
2. the codes' bytes look up the query's partial sums; with the correction
   scalar these give an unbiased estimate of the inner product, and a bound on
   its error that shrinks with the number of bits;
3. records whose lower bound on the distance does not exceed the k-th best
   known are reranked by exact distances in double precision. In blocks of
   which the estimates leave much, as in the middle of a loose cluster, the
   next queries are reranked at once: by a product in single precision, then
   exactly what that leaves within its rounding.

Neighbours farther than the radius are not wanted, so cells need only their
guests; the error bounds (and, in cells too large for one task, the choice of
inner cells, which is all of them up to a few, or all within the radius with
``probes`` none) are what may miss a neighbour. ``missed`` measures that share.

Guests and inner cells make copies of a record. Where that are many, each record
is written once with the list of its cells, and the cells are searched in rounds,
so that no more than about ``AT_ONCE`` copies of a record are on disk at a time.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, ints, materialise, matrix, sorted_groups
from .vectors import assign, by_cell, content_hash, copies, exact_pairs, fit_cells, in_round, squared

BITS = 64
#: Standard errors that the bound on the estimate allows for, and that on the number of different bits.
SURE, SURE_BITS = 3.0, 4.0
#: Queries and records whose codes are compared at once.
_QUERIES, _BLOCK = 64, 4096
#: Share of a block's pairs up to which estimates are looked up pair by pair.
_FEW = 0.02
#: Relative rounding in single precision.
_SLACK = 2e-5
#: Guests of a cell that a task holds at once.
GUESTS = 1 << 17
#: Cells estimated above this many records are split inside.
SPLIT_ABOVE = 24576
#: Rows that are moved at once, for each record; more are moved in rounds.
AT_ONCE = 2.0


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int, seed: int = 7) -> np.ndarray:
    """``bits`` x ``dim``, orthonormal columns: keeps all inner products."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, max(bits, dim))))[0][:, :dim].astype(np.float32)


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norms and correction scalars of residuals ``x``."""
    y = x @ rotation(x.shape[1], bits).T
    norm = np.sqrt((x * x).sum(1))
    scalar = np.abs(y).sum(1) / (np.sqrt(bits) * np.maximum(norm, 1e-30))
    return np.packbits(y > 0, axis=1), norm, np.where(norm > 0, scalar, 1).astype(np.float32)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between all pairs of codes (rows of 64-bit words)."""
    out = np.bitwise_count(a[:, :1] ^ b[None, :, 0])
    for w in range(1, a.shape[1]):
        out = out.astype(np.uint16) + np.bitwise_count(a[:, w : w + 1] ^ b[None, :, w])
    return out


def _most_bits(norm: np.ndarray, low: float, high: float, limit: np.ndarray, bits: int) -> np.ndarray:
    """Bits in which a query of this norm may differ from a record with a norm
    between ``low`` and ``high`` and a squared distance up to ``limit``."""
    q = np.maximum(norm, 1e-30)
    rest = q * q - limit
    at = np.maximum(np.where(rest > 0, np.clip(np.sqrt(np.maximum(rest, 0)), low, high), low), 1e-30)
    share = np.arccos(np.clip((rest / at + at) / (2 * q), -1, 1)) / np.pi
    return np.ceil(bits * share + SURE_BITS * np.sqrt(bits * share * (1 - share))) + 1


def nearest(qids: np.ndarray, qx: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, limit: float, bits: int = BITS, sure: float = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, row of the neighbour, squared distance): for each
    query the ``k`` nearest rows of another id up to ``limit``, ties by id.
    Ids of rows are distinct; ``bits`` is a multiple of 64."""
    n = len(ids)
    if not n or not len(qids):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    mid = np.median(x.astype(np.float64), axis=0)
    o, oq = (x - mid).astype(np.float32), (qx - mid).astype(np.float32)
    codes, norm, scalar = encode(o, bits)
    rows = np.argsort(norm, kind="stable")
    codes, norm, scalar, x64, ids = codes[rows], norm[rows].astype(np.float64), scalar[rows], x[rows].astype(np.float64), ids[rows]
    words = codes.view(np.uint64)
    error = 2 * norm * np.sqrt(np.maximum(1 - scalar.astype(np.float64) ** 2, 0)) / scalar * (sure / np.sqrt(bits - 1))
    factor = 2 * norm / (scalar * np.sqrt(bits))
    q_codes, q_norm, _ = encode(oq, bits)
    q_words, q_norm, q64 = q_codes.view(np.uint64), q_norm.astype(np.float64), qx.astype(np.float64)
    turned = oq @ rotation(x.shape[1], bits).T
    # partial sums of a query for every value of a byte
    signs = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).T
    blocks = [(s, min(n, s + _BLOCK)) for s in range(0, n, _BLOCK)]
    lows, highs = np.array([norm[s] for s, _ in blocks]), np.array([norm[e - 1] for _, e in blocks])
    dense: dict[int, np.ndarray] = {}
    # blocks of which the estimates leave much
    loose: dict[int, bool | tuple[np.ndarray, np.ndarray]] = {}
    out = []

    def keep_best(held, at, i, j, known, b):
        """The best of what is held and of the pairs (i, j), by exact distances; lowers ``known``."""
        other = qids[at[i]] != ids[j]
        i, j = i[other], j[other]
        d = exact_pairs(q64, x64, at[i], j)
        ok = d <= known[i]
        i, j, d = best(*(np.concatenate(v) for v in zip(held, (i[ok], j[ok], d[ok]))), ids, k)
        full = np.flatnonzero(np.bincount(i, minlength=b) == k)
        last = np.searchsorted(i, full, "right") - 1
        known[full] = np.minimum(known[full], d[last])
        return i, j, d

    some = min(k + 4, n)
    queries = np.argsort(q_norm, kind="stable")
    for s in range(0, len(queries), _QUERIES):
        at = queries[s : s + _QUERIES]
        b = len(at)
        nq = q_norm[at]
        known = np.full(b, limit)
        sums = (turned[at].reshape(b, bits // 8, 8) @ signs).ravel()
        held = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        middle = nq[b // 2]
        for first, block in enumerate(np.argsort(np.maximum(lows - middle, 0) + np.maximum(middle - highs, 0), kind="stable").tolist()):
            low, high = lows[block], highs[block]
            t = slice(*blocks[block])
            gap = np.maximum(np.maximum(low - nq, nq - high), 0)
            live = np.flatnonzero(gap * gap * (1 - _SLACK) - 1e-6 <= known)
            if not len(live):
                continue
            if block in loose:
                # distances in single precision, less their rounding, tell which pairs are reranked
                if not isinstance(loose[block], tuple):
                    loose[block] = o[rows[t]].T.copy(), (norm[t] ** 2 * (1 - _SLACK)).astype(np.float32)
                near = (-2 * oq[at[live]]) @ loose[block][0]
                near += loose[block][1]
                if not first and near.shape[1] > 4 * some:
                    every = max(1, near.shape[1] // max(512, 4 * some))
                    pick = t.start + every * np.argpartition(near[:, ::every], some - 1, axis=1)[:, :some]
                    d = exact_pairs(q64, x64, np.repeat(at[live], some), pick.ravel()).reshape(len(live), some)
                    known[live] = np.minimum(known[live], np.partition(d, min(k, some - 1), axis=1)[:, min(k, some - 1)])
                flat = np.flatnonzero(near <= (known[live] - nq[live] ** 2 * (1 - _SLACK) + 2e-6).astype(np.float32)[:, None])
                i, j = live[flat // near.shape[1]], t.start + flat % near.shape[1]
                held = keep_best(held, at, i, j, known, b)
                continue
            differ = _differing(q_words[at[live]], words[t])
            if not first and differ.shape[1] > 4 * some:
                # a bound on the k-th distance: exact distances of some records that look near, of which one may be the query itself
                pick = np.argpartition(differ, some - 1, axis=1)[:, :some]
                d = exact_pairs(q64, x64, np.repeat(at[live], some), t.start + pick.ravel()).reshape(len(live), some)
                known[live] = np.minimum(known[live], np.partition(d, min(k, some - 1), axis=1)[:, min(k, some - 1)])
            most = _most_bits(nq[live], low, high, known[live] * (1 + _SLACK) + 1e-6, bits)
            alike = differ <= np.minimum(most, bits).astype(differ.dtype)[:, None]
            if np.count_nonzero(alike) > _FEW * differ.size:
                # the angles tell little apart here: the same estimate and bound for all pairs, by a product
                if block not in dense:
                    unpacked = np.unpackbits(codes[t], axis=1).astype(np.float32) * 2 - 1
                    dense[block] = np.concatenate([unpacked * -factor[t, None], (norm[t] ** 2 * (1 - _SLACK))[:, None], -error[t, None]], 1).astype(np.float32).T.copy()
                left = np.concatenate([turned[at[live]], np.ones((len(live), 1)), nq[live, None]], 1).astype(np.float32)
                flat = np.flatnonzero(left @ dense[block] <= (known[live] - nq[live] ** 2 * (1 - _SLACK) + 2e-6).astype(np.float32)[:, None])
                if len(flat) > _FEW * differ.size:
                    loose[block] = True
                i, j = live[flat // differ.shape[1]], t.start + flat % differ.shape[1]
            else:
                flat = np.flatnonzero(alike)
                i, j = live[flat // differ.shape[1]], t.start + flat % differ.shape[1]
                estimate = np.zeros(len(i), np.float32)
                for byte in range(bits // 8):
                    estimate += sums[(i * (bits // 8) + byte) * 256 + codes[j, byte]]
                bound = (nq[i] ** 2 + norm[j] ** 2) * (1 - _SLACK) - estimate * factor[j] - error[j] * nq[i] - 2e-6
                i, j = i[bound <= known[i]], j[bound <= known[i]]
            held = keep_best(held, at, i, j, known, b)
        out.append((at[held[0]], rows[held[1]], held[2]))
    return tuple(np.concatenate(v) for v in zip(*out))


def best(i: np.ndarray, j: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each query by distance, then id."""
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    counts = np.bincount(i) if len(i) else np.zeros(0, int)
    top = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) < k
    return i[top], j[top], d[top]


def _first(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(ids, return_index=True)
    return ids, x[at]


class _Cell:
    """The queries of a cell, and the best that its tables have shown."""

    def __init__(self, k: int, limit: float, bits: int, sure: float):
        self.k, self.limit, self.options = k, limit, (bits, sure)
        self.home: list = []
        self.ready = None

    def add(self, is_home: bool, ids: np.ndarray, x: np.ndarray) -> None:
        if is_home:
            self.home.append((ids, x))
        elif self.home:
            self._show(ids, x)

    def _show(self, ids: np.ndarray, x: np.ndarray) -> None:
        if self.ready is None:  # the first table is searched together with the cell's own records
            self.qids, self.qx = _first(*(np.concatenate(c) for c in zip(*self.home)))
            ids, x = np.r_[self.qids, ids], np.concatenate([self.qx, x]) if len(x) else self.qx
        ids, x = _first(ids, x)
        i, j, d = nearest(self.qids, self.qx, ids, x, self.k, self.limit, *self.options)
        new = i, ids[j], d
        self.ready = new if self.ready is None else tuple(np.concatenate(v) for v in zip(self.ready, new))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.home:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if self.ready is None:
            self._show(np.zeros(0, np.int64), np.zeros((0, 1), np.float32))
        i, other, d = self.ready
        if len(i):
            i, j, d = best(i, np.arange(len(i)), d, other, self.k)
            other = other[j]
        return self.qids[i], other, d


def neighbours(records: DataFrame, id_: str = "req_id", k: int = 5, radius: float = 1.0, collection: str = "index_name", vector: str = "vector", bits: int = BITS, sure: float = SURE, sample_rows: int = 65536, split_above: int = SPLIT_ABOVE, split_to: int = 16384, probes: float | None = 0.6) -> DataFrame:
    """(id, neighbour, distance): for every usable record its ``k`` nearest
    others in the collection, none farther than ``radius``; ties go to the
    smaller id.

    Cells above ``split_above`` are searched in the share of inner cells that
    ``probes`` gives (see ``assign``); with none, in all that the radius
    reaches, which loses nothing however large the cell is.

    Of equal vectors only the ``k + 1`` of least id can be anybody's
    neighbours (``k`` of them precede all others at equal distance), so only
    those enter the cells; the others' neighbours are the first ``k`` of them.
    Rows delivered twice under one id count once; empty input gives an empty
    result.
    """
    base = records.select(F.col(id_).cast("bigint").alias("id"), F.col(collection).alias("c"), F.col(vector).alias("v"))
    # two independent hashes of 64 bits tell which vectors are equal
    same = Window.partitionBy("h", "h2").orderBy("id")
    numbered = base.withColumn("h", content_hash("c", "v")).withColumn("h2", F.xxhash64(F.lit(1), "c", "v")).withColumn("n", F.dense_rank().over(same))
    # one more than can be anybody's neighbour tells which groups have a rest
    kept = numbered.where(F.col("n") <= k + 2).withColumn("twice", F.lag("id").over(same) == F.col("id"))
    kept = materialise(kept.where(~F.coalesce("twice", F.lit(False))).drop("twice"))
    heads = kept.where(F.col("n") <= k + 1).select("id", "c", "v")
    total = kept.count()
    cells = fit_cells(heads, "id", radius, "c", "v", sample_rows, split_above=split_above, split_to=split_to, total=total, unsampled=split_above)
    options = {"probes": probes, "collection": "c", "vector": "v"}
    rounds = int(np.ceil(copies(heads, "id", cells, total, **options) / AT_ONCE))
    limit = radius * radius

    def run(batches):
        key, cell = None, None
        for (*at, is_home), table in sorted_groups(batches, 3, GUESTS):
            if at != key:
                if cell:
                    yield from results(cell)
                key, cell = at, _Cell(k, limit, bits, sure)
            cell.add(is_home, ints(table.column(3)), matrix(table.column(4)))
        if cell:
            yield from results(cell)

    def results(cell):
        q, other, d = cell.rows()
        for s in range(0, len(q), 65536):
            t = slice(s, s + 65536)
            yield pa.RecordBatch.from_arrays([pa.array(q[t]), pa.array(other[t]), pa.array(d[t])], names=["id", "neighbour", "distance"])

    schema = "id bigint, neighbour bigint, distance double"
    full = materialise(kept.where(F.col("n") == k + 2).select("h", "h2").distinct())
    ranks = kept.select("h", "h2", "n", "id").join(full, ["h", "h2"], "left_semi").distinct()
    if rounds <= 1:
        found = by_cell(assign(heads, "id", cells, **options), run, schema)
    else:
        # a record is at home in one part of one cell, so each round has all neighbours of its records
        ranks = materialise(ranks)
        routed = materialise(assign(heads, "id", cells, routed=True, **options))
        discard(kept)
        each = [materialise(by_cell(in_round(routed, rounds, r), run, schema)) for r in range(rounds)]
        discard(routed)
        found = reduce(DataFrame.unionByName, each)
    if full.isEmpty():
        return found
    # copies beyond the first k + 1
    firsts = ranks.where(F.col("n") <= k).select("h", "h2", F.col("id").alias("neighbour"))
    last = ranks.where(F.col("n") == k + 1).select("h", "h2", F.col("id").alias("last"))
    tail = base.select("id", content_hash("c", "v").alias("h"), F.xxhash64(F.lit(1), "c", "v").alias("h2")).join(last, ["h", "h2"]).where("id > last").select("id", "h", "h2").distinct()
    return found.unionByName(tail.join(firsts, ["h", "h2"]).select("id", "neighbour", F.lit(0.0).alias("distance")))


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, each once."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def missed(records: DataFrame, found: DataFrame, id_: str = "req_id", k: int = 5, radius: float = 1.0, collection: str = "index_name", vector: str = "vector", every: int = 100, block: int = 65536) -> DataFrame:
    """One row per collection: queries, true neighbours and missed ones, by
    brute force of the records whose id is divisible by ``every`` against all
    rows. Queries are broadcast in blocks of at most ``block`` rows."""
    base = records.select(F.col(id_).cast("bigint").alias("id"), F.col(collection).alias("c"), F.col(vector).alias("v"))
    asked = base.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // (block // 2)))
    truth = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).dropDuplicates(["id"]).toArrow()
        names = np.array(some.column(1).to_pylist(), object)
        queries = {name: (ints(some.column(0))[names == name], matrix(some.column(2), np.float64)[names == name]) for name in set(names)}
        shared = base.sparkSession.sparkContext.broadcast(queries)

        def run(batches, shared=shared):
            for batch in batches:
                words = np.array(batch.column(1).to_pylist(), object)
                ids, x = ints(batch.column(0)), matrix(batch.column(2), np.float64)
                for name in set(words) & set(shared.value):
                    own = words == name
                    qi, qx = shared.value[name]
                    d = squared(qx, x[own])
                    i, j = np.nonzero(d <= radius * radius + 1e-6 * (1 + (qx * qx).sum(1))[:, None])
                    other = ids[own][j]
                    d = exact_pairs(qx, x[own], i, j)
                    ok = (qi[i] != other) & (d <= radius * radius)
                    i, other, d = i[ok], other[ok], d[ok]
                    order = np.lexsort((other, d, i))
                    order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < 2 * k + 2]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(order), pa.string()), pa.array(qi[i[order]]), pa.array(other[order]), pa.array(d[order])], names=["c", "id", "neighbour", "distance"])

        part = base.mapInArrow(run, "c string, id bigint, neighbour bigint, distance double").distinct()
        truth = part if truth is None else truth.unionByName(part)
    w = Window.partitionBy("id").orderBy("distance", "neighbour")
    truth = truth.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    hit = found.select("id", "neighbour", F.lit(1).alias("hit"))
    return truth.join(hit, ["id", "neighbour"], "left").groupBy(F.col("c").alias(collection)).agg(F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("true_neighbours"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("bigint").alias("missed"))
