"""Problem 2: new batches against all history, by hashes in bucketed tables.

A vector's content hash covers its collection and components (-0.0 as 0.0).
Its paragraphs are the four quarters of the vector, turned by a fixed rotation
so that no quarter is constant in all data; a paragraph's hash is that of its
cell in a fine grid. The bucket is the hash of the collection and of a coarse
grid cell of the first paragraph's leading components, so the first
paragraph's cell determines it.

``History`` holds each record in its own bucket, with its hashes, and the
exact number of records of every bucket. A batch is appended, and then asks:

1. A new record asks for every first paragraph, with its bucket, whose cell
   the ball of the near radius around it touches. The semi-join of the stored
   table with what is asked for reads only the file buckets that are touched,
   and moves nothing but the records that it keeps.
2. Those and the new records meet in their buckets. Equal content hashes give
   the full copies. For all others the share of a stored record's paragraphs
   that a new one asks for is its coverage; near repeats have full coverage.
3. What is found is verified by its exact distance in double precision.

Above some power of two (2**20 for the radius 0.05) neighbouring float32
values are farther apart than the near radius, so near vectors have all such
components in common: these, exactly, make the bucket of a vector with any,
and its paragraphs are all alike.

Buckets above ``CHUNK`` records are cut into parts by hash on the stored side;
new records look into all parts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ints, materialise, matrix, packed, scratch, sorted_groups
from .onebit import rotation
from .vectors import exact_pairs, mixed

PARAGRAPHS = 4
#: Squared distance of near repeats.
NEAR = 0.0025
#: Components that make up the bucket, and their grid's width.
GRID, WIDTH = 6, 1.0
#: Width of the grid that paragraphs are hashed in.
FINE = 0.25
CHUNK = 32768
#: File buckets of the stored history, and records that one task writes of one.
FILES, ROWS = 16, 16384
#: Keys asked for that are broadcast; beyond, the semi-join is a shuffled one.
ASKED = 1 << 20
#: Records of a wave of batches, at least (see ``replay``).
WAVE = 32768

STORED = "bucket bigint, key bigint, base bigint, id bigint, content bigint, paragraphs array<bigint>, vec binary"
_PAIR = "id_a bigint, id_b bigint, distance double, full_copy boolean"
HASHED = "bucket bigint, part int, side int, id bigint, content bigint, paragraphs array<bigint>, vec binary"


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed((h ^ (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64))


def _buckets(h: np.ndarray, cells: np.ndarray) -> np.ndarray:
    for j in range(cells.shape[1]):
        h = _mix(h, cells[:, j])
    return h


def _probes(h: np.ndarray, y: np.ndarray, radius: float, width: float, with_cells: bool = False) -> tuple[np.ndarray, ...]:
    """(row, bucket) of all grid cells that the ball around a row touches, on
    request with the cells."""
    row, cost = np.arange(len(y)), np.zeros(len(y))
    cells = np.zeros((len(y), 0), np.int64)
    limit = radius * radius * (1 + 1e-6) + 1e-12
    for j in range(y.shape[1]):
        u = y[row, j] / width
        cell = np.floor(u)
        rows, costs, hashes, own = [], [], [], []
        blur = 1e-6  # more than the rounding of the rotation
        for step, gap in ((0, np.zeros(len(u))), (-1, np.maximum(u - cell - blur, 0)), (1, np.maximum(1 - u + cell - blur, 0))):
            c = cost + (gap * width) ** 2
            t = np.flatnonzero(c <= limit)
            at = cell[t].astype(np.int64) + step
            rows.append(row[t]), costs.append(c[t]), hashes.append(_mix(h[t], at))
            if with_cells:
                own.append(np.column_stack([cells[t], at]))
        row, cost, h = np.concatenate(rows), np.concatenate(costs), np.concatenate(hashes)
        if with_cells:
            cells = np.concatenate(own)
    return (row, h, cells) if with_cells else (row, h)


def _large(x: np.ndarray, radius: float) -> np.ndarray:
    return np.abs(x) >= 2.0 ** (np.floor(np.log2(radius * 2**24)) + 1)


def _quarters(dim: int) -> list[slice]:
    width = dim // PARAGRAPHS
    return [slice(k * width, dim if k == PARAGRAPHS - 1 else (k + 1) * width) for k in range(PARAGRAPHS)]


def paragraphs(x: np.ndarray, radius: float) -> np.ndarray:
    """Hashes of the paragraphs, one column for each."""
    out = np.zeros((len(x), PARAGRAPHS), np.int64)
    plain = np.flatnonzero(~_large(x, radius).any(1))
    y = np.floor(_turned(x[plain]) / FINE).astype(np.int64)
    for p, part in enumerate(_quarters(x.shape[1])):
        out[plain, p] = _buckets(np.full(len(plain), p, np.uint64), y[:, part]).view(np.int64)
    return out


def asked(x: np.ndarray, radius: float, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): every hash that paragraph ``p`` of a near vector can have."""
    large = _large(x, radius).any(1)
    plain = np.flatnonzero(~large)
    row, h = _probes(np.full(len(plain), p, np.uint64), _turned(x[plain])[:, _quarters(x.shape[1])[p]], radius, FINE)
    out = np.flatnonzero(large)
    return np.r_[plain[row], out], np.r_[h.view(np.int64), np.zeros(len(out), np.int64)]


def _exact_bucket(start: np.ndarray, x: np.ndarray, large: np.ndarray) -> np.ndarray:
    bits = np.where(large, x, np.float32(0)).astype(np.float32).view(np.int32).astype(np.int64)
    return _buckets(start ^ np.uint64(1), bits)


def _homes(start: np.ndarray, x: np.ndarray, radius: float) -> np.ndarray:
    """Each row's own bucket."""
    large = _large(x, radius)
    out = large.any(1)
    h = np.empty(len(x), np.uint64)
    h[~out] = _buckets(start[~out], np.floor(_turned(x[~out])[:, :GRID] / WIDTH).astype(np.int64))
    h[out] = _exact_bucket(start[out], x[out], large[out])
    return h


def _touched(start: np.ndarray, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): every bucket that a near vector of a row can have."""
    large = _large(x, radius)
    out, plain = np.flatnonzero(large.any(1)), np.flatnonzero(~large.any(1))
    row, h = _probes(start[plain], _turned(x[plain])[:, :GRID], radius, WIDTH)
    return np.r_[plain[row], out], np.r_[h, _exact_bucket(start[out], x[out], large[out])]


def _openings(start: np.ndarray, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key) of every first paragraph that a near vector can have. The
    fine grid divides the coarse one, so a fine cell lies in one bucket."""
    large = _large(x, radius)
    out, plain = np.flatnonzero(large.any(1)), np.flatnonzero(~large.any(1))
    y = _turned(x[plain])[:, _quarters(x.shape[1])[0]]
    row, h, cells = _probes(np.zeros(len(plain), np.uint64), y, radius, FINE, True)
    bucket = _buckets(start[plain][row], cells[:, :GRID] // int(WIDTH / FINE))
    far = _exact_bucket(start[out], x[out], large[out])
    bucket, h = np.r_[bucket, far], np.r_[h, np.zeros(len(far), np.uint64)]
    return bucket, _mix(bucket, h.view(np.int64))


def _turned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float64) @ rotation(x.shape[1], x.shape[1]).astype(np.float64).T


def hashed(records: DataFrame, radius: float) -> DataFrame:
    """The stored table's rows of ``records`` (id, collection, vector)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                base, x = ints(batch.column(1)), matrix(batch.column(3))
                bucket = _homes(base.view(np.uint64), x, radius)
                hashes = paragraphs(x, radius)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(_mix(bucket, hashes[:, 0]).view(np.int64)), batch.column(1), batch.column(0), batch.column(2), _lists(hashes), packed(x)], names=["bucket", "key", "base", "id", "content", "paragraphs", "vec"])

    rows = records.select(F.col("id").cast("bigint"), F.xxhash64("collection").alias("b"), F.xxhash64("collection", "vector").alias("h"), "vector")
    return rows.mapInArrow(run, STORED)


def _asking(stored: DataFrame, radius: float) -> DataFrame:
    """Rows of side 1 of stored records, in all buckets that they touch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, base, content, x = ints(batch.column(0)), ints(batch.column(1)), ints(batch.column(2)), matrix(batch.column(3))
                row, bucket = _touched(base.view(np.uint64), x, radius)
                for s in range(0, len(row), 16384):
                    r = row[s : s + 16384]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[s : s + 16384].view(np.int64)), pa.array(np.zeros(len(r), np.int32)), pa.array(np.ones(len(r), np.int32)), pa.array(ids[r]), pa.array(content[r]), pa.array([None] * len(r), pa.list_(pa.int64())), packed(x[r])], names=["bucket", "part", "side", "id", "content", "paragraphs", "vec"])

    return stored.select("id", "base", "content", "vec").mapInArrow(run, HASHED)


def _keys(stored: DataFrame, radius: float) -> DataFrame:
    """(bucket, key), each once, that stored records ask for."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bucket, key = _openings(ints(batch.column(0)).view(np.uint64), matrix(batch.column(1)), radius)
                key, at = np.unique(key, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at].view(np.int64)), pa.array(key.view(np.int64))], names=["bucket", "key"])

    return stored.select("base", "vec").mapInArrow(run, "bucket bigint, key bigint").distinct()


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def calls(x: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """``asked`` for every paragraph, sorted by row."""
    out = []
    for p in range(PARAGRAPHS):
        row, h = asked(x, radius, p)
        order = np.argsort(row, kind="stable")
        out.append((row[order], h[order]))
    return out


def copies(ids, content, x, ids2, content2, x2, near: float, at_once: int = 1 << 20):
    """(row of the new, row of the old, distance, full copy) of the pairs with
    equal content hashes, old ones of smaller id; the exact distance tells
    whether they are copies."""
    order = np.argsort(content2, kind="stable")
    low = np.searchsorted(content2[order], content, "left")
    many = np.searchsorted(content2[order], content, "right") - low
    total = np.cumsum(many)
    begin = 0
    while begin < len(many):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, "right")))
        n = many[begin:end]
        i = np.repeat(np.arange(begin, begin + len(n)), n)
        j = order[low[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        ok = ids2[j] < ids[i]
        i, j = i[ok], j[ok]
        d = exact_pairs(x, x2, i, j)
        ok = d <= near
        yield i[ok], j[ok], d[ok], d[ok] == 0
        begin = end


def compare(first: int, called: list, ids, content, x, ids2, content2, hashes2, x2, near: float):
    """(row of the new, row of the old, distance, full copy) within a bucket:
    old rows of smaller id at most ``near`` apart. ``called`` holds the hashes
    that the new rows ask for, numbered from ``first``."""
    yield from copies(ids, content, x, ids2, content2, x2, near)
    known = [np.unique(hashes2[:, p], return_inverse=True) for p in range(PARAGRAPHS)]
    # the most selective paragraph opens, the others are asked for what is left
    order = sorted(range(PARAGRAPHS), key=lambda p: -len(known[p][0]))
    step = max(16, (1 << 20) // max(1, len(x2)))
    for s in range(0, len(x), step):
        b = min(step, len(x) - s)
        # which of the old paragraphs' hashes each new row asks for
        wanted = []
        for (have, _), (row, h) in zip(known, called):
            t = slice(*np.searchsorted(row, (first + s, first + s + b)))
            at = np.minimum(np.searchsorted(have, h[t]), len(have) - 1)
            ok = have[at] == h[t]
            w = np.zeros((b, len(have)), bool)
            w[row[t][ok] - first - s, at[ok]] = True
            wanted.append(w)
        at = np.flatnonzero(wanted[order[0]][:, known[order[0]][1]])
        i, j = at // len(x2), at % len(x2)
        covered = (ids2[j] < ids[s + i]) & (content2[j] != content[s + i])
        for p in order[1:]:
            i, j = i[covered], j[covered]
            covered = wanted[p][i, known[p][1][j]]
        i, j = i[covered], j[covered]
        d = exact_pairs(x, x2, s + i, j)
        ok = d <= near
        yield s + i[ok], j[ok], d[ok], np.zeros(int(ok.sum()), bool)


def repeats(table: DataFrame, near: float = NEAR) -> DataFrame:
    """The bucket-local join of a bucketed table's sides: (id_a, id_b,
    distance, full_copy), id_a of side 0, id_b of side 1, id_a < id_b."""
    radius = float(np.sqrt(near))

    def settle(held):
        """Buckets side by side: one call for all their new rows' hashes."""
        called = calls(np.concatenate([g[2] for g in held]), radius)
        first = 0
        for ids, content, x, *old in held:
            yield from ((ids[i], old[0][j], d, copy) for i, j, d, copy in compare(first, called, ids, content, x, *old, near))
            first += len(x)

    def waves(batches):
        held, n, size = [], 0, 0
        for _, rows in sorted_groups(batches, 2):
            side = ints(rows.column(2))
            new, old = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            if not len(new) or not len(old):
                continue
            ids, content, x = ints(rows.column(3)), ints(rows.column(4)), matrix(rows.column(6))
            hashes = matrix(rows.column(5).take(pa.array(old)), np.int64)
            for s in range(0, len(new), 8192):
                t = new[s : s + 8192]
                held.append((ids[t], content[t], x[t], ids[old], content[old], hashes, x[old]))
                n, size = n + len(t), size + len(old)
                if n >= 8192 or size >= 4 * CHUNK:
                    yield from settle(held)
                    held, n, size = [], 0, 0
        if held:
            yield from settle(held)

    def run(batches):
        for new, old, d, copy in waves(batches):
            for s in range(0, len(new), 65536):
                t = slice(s, s + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(old[t]), pa.array(new[t]), pa.array(d[t]), pa.array(copy[t])], names=["id_a", "id_b", "distance", "full_copy"])

    return table.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(run, _PAIR)


class History:
    """The accepted records as a bucketed table in ``path``: a folder for each
    batch number, and in it one for each file bucket, sorted by bucket; beside
    it the number of records of each bucket. A batch reads only the file
    buckets that its records touch; what was accepted before is never written
    again. A batch number that comes again replaces itself, so a replay
    reports the same repeats and adds nothing.

    Batch numbers rise with the ids: a record's repeats are looked for among
    the records of its own and of earlier batches. A record delivered twice is
    stored as often, and counts once in every result.
    """

    def __init__(self, spark: SparkSession, path: str, near: float = NEAR, chunk: int | None = None):
        self.spark, self.path, self.near = spark, path, near
        self.chunk = chunk or CHUNK
        self.radius = float(np.sqrt(near))

    @staticmethod
    def _file():
        return F.pmod(F.hash("bucket"), F.lit(FILES)).cast("int")

    def _read(self, kind: str, schema: str, upto: int | None = None, only: int | None = None) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(f"{schema}, batch bigint")
        if only is not None:
            return rows.parquet(f"{self.path}/{kind}/batch={only}")
        return rows.parquet(f"{self.path}/{kind}").where(F.col("batch") <= upto)

    def accept(self, batch: DataFrame, number: int, rows: int | None = None) -> DataFrame:
        """Append the records (id, collection, vector) as batch ``number``;
        returns them as stored. ``rows`` is about their number, if known."""
        rows = batch.count() if rows is None else rows
        spread = max(1, -(-rows // (FILES * ROWS)))
        own = hashed(batch.select("id", "collection", "vector"), self.radius).withColumn("file", self._file())
        # the salt keeps a file bucket, and a hot bucket in it, out of a single task
        own = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(spread))).repartition("file", "salt").drop("salt")
        own.sortWithinPartitions("file", "bucket").write.option("compression", "zstd").mode("overwrite").partitionBy("file").parquet(f"{self.path}/rows/batch={number}")
        stored = self._read("rows", f"{STORED}, file int", only=number)
        stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
        return stored

    def parts(self, number: int) -> DataFrame:
        """(bucket, many): buckets with more than ``chunk`` records up to a batch."""
        counts = self._read("counts", "bucket bigint, n bigint", number).groupBy("bucket").agg(F.sum("n").alias("n"))
        return counts.where(F.col("n") > self.chunk).select("bucket", F.ceil(F.col("n") / self.chunk).alias("many"))

    def check(self, batch: DataFrame, number: int, rows: int | None = None) -> DataFrame:
        """Append the batch; (id_a, id_b, distance, full_copy) of its records
        against those of smaller id in it and in earlier batches."""
        mine = self.accept(batch, number, rows)
        asked = materialise(_keys(mine, self.radius))
        files = {r.file: r.n for r in asked.groupBy(self._file().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()}
        stored = self._read("rows", f"{STORED}, file int", number).where(F.col("file").isin(list(files)))
        asked = asked.select("bucket", "key")
        met = stored.join(F.broadcast(asked) if sum(files.values()) <= ASKED else asked, ["bucket", "key"], "left_semi")
        met = met.select("bucket", F.lit(0).alias("part"), F.lit(0).alias("side"), "id", "content", "paragraphs", "vec")
        new = _asking(mine, self.radius)
        parts = self.parts(number)
        few = parts.limit(100_001).collect()
        if few:
            if len(few) <= 100_000:
                parts = F.broadcast(self.spark.createDataFrame(few, "bucket bigint, many bigint"))
            columns = new.columns
            met = met.join(parts, "bucket", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("many")), F.lit(0)).cast("int")).select(columns)
            new = new.join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), (F.coalesce("many", F.lit(1)) - 1).cast("int")))).select(columns)
        return materialise(repeats(met.unionByName(new), self.near).dropDuplicates(["id_a", "id_b"]))


def near_repeats(history: DataFrame, new: DataFrame, near: float = NEAR, chunk: int | None = None, total: int | None = None) -> DataFrame:
    """(id_a, id_b, distance, full_copy): every new record id_b with each record of
    smaller id, in the history or among the new ones, at most ``near`` apart in
    squared distance within its collection. Inputs: (id, collection, vector),
    usable vectors only. A record delivered twice counts once; an empty side
    gives no pairs with it. ``total`` is about the number of records in the
    history, if known."""
    h = History(history.sparkSession, scratch(history.sparkSession, "history"), near, chunk)
    h.accept(history, 0, total)
    return h.check(new, 1)


def replay(history: DataFrame, batches: DataFrame, near: float = NEAR, chunk: int | None = None, total: int | None = None, wave: int = WAVE) -> DataFrame:
    """``near_repeats`` for batches (batch, id, collection, vector) in the
    order of their numbers, in waves: each wave is checked against the stored
    history and the waves before it, and appended.

    A wave is what has arrived since the last check. It has about ``wave``
    records, or an eighth of the history if that is more, so that a replay of
    as many records as the history has reads it no more than a few times; the
    arrivals make two waves at least. A null number comes first. The result
    doesn't depend on where waves begin."""
    spark = history.sparkSession
    total = history.count() if total is None else total
    rows = batches.withColumn("batch", F.coalesce(F.col("batch").cast("bigint"), F.lit(-(1 << 62)).cast("bigint")))
    fine = 64
    n, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx("batch", [k / fine for k in range(fine)], 10_000)).first()
    waves = max(2, -(-n // max(wave, total // 8)))
    if waves > fine:
        cuts = rows.select(F.percentile_approx("batch", [k / waves for k in range(waves)], 100 * waves)).first()[0]
    cuts = [cuts[k * len(cuts) // waves] for k in range(1, waves)] if n else []
    # arrivals by wave, so that a wave reads only its own
    number = sum(((F.col("batch") > c).cast("int") for c in sorted(set(cuts))), F.lit(1))
    inbox = scratch(spark, "inbox")
    rows.select("id", "collection", "vector", number.alias("wave")).write.option("compression", "zstd").partitionBy("wave").parquet(inbox)
    arrived = spark.read.schema(rows.select("id", "collection", "vector").schema.add("wave", "integer")).parquet(inbox)
    h = History(spark, scratch(spark, "history"), near, chunk)
    h.accept(history, 0, total)
    return reduce(DataFrame.unionByName, [h.check(arrived.where(F.col("wave") == k), k, n // waves) for k in range(1, len(set(cuts)) + 2)])
