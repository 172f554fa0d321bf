"""What the vector operators share: usable records, and cells.

Cells divide each collection for a similarity radius ``r`` so that no pair
within ``r`` is lost. Landmarks at mutual distance of at least ``3 r`` are
fitted on a bounded sample; each record's home is the cell of its nearest
landmark, and it is also a guest in every cell whose half-space it comes as
near as ``r`` to. If x is at home in c and y within r of x, then y's distance
from the hyperplane that separates c from y's home is at most r, so y is at
home or a guest in c.

A record far from every landmark is near many hyperplanes and would be copied
into many cells. So where a sample misses clusters, a cell ends at ``3 r`` from
its landmark: records beyond, and with them as guests those beyond ``2 r``, go to
a next level, whose landmarks are fitted on what is beyond. If x is at home in c,
y lies within 4 r of c; if x is beyond 3 r of all landmarks, y is beyond 2 r.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ints, matrix, packed

DIM = 32
LARGEST = 1e16
#: A collection estimated below this many records is one cell.
SINGLE = 4096
#: Levels are added up to so many landmarks.
LANDMARKS = 65536
#: Hashes of ids that a sample is taken from.
SCALE = 1 << 30
#: Up to so many rows the sample has rows of every collection that is too large for a task.
CERTAIN = 1 << 26


def usable(df: DataFrame, dim: int = DIM, vector: str = "vector", collection: str = "index_name") -> DataFrame:
    """Rows with a collection and a vector of ``dim`` finite components of
    absolute value up to 1e16. A null or NaN component fails the comparison
    (Spark orders NaN above every number)."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) <= F.lit(LARGEST)))
    return df.where(F.col(collection).isNotNull() & (F.size(vector) == dim) & ok)


def content_hash(collection: str = "index_name", vector: str = "vector") -> Column:
    """Hash of collection and components; -0.0 and 0.0 hash alike."""
    return F.xxhash64(F.col(collection), F.col(vector))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances by matrix product, in the arrays' precision."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)


def exact_pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (a[i], b[j]) by differences, in double."""
    out = np.empty(len(i))
    for s in range(0, len(i), 8192):  # small enough for a core's cache
        d = a[i[s : s + 8192]].astype(np.float64) - b[j[s : s + 8192]]
        out[s : s + 8192] = np.einsum("ij,ij->i", d, d)
    return out


def within(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which pairs have a squared distance up to ``limit``; entries too near
    the limit for the matrix product's rounding are computed again exactly."""
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    d = sa[:, None] + sb[None] - 2 * (a @ b.T)
    d -= limit
    near = np.abs(d) <= 1e-12 * (sa[:, None] + sb[None]) + 1e-11
    out = d <= 0
    if near.any():
        i, j = np.nonzero(near)
        out[i, j] = exact_pairs(a, b, i, j) <= limit
    return out


def mixed(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random order of ids (64-bit finaliser)."""
    h = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


@dataclass
class Cells:
    """Landmarks of all collections. ``first[name]`` and ``last[name]`` bound
    a collection's rows of ``centers``; ``rows`` estimates each cell's size.
    ``inner[c]`` holds the centers of a cell that is split further. ``deeper[name]``
    bounds the landmarks of the next levels; all cells but the last level's end."""

    radius: float
    first: dict[str, int] = field(default_factory=dict)
    last: dict[str, int] = field(default_factory=dict)
    centers: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM)))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0))
    inner: dict[int, np.ndarray] = field(default_factory=dict)
    deeper: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    def levels(self, name: str) -> list[tuple[int, int]]:
        return [(self.first[name], self.last[name]), *self.deeper.get(name, [])]


def _leaders(x: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Greedy net in the given order: rows at mutual distance > ``apart``."""
    kept: list[int] = []
    open_ = np.arange(len(x))
    while len(open_) and len(kept) < most:
        p = open_[0]
        kept.append(p)
        d = x[open_] - x[p]
        open_ = open_[np.einsum("ij,ij->i", d, d) > apart * apart]
    return np.array(kept, int)


def fit_cells(df: DataFrame, id_: str, radius: float, collection: str = "index_name", vector: str = "vector", sample_rows: int = 65536, most: int = 1024, split_above: int = 0, split_to: int = 16384, total: int | None = None, unsampled: int = 0) -> Cells:
    """Fit the landmarks.

    ``sample_rows`` bounds the sample over all collections (by id hash, so it
    is the same on each run), ``most`` the landmarks of a collection: the
    landmarks, which are broadcast, stay below ``sample_rows`` rows, and with
    further levels below ``LANDMARKS``, whatever the data's size. Every record is later assigned, sampled or not. With
    ``split_above``, cells estimated to hold more rows get centers inside, one
    per ``split_to`` rows (1024 at most). ``total``, if known, is about the
    number of rows; it saves a count. In tables above ``CERTAIN`` rows the
    collections that got no landmark and have more than ``unsampled`` rows are
    counted and sampled by themselves, until each has some. Records that no
    landmark is near to are sampled by themselves, level after level.
    """
    total = df.count() if total is None else total
    out = Cells(radius)
    if not total:
        return out
    left = _fit(out, df, id_, collection, vector, sample_rows, most, split_above, split_to, total)
    rest = df
    while unsampled and total > CERTAIN:
        counts = rest.groupBy(collection).count().where(F.col("count") > max(unsampled, SINGLE)).collect()
        counts = {r[0]: r[1] for r in counts if r[0] not in out.first}
        known = len(out.first)
        if counts:
            rest = df.join(F.broadcast(df.sparkSession.createDataFrame([(name,) for name in counts], f"`{collection}` string")), collection)
            left |= _fit(out, rest, id_, collection, vector, sample_rows, most, split_above, split_to, sum(counts.values()))
        if len(out.first) == known:
            break
    _deepen(out, df, id_, collection, vector, sample_rows, most, split_above, split_to, left)
    return out


def _sampled(df: DataFrame, id_: str, salt: int, keep: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(F.col(id_), F.lit(salt)), F.lit(SCALE)) < keep)


def _by_name(table: pa.Table) -> dict[str, tuple[np.ndarray, ...]]:
    """Points of moderate size by collection, each id once, in hash order, and the other columns."""
    names = np.array(table.column(0).to_pylist(), object)
    ids, x, *rest = ints(table.column(1)), matrix(table.column(2), np.float64), *map(ints, table.columns[3:])
    out = {}
    for name in sorted(set(names)):
        own = np.flatnonzero(names == name)
        _, at = np.unique(ids[own], return_index=True)
        own = own[at[np.argsort(mixed(ids[own[at]]), kind="stable")]]
        own = own[np.abs(x[own]).max(1) < 1e6]
        out[name] = (x[own], *(c[own] for c in rest))
    return out


def _fit(out: Cells, df: DataFrame, id_: str, collection: str, vector: str, sample_rows: int, most: int, split_above: int, split_to: int, total: int) -> dict[str, tuple[float, float]]:
    """Add the landmarks of the collections that a sample of ``df`` shows;
    for each about how many rows it has, and how many of them are near to none."""
    keep = min(SCALE, int(SCALE * sample_rows / total) + 1)
    table = _sampled(df, id_, 17, keep).select(collection, id_, vector).toArrow()
    left = {}
    for name, (points,) in _by_name(table).items():
        # any landmarks keep the cells lossless, so few sampled rows are enough for a large collection
        if name in out.first or len(points) * (SCALE / keep) < SINGLE or len(points) < 2:
            continue
        out.first[name] = len(out.centers)
        far = _add(out, points, SCALE / keep, most, split_above, split_to, keep < SCALE)
        out.last[name] = len(out.centers)
        left[name] = len(points) * SCALE / keep, far
    return left


def _deepen(out: Cells, df: DataFrame, id_: str, collection: str, vector: str, sample_rows: int, most: int, split_above: int, split_to: int, left: dict[str, tuple[float, float]]) -> None:
    """Add levels for what is beyond the reach of all landmarks, where that is
    more than what lies on their border and than a task's worth; a level that
    would leave as much beyond it as the one before is the last."""
    limit = (3 * out.radius) ** 2
    border = (2 * out.radius) ** 2
    for level in range(1, 9):
        left = {name: v for name, v in left.items() if v[1] >= SINGLE}
        room = (LANDMARKS - len(out.centers)) // max(1, len(left))
        if not left or room < 2:
            return
        rate = min(1, sample_rows / sum(max(far, rows / 64) for rows, far in left.values()))
        keep = min(SCALE, int(SCALE * rate) + 1)
        shared = df.sparkSession.sparkContext.broadcast((out, set(left)))

        def beyond(batches, shared=shared):
            cells, wanted = shared.value
            for b in batches:
                words, x = np.array(b.column(0).to_pylist(), object), matrix(b.column(2))
                near = np.full(b.num_rows, -1.0)
                for word in set(words) & wanted:
                    at = np.flatnonzero(words == word)
                    lo_hi = cells.levels(word)
                    for s in range(0, len(at), 4096):
                        p = x[at[s : s + 4096]].astype(np.float64)
                        near[at[s : s + 4096]] = np.min([squared(p, cells.centers[lo:hi]).min(1) for lo, hi in lo_hi], axis=0)
                keep = pa.array(near > border)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near > limit)], names=["c", "i", "v", "far"]).filter(keep)

        rows = _sampled(df, id_, 17 + level, keep).select(F.col(collection).alias("c"), F.col(id_).cast("bigint").alias("i"), F.col(vector).cast("array<float>").alias("v"))
        found = _by_name(rows.mapInArrow(beyond, "c string, i bigint, v array<float>, far boolean").toArrow())
        shared.unpersist()
        after = {}
        for name, (points, far) in found.items():
            far = far.astype(bool)
            n = far.sum()
            if n < 2 or n * SCALE / keep < SINGLE or 2 * n < len(far) or n * SCALE / keep > 0.9 * left[name][0]:
                continue
            start = len(out.centers)
            beyond_it = _add(out, points[far], SCALE / keep, min(most, room), split_above, split_to, keep < SCALE)
            out.deeper.setdefault(name, []).append((start, len(out.centers)))
            after[name] = n * SCALE / keep, beyond_it
        left = after


def _add(out: Cells, points: np.ndarray, each: float, most: int, split_above: int, split_to: int, part: bool) -> float:
    """Add landmarks for sampled points that stand for ``each`` rows; about how
    many rows are near to none of them. In a sample that is a ``part`` of the
    rows, points alone with their landmark tell how many others it misses."""
    apart = 3 * out.radius
    c = points[_leaders(points, apart, most)]
    for _ in range(2):  # move to the middle of the own points, then drop what came too near a heavier one
        d = squared(points, c)
        near = d.argmin(1)
        near[d[np.arange(len(points)), near] > apart * apart] = len(c)
        weight = np.bincount(near, minlength=len(c) + 1)[:-1]
        sums = np.zeros((len(c) + 1, points.shape[1]))
        np.add.at(sums, near, points)
        c = np.where(weight[:, None] > 0, sums[:-1] / np.maximum(weight, 1)[:, None], c)
        c = c[np.argsort(-weight, kind="stable")]
        c = c[_leaders(c, apart, most)]
    d = squared(points, c)
    near = d.argmin(1)
    start = len(out.centers)
    size = np.bincount(near, minlength=len(c)) * each
    for k in np.flatnonzero(size > split_above) if split_above else ():
        inside = points[near == k]
        seeds = inside[: int(min(1024, len(inside), -(-size[k] // split_to)))]
        for _ in range(4):
            at = squared(inside, seeds).argmin(1)
            sums = np.zeros_like(seeds)
            np.add.at(sums, at, inside)
            n = np.bincount(at, minlength=len(seeds))
            seeds = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], seeds)
        out.inner[start + int(k)] = seeds
    out.centers = np.concatenate([out.centers.reshape(-1, points.shape[1]), c])
    out.rows = np.concatenate([out.rows, size])
    beyond = (d.min(1) > apart * apart).sum()
    return each * (beyond + (np.bincount(near, minlength=len(c)) == 1).sum() * part)


ASSIGNED = "cell bigint, part int, home boolean, id bigint, vec binary"
#: The same with one row per record; ``in_round`` makes rows of it.
ROUTED = "id bigint, vec binary, members array<struct<cell: bigint, part: int, home: boolean>>"


def assign(df: DataFrame, id_: str, cells: Cells, chunk: int = 0, probes: float | None = 0.6, collection: str = "index_name", vector: str = "vector", guests: bool = True, routed: bool = False) -> DataFrame:
    """One row per record and cell that it belongs to (see the module); without
    ``guests`` only the row at home. ``routed``: one row per record, with the
    cells as an array.

    A collection without landmarks is one cell, numbered below zero. ``part``
    divides what would be too large for a task:

    * cells split inside (``Cells.inner``): part is the inner center; a record
      is at home with its nearest of the m centers and a guest with the
      ``probes`` m (16 / m)^0.25 nearest, all of them while m is small; without
      ``probes`` with all whose half-space it comes as near as ``r`` to;
    * with ``chunk``, a cell estimated above that many rows is cut into parts
      by hash of the id, each record in one of them.
    """
    shared = df.sparkSession.sparkContext.broadcast(cells)
    alone = -1 - F.shiftrightunsigned(F.xxhash64(collection), 1)

    def divided(ids, rows, p, slack, i, cell, is_home):
        """(row, cell, part, home) of members in rows[i]."""
        c = shared.value
        r = c.radius
        part = np.zeros(len(i), np.int32)
        if chunk:
            parts = np.maximum(1, np.ceil(c.rows[cell] / chunk)).astype(np.int64)
            part = (mixed(ids[rows[i]]) % parts.astype(np.uint64)).astype(np.int32)
        elif c.inner:
            extra = [(rows[i], cell, part, is_home)]
            for big in np.intersect1d(np.unique(cell), list(c.inner)):
                t = np.flatnonzero(cell == big)
                seeds = c.inner[int(big)]
                di = squared(p[i[t]], seeds)
                if probes is None:
                    first = di.argmin(1)
                    apart = np.sqrt(squared(seeds, seeds))[first]
                    k, near = np.nonzero(di - di.min(1)[:, None] <= 2 * r * apart + slack[i[t]][:, None])
                    extra.append((rows[i[t]][k], np.full(len(k), big), near.astype(np.int32), is_home[t][k] & (near == first[k])))
                    continue
                n = min(len(seeds), int(np.ceil(probes * len(seeds) * (16 / len(seeds)) ** 0.25)))
                order = np.argpartition(di, n - 1, axis=1)[:, :n] if n < len(seeds) else np.broadcast_to(np.arange(n), di.shape)
                first = di.argmin(1)
                extra.append((np.repeat(rows[i[t]], n), np.full(len(t) * n, big), order.ravel().astype(np.int32), (np.repeat(is_home[t], n)) & (order.ravel() == np.repeat(first, n))))
            keep = ~np.isin(cell, list(c.inner))
            extra[0] = tuple(v[keep] for v in extra[0])
            return extra
        return [(rows[i], cell, part, is_home)]

    def run(batches):
        c = shared.value
        r = c.radius
        for batch in batches:
            name = batch.column(0).dictionary_encode()
            codes, words = ints(name.indices), name.dictionary.to_pylist()
            other, ids, x = ints(batch.column(1)), ints(batch.column(2)), matrix(batch.column(3))
            got = []  # (row, cell, part, home)
            for code, word in enumerate(words):
                at = np.flatnonzero(codes == code)
                if word not in c.first:
                    got.append((at, other[at], np.zeros(len(at), np.int32), np.ones(len(at), bool)))
                    continue
                levels = c.levels(word)
                for s in range(0, len(at), 4096):
                    rows = at[s : s + 4096]
                    open_ = np.ones(len(rows), bool)  # not at home on a level before
                    for level, (lo, hi) in enumerate(levels):
                        p, m = x[rows].astype(np.float64), c.centers[lo:hi]
                        d = squared(p, m)
                        home = d.argmin(1)
                        best = d[np.arange(len(rows)), home]
                        used, back = np.unique(home, return_inverse=True)
                        gap = np.sqrt(squared(m[used], m))[back]
                        slack = 1e-9 * (1 + (p * p).sum(1))
                        member = d - best[:, None] <= 2 * r * gap + slack[:, None]
                        stays = open_.copy()
                        if level + 1 < len(levels):
                            member &= d <= 16 * r * r + slack[:, None]
                            stays &= best <= 9 * r * r
                        i, j = np.nonzero(member) if guests else (np.flatnonzero(stays), home[stays])
                        got += divided(ids, rows, p, slack, i, j + lo, (j == home[i]) & stays[i])
                        if level + 1 < len(levels):
                            open_ &= ~stays
                            further = best > 4 * r * r - slack if guests else open_
                            rows, open_ = rows[further], open_[further]
                            if not len(rows):
                                break
            if not got:
                continue
            row, cell, part, home = (np.concatenate([g[k] for g in got]) for k in range(4))
            if routed:
                order = np.argsort(row, kind="stable")
                ends = np.cumsum(np.bincount(row, minlength=len(ids)))
                members = pa.StructArray.from_arrays([pa.array(cell[order].astype(np.int64)), pa.array(part[order].astype(np.int32)), pa.array(home[order])], names=["cell", "part", "home"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), members)
                yield pa.RecordBatch.from_arrays([pa.array(ids), packed(x), lists], names=["id", "vec", "members"])
                continue
            for s in range(0, len(row), 16384):
                t = slice(s, s + 16384)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[t].astype(np.int64)), pa.array(part[t].astype(np.int32)), pa.array(home[t]), pa.array(ids[row[t]]), packed(x[row[t]])],
                    names=["cell", "part", "home", "id", "vec"],
                )

    return df.select(F.col(collection).alias("c"), alone.cast("bigint").alias("o"), F.col(id_).cast("bigint").alias("i"), F.col(vector).alias("v")).mapInArrow(run, ROUTED if routed else ASSIGNED)


def copies(df: DataFrame, id_: str, cells: Cells, total: int, rows: int = 16384, **options) -> float:
    """About how many rows ``assign`` makes of a record, by a sample of ``rows`` records."""
    some = assign(_sampled(df, id_, 31, min(SCALE, int(SCALE * rows / max(1, total)) + 1)), id_, cells, **options)
    n, at_home = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("home").cast("bigint")), F.lit(0))).first()
    return n / max(1, at_home)


def in_round(routed: DataFrame, rounds: int, number: int) -> DataFrame:
    """The rows, as ``assign`` gives them, of the cells and parts that a hash puts into this round."""
    own = f"inline(filter(members, m -> pmod(xxhash64(m.cell, m.part), {rounds}) = {number}))"
    return routed.select(F.expr(own), "id", "vec")


def by_cell(assigned: DataFrame, run, schema: str) -> DataFrame:
    """Run ``run(batches)`` over partitions sorted by cell and part, the
    records at home first."""
    return assigned.repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("home")).mapInArrow(run, schema)
