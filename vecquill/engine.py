"""A vector index: main and delta segments with tombstones, on one path.

Every change is one commit of the ``plans.store``. An insert adds a folder to
the delta and never rewrites data; compaction folds everything into a new
main. Rows carry the commit that wrote them and a position, which break ties
of distance, and a tombstone kills only rows of earlier commits.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.checks import ROWS, bad_reason, check_vector, repeated_ids
from .operators import ann
from .operators.knn import knn_carrying, nearest_one
from .plans.store import Conflict, Manifest, Store

SEGMENT = "external_id string, vec array<float>, seq bigint, pos bigint, cell int"
DEAD = "external_id string, seq bigint"
#: Bytes of a file that compaction writes.
FILE = 128 << 20


@dataclass
class Params:
    """Graph parameters are kept for callers that set them; search is exact
    and does not depend on them."""

    M: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    rng_seed: int = 0


class VectorEngine:
    """Rows of (external id, vector) under one path, searched by squared L2.

    Row calls (``init``, ``ingest``, ``finalize``) buffer on the driver;
    ``write`` takes a DataFrame and is the way for large data. ``search``
    answers one query, ``search_batch`` many.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int = 0, delta_ratio: float = 0.10, M: int = 16, ef_construction: int = 200, ef_search: int = 64, seed: int = 0, wait: float = 600.0):
        if not 0 < delta_ratio <= 0.5:
            raise ValueError("delta_ratio must be in range (0, 0.5]")
        self.spark, self.store = spark, Store(spark, path)
        self.delta_ratio, self.wait = delta_ratio, wait
        self.params = Params(M, ef_construction, ef_search, seed)
        known = self.store.read()
        if known.exists:
            dim = known.dim
        if dim <= 0:
            raise ValueError("dim must be greater than 0")
        self.dim = dim
        self._open = True
        self._mode: str | None = None
        self._ids: list[str] = []
        self._vectors: list[np.ndarray] = []

    # state

    def _manifest(self, version: int | None = None) -> Manifest:
        return self.store.read(version) if self._open else Manifest()

    @property
    def has_index(self) -> bool:
        return self._manifest().exists

    @property
    def version(self) -> int:
        return self._manifest().version

    def close(self) -> None:
        """Forget the state; searches then find nothing. Files stay."""
        self._open = False
        self._mode, self._ids, self._vectors = None, [], []

    def destroy(self) -> None:
        self.close()
        self.store.destroy()

    def vacuum(self, keep: int = 1, abandoned: float = 86400.0) -> int:
        return self.store.vacuum(keep, abandoned)

    # reading

    def _segment(self, m: Manifest, kind: str) -> DataFrame:
        folders = [f for f, _ in getattr(m, kind)]
        if not folders:
            return self.spark.createDataFrame([], SEGMENT)
        return self.spark.read.schema(SEGMENT).parquet(*folders)

    def _dead(self, m: Manifest, kind: str) -> DataFrame:
        folders = [f for f, _ in getattr(m, f"{kind}_dead")]
        if not folders:
            return self.spark.createDataFrame([], DEAD)
        return self.spark.read.schema(DEAD).parquet(*folders).groupBy("external_id").agg(F.max("seq").alias("dead"))

    def _live(self, m: Manifest, kind: str) -> DataFrame:
        rows = self._segment(m, kind)
        if not getattr(m, f"{kind}_dead"):
            return rows
        d = self._dead(m, kind)
        return rows.join(d, (rows.external_id == d.external_id) & (d.dead > rows.seq), "left_anti")

    def _known(self, m: Manifest) -> DataFrame:
        """Ids that a delete request finds: live ones, and dead ones whose
        segment has not been rebuilt since."""
        main = self._segment(m, "main").select("external_id")
        delta = self._segment(m, "delta")
        if m.delta_dead:
            d = self._dead(m, "delta").where(F.col("dead") <= m.delta_rebuilt)
            delta = delta.join(d, (delta.external_id == d.external_id) & (d.dead > delta.seq), "left_anti")
        return main.unionByName(delta.select("external_id"))

    def rows(self, version: int | None = None) -> DataFrame:
        """All live rows (external_id, vec, seq, pos) of a version, main before
        delta in the order of (seq, pos)."""
        m = self._manifest(version)
        return self._all(m).drop("cell")

    def _all(self, m: Manifest) -> DataFrame:
        return self._live(m, "main").unionByName(self._live(m, "delta"))

    def search(self, q, k: int = 10, efs: int = 64, version: int | None = None) -> list[str]:
        """Ids of the ``k`` nearest live rows, nearest first; ties in the order
        of arrival. Without an index, after ``close`` and with no live row the
        result is empty. The search is exact; in a trained index (see
        ``train``) it reads the cells nearest to the query only, as many as
        ``efs`` asks for: 64 aims at 0.95 of the neighbours, more at more."""
        m = self._manifest(version)
        v = check_vector(q, self.dim, "search")
        if k < 1:
            raise ValueError("k must be at least 1")
        if efs < 1:
            raise ValueError("efs must be at least 1")
        if not m.exists or not m.main_rows + m.delta_rows:
            return []
        rows = self._all(m)
        if m.centers:
            rows = rows.where(F.col("cell").isin(ann.nearest_cells(v[None], self._centers(m), self._probes(m, max(efs, k)))[0].tolist()))
        return [r[0] for r in nearest_one(rows, v, k, ties=("seq", "pos")).select("external_id").collect()]

    def search_batch(self, queries: DataFrame, k: int = 10, qid: str = "qid", query: str = "q", version: int | None = None, efs: int | None = None) -> DataFrame:
        """(qid, rank, external_id, distance) for every query, rank from 0;
        ties in the order of arrival. Exact, unless ``efs`` is given and the
        index is trained."""
        m = self._manifest(version)
        if efs is not None and m.centers:
            rows = self._all(m).select("cell", F.col("seq").alias("i0"), F.col("pos").alias("i1"), F.col("external_id").alias("value"), F.col("vec").alias("v"))
            found = ann.probe(rows, queries, self._centers(m), self._probes(m, max(efs, k)), k, qid, query)
        else:
            found = knn_carrying(self._all(m), queries, k, ("seq", "pos"), "external_id", "vec", qid, query)
        return found.select("qid", "rank", F.col("value").alias("external_id"), F.col("dist").alias("distance"))

    def _centers(self, m: Manifest) -> np.ndarray:
        rows = self.spark.read.schema("cell int, center array<double>").parquet(m.centers).orderBy("cell").collect()
        return np.array([r.center for r in rows])

    @staticmethod
    def _probes(m: Manifest, efs: int) -> int:
        """The least number of cells that hold the share that ``efs`` aims at."""
        return next((n for n, share in enumerate(m.recall, 1) if share >= efs / (efs + 3)), len(m.recall))

    def train(self, cells: int = 16, sample: int = 100_000, seed: int = 0) -> list[float]:
        """Divide the index into ``cells`` by k-means and fold it into a new
        main sorted by cell, so that a search reads some cells only; rows
        written later get their cell as they come, and a build forgets it all.
        The fit and the measured share of neighbours in the nearest 1, 2, ...
        cells, which is returned, come from at most about ``sample`` rows;
        every row is in a cell."""

        def step(m: Manifest):
            n = m.main_rows + m.delta_rows
            if not n:
                raise RuntimeError("No index loaded. Build first.")
            rows = self.rows()
            centers = ann.fit_centers(rows, max(1, min(cells, n)), sample, seed)
            few = min(1.0, sample / 5 / n)
            some = rows.sample(fraction=few, seed=seed + 1) if few < 1 else rows
            m.recall = ann.held(np.array([r[0] for r in some.select("vec").collect()], np.float32), centers)
            seq, made = m.commit + 1, [self.store.folder("centers")]
            try:
                self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(made[0])
                m.centers = made[0]
                made.append(self._fold(m, seq))
                m.commit = seq
                self.store.commit(m)
                self.store.settle(made)
            except BaseException:
                for f in made:
                    self.store.drop(f)
                raise
            return m.recall

        return self._change(step)

    def _in_cells(self, m: Manifest, rows: DataFrame) -> DataFrame:
        """Rows of a segment with their cell, if the index is trained."""
        rows = rows.select("external_id", "vec", "seq", "pos")
        return ann.with_cell(rows, self._centers(m)) if m.centers else rows.withColumn("cell", F.lit(None).cast("int"))

    def internal(self, kind: str = "main", version: int | None = None) -> DataFrame:
        """(idx, external_id) of a segment, dead rows included, numbered from 0
        in the order of arrival. Only the number of rows of each written task
        is collected, to know where its numbers begin."""
        rows = self._segment(self._manifest(version), kind)
        task = F.shiftright("pos", 33)
        sizes = rows.groupBy("seq", task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("seq", "task").collect()
        begin, starts = 0, []
        for r in sizes:
            starts.append((r.seq, r.task, begin))
            begin += r.n
        table = self.spark.createDataFrame(starts, "seq bigint, task bigint, start bigint")
        within = F.col("pos") - F.shiftleft(task, 33)
        return rows.withColumn("task", task).join(table, ["seq", "task"]).select((F.col("start") + within).alias("idx"), "external_id")

    def map_internal_to_external(self, idx: Iterable[int]) -> list[str]:
        """External ids of row numbers, in the order asked; of main if it has
        live rows, else of the delta."""
        asked = [int(i) for i in idx]
        m = self._manifest()
        wanted = self.spark.createDataFrame([(i,) for i in set(asked)], "idx bigint")
        known = dict(self.internal("main" if m.main_rows else "delta").join(wanted, "idx").collect()) if asked else {}
        if any(i not in known for i in asked):
            raise IndexError(f"no such row: {next(i for i in asked if i not in known)}")
        return [known[i] for i in asked]

    # counts

    @property
    def main_size(self) -> int:
        return self._manifest().main_rows

    @property
    def delta_size(self) -> int:
        return self._manifest().delta_rows

    @property
    def delta_threshold(self) -> int:
        return math.floor(self.main_size * self.delta_ratio)

    def live_count(self) -> int:
        m = self._manifest()
        return m.main_rows + m.delta_rows

    def deletes_since_build(self) -> int:
        m = self._manifest()
        return m.main_deletes + m.delta_deletes

    def needs_rebuild(self) -> bool:
        m = self._manifest()
        n = m.main_rows + m.delta_rows
        return n > 0 and ((m.main_deletes + m.delta_deletes) / n >= self.delta_ratio or m.delta_rows / n >= self.delta_ratio)

    # writing

    def _change(self, step: Callable[[Manifest], object]) -> object:
        """Run ``step`` on the current version until its commit is the next one."""
        until = time.monotonic() + self.wait
        lock = self.store.lock()
        if not lock.acquire(timeout=self.wait):
            raise RuntimeError(f"FileLock: timeout waiting for lock {self.store.path}")
        try:
            while True:
                try:
                    return step(self.store.read())
                except Conflict:
                    if time.monotonic() > until:
                        raise RuntimeError(f"FileLock: timeout waiting for lock {self.store.path}") from None
                    time.sleep(0.1)
        finally:
            lock.release()

    def init(self, mode: str) -> None:
        """Begin an ingest; rows buffered before are discarded."""
        if mode not in ("build", "insert", "upsert"):
            raise RuntimeError("init(mode): mode must be 'build'|'insert'|'upsert'")
        self._open = True
        self._mode, self._ids, self._vectors = mode, [], []

    def ingest(self, external_id: str, vec) -> None:
        if self._mode is None:
            raise RuntimeError("ingest: call init() first")
        v = check_vector(vec, self.dim, "ingest")
        self._ids.append(str(external_id))
        self._vectors.append(v)

    def finalize(self, optimize: bool = False, M: int = 0, ef_construction: int = 0, ef_search: int = 0, seed: int = 0) -> None:
        """Commit the buffered rows. A failed commit ends the ingest too."""
        if self._mode is None:
            raise RuntimeError("finalize: no pending ingest")
        mode, ids, vectors = self._mode, self._ids, self._vectors
        self._mode, self._ids, self._vectors = None, [], []
        params = Params(M, ef_construction, ef_search, seed) if M else self.params
        rows = self.spark.createDataFrame(pd.DataFrame({"external_id": ids, "vec": [v.tolist() for v in vectors]}), ROWS) if ids else self.spark.createDataFrame([], ROWS)
        self._write(rows, mode, optimize, params, checked=True)

    def write(self, rows: DataFrame, mode: str = "insert", optimize: bool = False, stream: tuple[str, int] | None = None) -> None:
        """Commit a DataFrame (external_id, vec) in one of the modes.

        ``stream`` (name, batch number) makes replays harmless: a batch that
        the stream has committed is skipped."""
        if mode not in ("build", "insert", "upsert"):
            raise RuntimeError("init(mode): mode must be 'build'|'insert'|'upsert'")
        self._open = True
        self._write(rows.select(F.col("external_id").cast("string").alias("external_id"), F.col("vec").cast("array<float>").alias("vec")), mode, optimize, self.params, stream=stream)

    def build_from_file(self, path: str, external_ids: Iterable[str], params: Params | None = None) -> None:
        """Replace the index by the rows of a headerless float32 file; the
        file stays."""
        from .sources.files import raw_vectors

        self._write(raw_vectors(self.spark, path, self.dim, list(external_ids)).select("external_id", "vec"), "build", False, params or Params(ef_construction=128, rng_seed=124))

    def _write(self, rows: DataFrame, mode: str, optimize: bool, params: Params, checked: bool = False, stream=None) -> None:
        def step(m: Manifest):
            if mode != "build" and not m.exists:
                raise RuntimeError("No index loaded. Build first.")
            if stream and m.streams.get(stream[0], -1) >= stream[1]:
                return
            seq = m.commit + 1
            folder = self.store.folder("rows")
            made = [folder]
            try:
                numbered = rows.withColumn("seq", F.lit(seq).cast("bigint")).withColumn("pos", F.monotonically_increasing_id())
                if mode == "build":
                    m.centers, m.recall = "", []
                if m.centers:  # lengths are checked before they are compared with centers
                    numbered = numbered.withColumn("vec", F.when(F.size("vec") == self.dim, F.col("vec")).otherwise(F.raise_error(F.lit("ingest: dimension mismatch")).cast("array<float>")))
                    numbered = self._in_cells(m, numbered).sortWithinPartitions("cell")
                numbered.write.parquet(folder)
                new = self.spark.read.schema(SEGMENT).parquet(folder)
                n = self._validate(new, mode, checked)
                if mode == "build":
                    m.main, m.delta, m.main_dead, m.delta_dead = [[folder, seq]], [], [], []
                    m.main_rows, m.delta_rows, m.main_deletes, m.delta_deletes = n, 0, 0, 0
                else:
                    if mode == "insert":
                        self._refuse_live(m, new)
                    else:
                        made += self._bury(m, new.select("external_id"), seq)[1]
                    if n:
                        m.delta.append([folder, seq])
                        m.delta_rows += n
                        m.delta_deletes, m.delta_rebuilt = 0, seq
                    if not m.main_rows and m.delta_rows:
                        self._promote(m)
                    elif optimize and m.main_rows and m.delta_rows > math.floor(m.main_rows * self.delta_ratio):
                        made.append(self._fold(m, seq))
                m.commit, m.dim, m.params = seq, self.dim, asdict(params)
                if stream:
                    m.streams[stream[0]] = stream[1]
                self.store.commit(m)
                self.store.settle(made)
            except BaseException:
                for f in made:
                    self.store.drop(f)
                raise

        self._change(step)

    def _validate(self, new: DataFrame, mode: str, checked: bool) -> int:
        """The number of rows, or the error that they deserve."""
        if checked:
            n, reason = new.count(), None
        else:
            n, reason = new.agg(F.count(F.lit(1)), F.min(bad_reason(self.dim))).first()
        if not n and mode == "build":
            raise RuntimeError("fit: empty dataset")
        if reason:
            raise RuntimeError("ingest: dimension mismatch" if reason == "dimension mismatch" else f"ingest: vector contains {reason}" if reason == "NaN/Inf" else "ingest: missing id")
        twice = repeated_ids(new).limit(1).collect() if n else []
        if twice:
            raise RuntimeError(f"duplicate external id: {twice[0].external_id}")
        return n

    def _refuse_live(self, m: Manifest, new: DataFrame) -> None:
        live = self._live(m, "main").select("external_id").unionByName(self._live(m, "delta").select("external_id"))
        twice = new.select("external_id").join(live, "external_id", "left_semi").limit(1).collect()
        if twice:
            raise RuntimeError(f"duplicate external id: {twice[0].external_id}")

    def _bury(self, m: Manifest, ids: DataFrame, seq: int) -> tuple[int, list[str]]:
        """Tombstones for the live rows with these ids; their number, and the
        folders written."""
        total, made = 0, []
        ids = ids.distinct()
        for kind in ("main", "delta"):
            if not getattr(m, kind):
                continue
            folder = self.store.folder("dead")
            self._live(m, kind).select("external_id").join(ids, "external_id", "left_semi").withColumn("seq", F.lit(seq).cast("bigint")).write.parquet(folder)
            n = self.spark.read.schema(DEAD).parquet(folder).count()
            if not n:
                self.store.drop(folder)
                continue
            made.append(folder)
            getattr(m, f"{kind}_dead").append([folder, seq])
            setattr(m, f"{kind}_rows", getattr(m, f"{kind}_rows") - n)
            setattr(m, f"{kind}_deletes", getattr(m, f"{kind}_deletes") + n)
            total += n
        return total, made

    def _promote(self, m: Manifest) -> None:
        """A delta becomes main when no row of main is live."""
        m.main, m.main_dead, m.main_rows, m.main_deletes = m.delta, m.delta_dead, m.delta_rows, m.delta_deletes
        m.delta, m.delta_dead, m.delta_rows, m.delta_deletes = [], [], 0, 0

    def _fold(self, m: Manifest, seq: int) -> str:
        """Rewrite the live rows as a new main of files of about ``FILE``
        bytes; returns its folder. Small files are put together as they are
        read, so rows don't move."""
        folder = self.store.folder("rows")
        files = -(-(m.main_rows + m.delta_rows) * (4 * self.dim + 48) // FILE)
        rows = self._all(m).coalesce(max(1, files))
        if m.centers:
            rows = self._in_cells(m, self._all(m)).repartitionByRange(max(1, files), "cell", "seq", "pos").sortWithinPartitions("cell")
        rows.write.option("parquet.block.size", FILE // 8).parquet(folder)
        m.main, m.delta, m.main_dead, m.delta_dead = [[folder, seq]], [], [], []
        m.main_rows, m.delta_rows, m.main_deletes, m.delta_deletes = m.main_rows + m.delta_rows, 0, 0, 0
        return folder

    def delete(self, ids: DataFrame) -> tuple[int, DataFrame]:
        """Delete the live rows whose ``external_id`` is in ``ids``; returns
        their number, and the ids not found, repeats kept. An id deleted before
        is not found only after its segment was rebuilt."""

        def step(m: Manifest):
            if not m.exists:
                raise RuntimeError("No index loaded. Build first.")
            before = Manifest(**asdict(m))
            wanted = ids.select(F.col("external_id").cast("string").alias("external_id"))
            seq = m.commit + 1
            n, made = self._bury(m, wanted, seq)
            if n:
                if not m.main_rows and m.delta_rows:
                    self._promote(m)
                m.commit = seq
                try:
                    self.store.commit(m)
                    self.store.settle(made)
                except BaseException:
                    for f in made:
                        self.store.drop(f)
                    raise
            return n, wanted.join(self._known(before).distinct(), "external_id", "left_anti")

        return self._change(step)

    def delete_items(self, external_ids: Iterable[str], return_not_found: bool = False) -> tuple[int, list[str] | None]:
        ids = [str(i) for i in external_ids]
        if not ids:
            if not self.has_index:
                raise RuntimeError("No index loaded. Build first.")
            return 0, [] if return_not_found else None
        n, missing = self.delete(self.spark.createDataFrame([(i,) for i in ids], "external_id string"))
        if not return_not_found:
            return n, None
        gone = {r[0] for r in missing.distinct().collect()}
        return n, [i for i in ids if i in gone]

    def rebuild_compact(self, M: int = 16, ef_construction: int = 16, ef_search: int = 64, seed: int = 0) -> None:
        """Fold all live rows into a new main, always."""

        def step(m: Manifest):
            if not m.exists:
                raise RuntimeError("No index loaded. Build first.")
            if not m.main_rows + m.delta_rows:
                raise RuntimeError("fit: empty dataset")
            seq = m.commit + 1
            folder = self._fold(m, seq)
            m.commit, m.params = seq, asdict(Params(M, ef_construction, ef_search, seed))
            try:
                self.store.commit(m)
                self.store.settle([folder])
            except BaseException:
                self.store.drop(folder)
                raise

        self._change(step)

    def optimize_graph(self) -> None:
        """Compact if ``needs_rebuild``; nothing without an index."""
        if self._mode is not None:
            raise RuntimeError("optimize_graph: cannot optimize while ingest is pending")
        if self.has_index and self.needs_rebuild():
            self.rebuild_compact(**{k: v for k, v in zip(("M", "ef_construction", "ef_search", "seed"), asdict(self.params).values())})
