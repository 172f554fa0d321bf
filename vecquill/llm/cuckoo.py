"""Problem 1: has this key been seen before, by partitioned cuckoo tables.

Events are partitioned by the hash of their key; each partition replays its
events in arrival order against its own cuckoo table of 16-bit fingerprints
with two candidate buckets of four slots. The second bucket follows from the
first and the fingerprint, so entries can be moved and deleted without their
keys. A saturated table gets a successor of twice the size, and lookups ask
all of them.

``Seen`` keeps the tables between runs: a wave of events loads them, asks and
adds, and writes them as the wave's version, so earlier events are never read
again.

A table says "seen" for every key that was, and now and then for one that
was not; those answers, and only those, are checked against the first arrival
of the exact key, which also gives the rate of wrong answers.
"""

from __future__ import annotations

import io
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, ints, materialise, scratch, sorted_groups
from .vectors import mixed

SLOTS = 4
#: Keys per partition that a table is laid out for; further keys make it grow.
KEYS = 1 << 17
_FULL = 0.9
#: Key hashes in question that are broadcast to the exact check; beyond, its semi-join is a shuffled one.
BROADCAST = 1 << 20


class _Table:
    def __init__(self, buckets: int):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16)  # 0: free
        self.used = np.zeros(buckets, np.int8)
        self.entries = 0

    @classmethod
    def of(cls, slots: np.ndarray) -> _Table:
        self = cls.__new__(cls)
        self.buckets, self.slots, self.used = len(slots), slots, (slots != 0).sum(1).astype(np.int8)
        self.entries = int(self.used.sum())
        return self

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        turn = mark.astype(np.uint64) * np.uint64(0x5BD1E995)
        return ((bucket.astype(np.uint64) ^ turn) & np.uint64(self.buckets - 1)).astype(np.int64)

    def first(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, h: np.ndarray, mark: np.ndarray) -> np.ndarray:
        a = self.first(h)
        b = self.other(a, mark)
        return (self.slots[a] == mark[:, None]).any(1) | (self.slots[b] == mark[:, None]).any(1)

    def _place(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their bucket; which ones found room."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        turn = np.arange(len(b)) - np.searchsorted(b, b)
        slot = self.used[b] + turn
        fits = slot < SLOTS
        self.slots[b[fits], slot[fits]] = mark[order[fits]]
        np.add.at(self.used, b[fits], 1)
        self.entries += int(fits.sum())
        out = np.zeros(len(b), bool)
        out[order[fits]] = True
        return out

    def add(self, h: np.ndarray, mark: np.ndarray, kicks: int = 200) -> np.ndarray:
        """Insert; returns the (bucket, mark) rows that found no room: the
        displaced entries, not necessarily the new ones."""
        a = self.first(h)
        left = ~self._place(a, mark)
        left[left] = ~self._place(self.other(a[left], mark[left]), mark[left])
        bucket, m = self.other(a[left], mark[left]), mark[left]
        for turn in range(kicks):
            if not len(m):
                break
            # one at a time in each bucket throws out an entry, which goes to its other bucket
            _, at = np.unique(bucket, return_index=True)
            b, slot = bucket[at], (m[at].astype(np.int64) + turn) % SLOTS
            out = self.slots[b, slot]
            self.slots[b, slot] = m[at]
            b = self.other(b, out)
            homeless = ~self._place(b, out)
            wait = np.ones(len(m), bool)
            wait[at] = False
            bucket, m = np.r_[b[homeless], bucket[wait]], np.r_[out[homeless], m[wait]]
        return np.column_stack([bucket, m.astype(np.int64)])

    def remove(self, h: int, mark: int) -> bool:
        a = int(self.first(np.array([h], np.uint64))[0])
        for bucket in (a, int(self.other(np.array([a]), np.array([mark], np.uint16))[0])):
            at = np.flatnonzero(self.slots[bucket] == mark)
            if len(at):
                last = self.used[bucket] - 1
                self.slots[bucket, at[0]] = self.slots[bucket, last]
                self.slots[bucket, last] = 0
                self.used[bucket] -= 1
                self.entries -= 1
                return True
        return False


class Cuckoo:
    """A growing chain of cuckoo tables over 64-bit key hashes.

    ``has`` never misses an added key that was not removed. ``remove`` of a
    key that was never added can remove another key with its fingerprint; ask
    only for keys known to be in.
    """

    def __init__(self, keys: int = KEYS):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / _FULL))))
        self.tables = [_Table(size)]
        #: entries that found no slot, as exact (table, bucket, mark)
        self.stash: set[tuple[int, int, int]] = set()

    @staticmethod
    def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        return h, np.where(mark == 0, np.uint16(1), mark)

    def has(self, keys: np.ndarray) -> np.ndarray:
        h, mark = self._split(keys)
        out = np.zeros(len(h), bool)
        for n, t in enumerate(self.tables):
            out |= t.has(h, mark)
            for at, bucket, m in self.stash:
                if at == n:
                    a = t.first(h)
                    out |= (mark == m) & ((a == bucket) | (t.other(a, mark) == bucket))
        return out

    def add(self, keys: np.ndarray) -> None:
        h, mark = self._split(keys)
        while len(h):
            t = self.tables[-1]
            room = int(_FULL * SLOTS * t.buckets) - t.entries
            if room <= 0:
                self.tables.append(_Table(t.buckets * 2))
                continue
            lost = t.add(h[:room], mark[:room])
            for bucket, m in lost.tolist():
                self.stash.add((len(self.tables) - 1, bucket, m))
            h, mark = h[room:], mark[room:]
            if len(lost):
                self.tables.append(_Table(t.buckets * 2))

    def dump(self) -> bytes:
        out = io.BytesIO()
        stash = np.array(sorted(self.stash), np.int64).reshape(-1, 3)
        np.savez(out, stash=stash, **{f"t{n}": t.slots for n, t in enumerate(self.tables)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        self = cls.__new__(cls)
        self.tables = [_Table.of(got[f"t{n}"]) for n in range(len(got.files) - 1)]
        self.stash = {tuple(row) for row in got["stash"].tolist()}
        return self

    def remove(self, key: int) -> bool:
        h, mark = self._split(np.array([key], np.int64))
        for n, t in enumerate(self.tables):
            a = int(t.first(h)[0])
            b = int(t.other(np.array([a]), mark)[0])
            for bucket in (a, b):
                if (n, bucket, int(mark[0])) in self.stash:
                    self.stash.remove((n, bucket, int(mark[0])))
                    return True
            if t.remove(int(h[0]), int(mark[0])):
                return True
        return False


def seen_in_order(keys: np.ndarray, adds: np.ndarray, table: Cuckoo, step: int = 8192) -> np.ndarray:
    """Replay events in order: what the table says about each key; adding
    events of keys that it doesn't have enter it. In a step, the events up to
    the first adding one of their key come first, then the others."""
    out = np.zeros(len(keys), bool)
    for s in range(0, len(keys), step):
        k, add = keys[s : s + step], adds[s : s + step]
        order = np.lexsort((np.arange(len(k)), k))
        sk, sa = k[order], add[order].astype(np.int64)
        start = np.r_[True, sk[1:] != sk[:-1]]
        group = np.cumsum(start) - 1
        before = np.cumsum(sa) - sa
        early = np.empty(len(k), bool)
        early[order] = before == before[np.flatnonzero(start)][group]
        hit = np.zeros(len(k), bool)
        hit[early] = table.has(k[early])
        table.add(k[early & add & ~hit])
        hit[~early] = table.has(k[~early])
        out[s : s + step] = hit
    return out


_EVENT = "req_id bigint, pos bigint, is_add boolean, key bigint"


def events(requests: DataFrame, deletes: DataFrame) -> DataFrame:
    """(req_id, pos, is_add, name, ext, key) of every ingest request and every
    element of a delete request; null names and null or empty ids are no keys.
    ``key`` is a 64-bit hash of collection and id."""
    a = requests.select("req_id", F.lit(0).cast("bigint").alias("pos"), F.lit(True).alias("is_add"), F.col("index_name").alias("name"), F.col("external_id").alias("ext"))
    d = deletes.select("req_id", F.col("index_name").alias("name"), F.posexplode("external_ids").alias("p", "ext"))
    d = d.select("req_id", F.col("p").cast("bigint").alias("pos"), F.lit(False).alias("is_add"), "name", "ext")
    both = a.unionByName(d).where(F.col("name").isNotNull() & F.col("ext").isNotNull() & (F.col("ext") != ""))
    return both.withColumn("key", F.xxhash64("name", "ext"))


def _reduced(rows: DataFrame) -> DataFrame:
    """Pre-aggregation of a batch before it moves: an adding event that has an
    earlier adding event of its key in the same batch, and a deleting one after
    it, is ``certain``: no table need be asked. So a key that holds a third of
    all events sends one adding event per batch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            req, pos, add, key = (ints(batch.column(i)) for i in range(4))
            add = add.astype(bool)
            order = np.lexsort((pos, req, ~add, key))
            k, a, r = key[order], add[order], req[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            group = np.searchsorted(start, np.arange(len(k)), side="right") - 1
            certain = np.empty(len(k), bool)
            certain[order] = r > np.where(a[start], r[start], np.iinfo(np.int64).max)[group]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(certain)], names=["req_id", "pos", "is_add", "key", "certain"])

    return rows.mapInArrow(run, _EVENT + ", certain boolean")


_OUT = "kind int, part int, req_id bigint, pos bigint, key bigint, asked bigint, tables binary"


class Seen:
    """Cuckoo tables in ``parts`` partitions, kept in ``path`` between runs.

    ``ask`` takes a wave of events, which come after those of the waves before,
    and returns the ones that the tables call seen; its version of the tables
    is written beside the answers, so a wave that is asked again gives the
    same. Keys with more than ``keys`` deleting events are salted: these events
    are spread over partitions, and each gets the key's adding ones."""

    def __init__(self, spark: SparkSession, path: str, parts: int, keys: int = KEYS):
        self.spark, self.path, self.parts, self.keys = spark, path, parts, keys

    def _wave(self, n: int) -> DataFrame:
        return self.spark.read.schema(_OUT).parquet(f"{self.path}/wave={n}")

    def _placed(self, rows: DataFrame) -> DataFrame:
        # all but the lowest bits choose the partition, the tables use a different mix of the hash
        part = F.xxhash64("key", F.lit(5))
        deleting = rows.where(~F.col("is_add"))
        if deleting.count() > self.keys:
            hot = deleting.groupBy("key").count().where(F.col("count") > self.keys)
            hot = hot.select("key", F.ceil(F.col("count") / self.keys).cast("int").alias("salts"))  # at most events / keys rows
            own = F.pmod(F.xxhash64("req_id", "pos"), F.col("salts")).cast("int")
            salts = F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(F.col("is_add"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))
            rows = rows.join(hot, "key", "left").withColumn("salt", F.explode(salts))
            part = F.xxhash64("key", "salt", F.lit(5))
        return rows.select(F.pmod(part, F.lit(self.parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "req_id", "pos", "is_add", "key", F.lit(None).cast("binary").alias("tables"))

    def ask(self, rows: DataFrame, wave: int) -> DataFrame:
        """(req_id, pos, key) of the events (req_id, pos, is_add, key) that the
        tables call seen, or that the wave itself makes certain; each once."""
        reduced = materialise(_reduced(rows))
        placed = self._placed(reduced.where(~F.col("certain")).drop("certain"))
        if wave:
            state = self._wave(wave - 1).where("kind = 1")
            placed = placed.unionByName(state.select("part", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("req_id"), F.lit(0).cast("bigint").alias("pos"), F.lit(False).alias("is_add"), F.lit(0).cast("bigint").alias("key"), "tables"))
        keys = self.keys

        def run(batches):
            part, table, last, asked = None, None, None, 0

            def state():
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((1, pa.int32()), (part, pa.int32()), (None, pa.int64()), (None, pa.int64()), (None, pa.int64()), (asked, pa.int64()), (table.dump(), pa.binary()))], names=["kind", "part", "req_id", "pos", "key", "asked", "tables"])

            for (own, kind), t in sorted_groups(batches, 2, 1 << 17):
                if own != part:
                    if table:
                        yield state()
                    part, table, last, asked = own, Cuckoo(keys), None, 0
                if not kind:
                    table = Cuckoo.load(t.column(6)[0].as_py())
                    continue
                # deliveries of one event are neighbours; the first counts
                req, pos = ints(t.column(2)), ints(t.column(3))
                fresh = np.r_[last != (req[0], pos[0]), (req[1:] != req[:-1]) | (pos[1:] != pos[:-1])]
                last = (req[-1], pos[-1])
                req, pos, key, add = req[fresh], pos[fresh], ints(t.column(5))[fresh], ints(t.column(4)).astype(bool)[fresh]
                asked += len(req)
                hit = seen_in_order(key, add, table)
                n = int(hit.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, own, np.int32)), pa.array(req[hit]), pa.array(pos[hit]), pa.array(key[hit]), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.binary())], names=["kind", "part", "req_id", "pos", "key", "asked", "tables"])
            if table:
                yield state()

        answers = placed.repartition(self.parts, "part").sortWithinPartitions("part", "kind", "req_id", "pos").mapInArrow(run, _OUT)
        answers.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/wave={wave}")
        found = materialise(self._wave(wave).where("kind = 0").select("req_id", "pos", "key", F.lit(True).alias("by_table")).unionByName(reduced.where("certain").select("req_id", "pos", "key", F.lit(False).alias("by_table"))))
        discard(reduced)
        return found

    def asked(self, wave: int) -> DataFrame:
        """(asked): the number of events that each partition was asked about."""
        return self._wave(wave).where("kind = 1").select("asked")


def _suspected(requests: DataFrame, deletes: DataFrame, keys: int, waves: int = 2) -> tuple[DataFrame, DataFrame]:
    """The events that are called seen, and the numbers that the tables were
    asked about: the arrivals in ``waves`` of about equal size, each asked
    against the tables that the wave before has left."""
    rows = events(requests, deletes).select("req_id", "pos", "is_add", "key")
    total = requests.count() + deletes.count()
    seen = Seen(requests.sparkSession, scratch(requests.sparkSession, "seen"), max(8, -(-total // keys)), keys)
    cuts = requests.select(F.percentile_approx("req_id", [k / waves for k in range(1, waves)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    found, asked = [], []
    for wave, (low, high) in enumerate(zip(edges, edges[1:])):
        some = rows
        if low is not None:
            some = some.where(F.col("req_id") > low)
        if high is not None:
            some = some.where(F.col("req_id") <= high)
        found.append(seen.ask(some, wave))
        asked.append(seen.asked(wave))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, asked)


def suspected(requests: DataFrame, deletes: DataFrame, keys: int = KEYS) -> DataFrame:
    """(req_id, pos, key, by_table) of the events called seen. Deliveries of
    one ``req_id`` count once."""
    return _suspected(requests, deletes, keys)[0]


def checked(requests: DataFrame, deletes: DataFrame, found: DataFrame) -> DataFrame:
    """(req_id, pos, seen, by_table) of the events ``found``, each once; ``seen``
    tells whether an ingest request of smaller ``req_id`` has exactly the same
    key.

    Only events of keys in question move; their first arrivals are
    pre-aggregated per key hash. A hash with more than one key among all its
    events is settled by the keys themselves.
    """
    found = found.groupBy("req_id", "pos", "key").agg(F.max("by_table").alias("by_table"))
    asked = materialise(found.select("key").distinct())
    few = asked.count() <= BROADCAST
    rows = events(requests, deletes).join(F.broadcast(asked) if few else asked, "key", "left_semi")
    text = F.concat_ws("\x00", F.length("name").cast("string"), "name", "ext")
    firsts = rows.groupBy("key").agg(F.min(F.when(F.col("is_add"), F.col("req_id"))).alias("first"), F.min(F.sha2(text, 256)).alias("low"), F.max(F.sha2(text, 256)).alias("high"))
    firsts = materialise(firsts.select("key", "first", (F.col("low") != F.col("high")).alias("mixed")))
    seen = (F.col("first").isNotNull() & (F.col("req_id") > F.col("first"))).alias("seen")
    plain = found.join(firsts.where(~F.col("mixed")), "key").select("req_id", "pos", seen, "by_table")
    if firsts.where("mixed").isEmpty():
        return plain
    clash = rows.join(firsts.where("mixed").select("key"), "key", "left_semi")
    start = clash.where("is_add").groupBy("name", "ext").agg(F.min("req_id").alias("first"))
    slow = found.join(clash.select("req_id", "pos", "key", "name", "ext").distinct(), ["req_id", "pos", "key"]).join(start, ["name", "ext"], "left").select("req_id", "pos", seen, "by_table")
    return plain.unionByName(slow)


def seen_before(requests: DataFrame, deletes: DataFrame, keys: int = KEYS) -> DataFrame:
    """(req_id, pos) of the events whose key an earlier ingest request has."""
    return checked(requests, deletes, suspected(requests, deletes, keys)).where("seen").select("req_id", "pos")


def audit(requests: DataFrame, deletes: DataFrame, keys: int = KEYS) -> DataFrame:
    """One row: events; those that repeat one of their batch and were settled
    before they moved; those that the tables were asked about; the tables'
    "seen" answers; the wrong ones among them; and the rate of wrong answers
    among the events asked about that were not seen. Salted keys' adding
    events are asked about once for each salt."""
    found, asked = _suspected(requests, deletes, keys)
    n = events(requests, deletes).select("req_id", "pos").distinct().agg(F.count(F.lit(1)).alias("events"))
    table = F.col("by_table")
    c = checked(requests, deletes, found).agg(
        F.count(F.when(~table, 1)).alias("repeats"), F.count(F.when(table, 1)).alias("answered_seen"), F.count(F.when(table & ~F.col("seen"), 1)).alias("wrong")
    )
    out = n.crossJoin(c).crossJoin(asked.agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("asked")))
    return out.select("events", "repeats", "asked", "answered_seen", "wrong", (F.col("wrong") / F.greatest(F.col("asked") - F.col("answered_seen") + F.col("wrong"), F.lit(1))).alias("wrong_rate"))
