"""Problem 6: filling containers, by a grouping genetic algorithm on islands.

Sizes are tokens. A text above the capacity is split into full containers and
a remainder; everything else stays whole. Items are dealt to shards by hash;
each shard is packed by several islands, populations that evolve apart and
pass their best packing on to the next island between epochs. A child takes
over well-filled containers of one parent whole, drops the other parent's
containers that hold any of their items, exchanges displaced items for smaller
ones in what is left, and places the rest where they fit best. Populations travel as rows, so an epoch is a stage of the plan
and a lost executor only repeats its shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items in a shard, islands of a shard, packings on an island, epochs, and children per epoch.
SHARD, ISLANDS, POPULATION, EPOCHS, CHILDREN = 1024, 3, 5, 3, 10

#: A token is a run of word characters, or any other character but white space.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"


def tokens(text: Column) -> Column:
    """Number of tokens; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def tokenizer_sizes(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, size) in tokens of a public tokenizer's JSON file at ``path``."""

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf["text"].tolist()]
            for s in range(0, len(texts), 256):
                sizes = [len(e.ids) for e in t.encode_batch(texts[s : s + 256], add_special_tokens=False)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[s : s + 256].to_numpy(), "size": np.array(sizes, np.int64)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, size bigint")


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put items, largest first, into the container with the least room that
    holds them, or a new one. ``bins`` and ``room`` grow in place."""
    free = sorted((r, b) for b, r in enumerate(room))
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            b = len(bins)
            bins.append([i]), room.append(capacity - sizes[i])
        else:
            _, b = free.pop(at)
            bins[b].append(i)
            room[b] -= sizes[i]
        insort(free, (room[b], b))


def score(room: list[int], capacity: int) -> tuple[int, int]:
    """Fewer containers first, then more uneven filling (one nearly empty
    container is better than many half full ones)."""
    return len(room), -sum((capacity - r) ** 2 for r in room)


class Packing:
    def __init__(self, bins: list[list[int]], room: list[int], capacity: int):
        self.bins, self.room = bins, room
        self.score = score(room, capacity)

    def pack(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def unpack(at: np.ndarray, sizes: list[int], capacity: int) -> Packing:
    bins: list[list[int]] = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
    for i, b in enumerate(at.tolist()):
        bins[b].append(i)
    bins = [b for b in bins if b]
    return Packing(bins, [capacity - sum(sizes[i] for i in b) for b in bins], capacity)


def start(sizes: list[int], capacity: int, rng: np.random.Generator, first: bool) -> Packing:
    """Best fit of all items by falling size, or after a random part is fixed
    in random order."""
    bins: list[list[int]] = []
    room: list[int] = []
    rest = list(range(len(sizes)))
    if not first:
        some = rng.permutation(len(sizes))[: len(sizes) // 3].tolist()
        free: list[tuple[int, int]] = []
        for i in some:
            at = bisect_left(free, (sizes[i], -1))
            if at == len(free):
                b = len(bins)
                bins.append([i]), room.append(capacity - sizes[i])
            else:
                _, b = free.pop(at)
                bins[b].append(i)
                room[b] -= sizes[i]
            insort(free, (room[b], b))
        gone = set(some)
        rest = [i for i in rest if i not in gone]
    best_fit(rest, sizes, bins, room, capacity)
    return Packing(bins, room, capacity)


def exchange(loose: list[int], sizes: list[int], bins: list[list[int]], room: list[int]) -> list[int]:
    """Fill containers better by exchanging an item, or two, for a displaced
    one that takes more of the room; returns what is displaced then, which is
    smaller and fits elsewhere more easily."""
    free = sorted((sizes[i], i) for i in loose)
    for b, items in enumerate(bins):
        if not room[b] or not free:
            continue
        most, swap = 0, None
        for n, t in enumerate(items):
            for other in (None, *items[n + 1 :]):
                have = sizes[t] + (sizes[other] if other is not None else 0)
                at = bisect_left(free, (have + room[b] + 1, -1)) - 1
                if at >= 0 and free[at][0] - have > most:
                    most, swap = free[at][0] - have, (t, other, at)
        if swap:
            t, other, at = swap
            _, new = free.pop(at)
            gone = [t] if other is None else [t, other]
            bins[b] = [i for i in items if i not in gone] + [new]
            room[b] -= most
            for i in gone:
                insort(free, (sizes[i], i))
    return [i for _, i in free]


def child(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Inject well-filled containers of ``b`` into ``a``; then dissolve a few
    of the emptiest as mutation, and place what was displaced by exchange and
    best fit."""
    order = np.argsort(np.array(b.room), kind="stable")
    order = order[: max(1, len(order) * 2 // 3)]
    taken = order[rng.random(len(order)) < 0.5].tolist() or [int(order[0])]
    inside = {i for t in taken for i in b.bins[t]}
    bins, room, loose = [list(b.bins[t]) for t in taken], [b.room[t] for t in taken], []
    for items, r in zip(a.bins, a.room):
        if inside.isdisjoint(items):
            bins.append(list(items)), room.append(r)
        else:
            loose += [i for i in items if i not in inside]
    empty = np.argsort(-np.array(room), kind="stable")[: 1 + len(room) // 20].tolist()
    for t in empty:
        loose += bins[t]
    drop = set(empty)
    bins = [x for t, x in enumerate(bins) if t not in drop]
    room = [x for t, x in enumerate(room) if t not in drop]
    loose = exchange(loose, sizes, bins, room)
    best_fit(loose, sizes, bins, room, capacity)
    return Packing(bins, room, capacity)


def evolve(sizes: np.ndarray, population: np.ndarray, guest: np.ndarray | None, capacity: int, seed: tuple[int, ...], keep: int, children: int) -> np.ndarray:
    """One epoch: a population (rows of container numbers; none at first) with
    the neighbour's guest replacing the worst; the best row comes first. Stops
    early at the lower bound."""
    rng = np.random.default_rng(list(seed))
    s = sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    if len(population):
        pop = [unpack(row, s, capacity) for row in population]
        if guest is not None:
            pop[-1] = unpack(guest, s, capacity)
    else:
        pop = [start(s, capacity, rng, True)]
        if pop[0].score[0] > least:
            pop += [start(s, capacity, rng, False) for _ in range(keep - 1)]
        pop = (pop * keep)[:keep]
    pop.sort(key=lambda p: p.score)
    for _ in range(children):
        if pop[0].score[0] <= least:
            break
        x, y = sorted(rng.integers(len(pop), size=2).tolist())
        new = child(pop[x], pop[y], s, capacity, rng) if rng.random() < 0.5 else child(pop[y], pop[x], s, capacity, rng)
        if new.score < pop[-1].score:
            pop[-1] = new
            pop.sort(key=lambda p: p.score)
    return np.stack([p.pack(len(s)) for p in pop]) if len(s) else np.zeros((keep, 0), np.int32)


_STATE = "shard bigint, island int, ids array<bigint>, pieces array<int>, sizes array<int>, pop binary"


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, children: int = CHILDREN, rows: int | None = None) -> DataFrame:
    """(doc_id, piece, size, container): every row of ``sizes`` (doc_id, size)
    assigned to containers of ``capacity``.

    A text above the capacity has several pieces, all but the last filling a
    container of their own; all others have piece 0 only. Empty texts (size 0)
    take no room and share a shard's first container. Container ids are unique
    over all shards. Two rows with one doc_id are two texts.
    """
    n = sizes.count() if rows is None else rows
    shards = max(1, -(-n // shard))
    capacity_ = F.lit(capacity)
    base = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("size").cast("bigint").alias("size"))
    full = F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity_)).otherwise(0)
    base = base.withColumn("full", full.cast("int")).withColumn("rest", (F.col("size") - F.col("full") * capacity).cast("int"))
    base = base.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    # one row per shard and at most `limit` items
    w = Window.partitionBy("shard").orderBy("doc_id", "size")
    limit = 8 * shard
    numbered = base.withColumn("part", F.floor((F.row_number().over(w) - 1) / limit).cast("int"))
    lists = numbered.groupBy("shard", "part").agg(F.sort_array(F.collect_list(F.struct("doc_id", "full", "rest"))).alias("x"))
    state = lists.select((F.col("shard") + F.col("part") * F.lit(shards).cast("bigint")).alias("shard"), F.col("x.doc_id").alias("ids"), F.col("x.full").alias("pieces"), F.col("x.rest").alias("sizes"))
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("pop", F.lit(None).cast("binary")).withColumn("guest", F.lit(None).cast("binary"))

    def epoch(number: int):
        def run(batches):
            for pdf in batches:
                pops = []
                for row in pdf.itertuples(index=False):
                    rest, whole = np.asarray(row.sizes, np.int64), np.asarray(row.pieces, np.int64)
                    # a text split without remainder leaves no item
                    items = rest[(whole == 0) | (rest > 0)]
                    m = len(items)
                    pop = np.frombuffer(row.pop, np.int32).reshape(-1, m) if row.pop is not None and m else np.zeros((0, m), np.int32)
                    guest = np.frombuffer(row.guest, np.int32) if row.guest is not None and m else None
                    pops.append(evolve(items, pop, guest, capacity, (row.shard, row.island, number), population, children).astype(np.int32).tobytes())
                yield pdf.assign(pop=pops)[["shard", "island", "ids", "pieces", "sizes", "pop"]]

        return run

    ring = Window.partitionBy("shard").orderBy("island")
    for number in range(epochs):
        # islands of a shard run in different tasks
        state = state.repartition("shard", "island").select("shard", "island", "ids", "pieces", "sizes", "pop", "guest").mapInPandas(epoch(number), _STATE)
        if number < epochs - 1:
            best = F.expr("substring(pop, 1, length(pop) div %d)" % population)
            state = state.withColumn("best", best).withColumn("guest", F.coalesce(F.lag("best").over(ring), F.last("best").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).drop("best")

    def finish(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, whole, rest = np.asarray(row.ids, np.int64), np.asarray(row.pieces, np.int64), np.asarray(row.sizes, np.int64)
                item = np.flatnonzero((whole == 0) | (rest > 0))
                m = len(item)
                at = np.frombuffer(row.pop, np.int32)[:m].astype(np.int64)
                used = int(at.max()) + 1 if m else 0
                k = np.repeat(np.arange(len(ids)), whole)
                piece = np.arange(len(k)) - np.repeat(np.cumsum(whole) - whole, whole)
                yield pd.DataFrame(
                    {
                        "doc_id": np.r_[ids[item], ids[k]],
                        "piece": np.r_[whole[item], piece].astype(np.int64),
                        "size": np.r_[rest[item], np.full(len(k), capacity)].astype(np.int64),
                        "shard": np.full(m + len(k), row.shard),
                        "slot": np.r_[at, used + np.arange(len(k))].astype(np.int64),
                    }
                )

    # the best island of each shard: fewest containers, then the fullest
    best = state.withColumn("used", _used("pop", population)).withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy("used", "island"))).where("n = 1")
    out = best.select("shard", "ids", "pieces", "sizes", "pop").mapInPandas(finish, "doc_id bigint, piece bigint, size bigint, shard bigint, slot bigint")
    return out.select("doc_id", "piece", "size", (F.col("shard") * F.lit(1 << 24).cast("bigint") + F.col("slot")).alias("container"))


def _used(pop: str, population: int) -> Column:
    @F.pandas_udf("int")
    def used(p: pd.Series) -> pd.Series:
        def one(b):
            a = np.frombuffer(b, np.int32)
            first = a[: len(a) // population]
            return int(first.max()) + 1 if len(first) else 0

        return p.map(one)

    return used(F.col(pop))


def split(packed: DataFrame) -> DataFrame:
    """(doc_id) of the texts that had to be split."""
    return packed.where("piece > 0").select("doc_id").distinct()


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: texts, containers, least possible number of containers, and
    the share of room filled."""
    per = packed.groupBy("container").agg(F.sum("size").alias("size"))
    one = per.agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    return one.select("containers", F.ceil(F.col("tokens") / capacity).cast("bigint").alias("least"), "fullest", (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))
