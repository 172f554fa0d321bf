"""Problem 8: long exact spans shared between records, by level-wise doubling.

A span of 200 characters is shared only if the windows of 50 inside are, and
those of 100. To keep the first level small, of the 151 windows of 50 in each
stretch of 200 only the one with the least hash is taken: equal stretches
take equal windows, so nothing is lost, and about one position in 76 is taken.

Level 50: windows that occur in one text alone are dropped. Level 100: each
survivor is extended to twice its length to the left and to the right; a span
that holds it holds one of the two. Level 200: the survivors' surroundings are
compared letter by letter. Few different surroundings are compared directly;
where a window has many, all its stretches of 200 are grouped by two
independent hashes of 64 bits instead, so the work stays in proportion to the
text. ``longest`` goes on to 400, 800 and so on with the texts that survive,
until none does.

Equal texts count as one text until the end, so copies cost nothing before
their pairs are written out; a digest of 128 bits tells which are equal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import discard, ints, materialise, sorted_groups
from .texts import OTHER, code_points, joined, ranges, slices, spread, windows

SPAN = 200
#: The first level's share of the span.
SHARE = 4
#: Different surroundings of one window that are compared pair by pair.
DIRECT = 24
#: Bytes of survivors' positions that may be broadcast to the text scan, and of each of them.
BROADCAST, PLACE = 64 << 20, 40


def taken(h: np.ndarray, starts: np.ndarray, first: int = SPAN // SHARE, span: int = SPAN) -> np.ndarray:
    """Positions of the windows with the least hash of each stretch. ``h``
    hashes all windows of the texts joined together; windows that cross a
    text's end are never taken."""
    n = len(h)
    w = span - first + 1
    if n == 0:
        return np.zeros(0, np.int64)
    key = h.copy()
    bad = starts[1:-1][:, None] - np.arange(1, first)[None]
    bad = bad[(bad >= 0) & (bad < n)]
    # order by the hash's upper bits, then by place
    key &= ~np.uint64((1 << 28) - 1)
    key[bad] |= np.uint64(0xFFFFFFFFF << 28)
    key |= np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = max(1, n - w + 1)
    least = np.minimum(right[:m], left[w - 1 : w - 1 + m])
    at = np.unique(least & np.uint64((1 << 28) - 1)).astype(np.int64)
    ok = np.ones(n, bool)
    ok[bad] = False
    return at[ok[at]]


_ANCHOR = "text_key bigint, pos int, h bigint, left bigint, right bigint"


def _anchors(span: int):
    first = span // SHARE

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                keys = ints(part.column(0))
                codes, starts = code_points(part.column(1))
                h = windows(spread(codes), first)
                at = taken(h, starts, first, span)
                doc = np.searchsorted(starts, at, "right") - 1
                begin, end = starts[doc], starts[doc + 1]
                a, b = np.maximum(at - first, 0), np.minimum(at + first, len(h) - 1)
                left, right = joined(h[a], h[at], first), joined(h[at], h[b], first)
                # a window that would leave the text gets none: 0 marks it
                left = np.where(at - first >= begin, left, 0).astype(np.uint64)
                right = np.where(at + 2 * first <= end, right, 0).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[doc]), pa.array((at - begin).astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["text_key", "pos", "h", "left", "right"]
                )

    return run


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur in more than one text, pre-aggregated before they move."""
    g = rows.groupBy(*key).agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"))
    return g.where("lo <> hi").select(*key)


def _contexts(span: int):
    reach = span - span // SHARE

    def run(batches):
        for batch in batches:
            keys, texts = ints(batch.column(0)), batch.column(1).to_pylist()
            places, hashes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out, size = [[], [], [], [], []], 0
            for k, t, ps, hs in zip(keys.tolist(), texts, places, hashes):
                for p, h in zip(ps, hs):
                    out[0].append(h), out[1].append(k), out[2].append(p)
                    out[3].append(t[max(0, p - reach) : p]), out[4].append(t[p : p + span])
                    size += 2 * span
                    if size > 1 << 24:
                        yield _context(out)
                        out, size = [[], [], [], [], []], 0
            yield _context(out)

    return run


def _context(columns) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "text_key", "pos", "before", "after"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    return int(d[0]) if len(d) else n


_LINK = "a bigint, b bigint, h bigint, back int, ahead int"


def _direct(span: int):
    def run(batches):
        """Links between different surroundings of one window: characters in
        common before its start and from its start on."""
        for (h,), t in sorted_groups(batches, 1):
            around = ints(t.column(1)).tolist()
            before = [np.frombuffer(x[::-1].encode("utf-32-le", "surrogatepass"), "<u4") for x in t.column(2).to_pylist()]
            after = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in t.column(3).to_pylist()]
            rows = []
            for i in range(len(around)):
                for j in range(i):
                    ahead = _common(after[i], after[j])
                    if ahead < span // SHARE:
                        continue
                    back = _common(before[i], before[j])
                    if back + ahead >= span:
                        rows.append((around[i], around[j], h, back, ahead))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "h", "back", "ahead"])

    return run


def _stretches(span: int):
    def run(batches):
        """All stretches of the span in each surroundings, by two hashes."""
        for batch in batches:
            if not batch.num_rows:
                continue
            h, around = ints(batch.column(0)), ints(batch.column(1))
            whole = [b + a for b, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            back = np.array([len(b) for b in batch.column(2).to_pylist()], np.int64)
            codes, starts = code_points(pa.array(whole, pa.string()))
            n = np.maximum(np.diff(starts) - span + 1, 0)
            letters = spread(codes)
            w, v = windows(letters, span), windows(letters ^ np.uint64(OTHER), span, OTHER)
            at = np.repeat(starts[:-1], n) + ranges(n)
            k = np.repeat(np.arange(len(n)), n)
            offset = (back[k] - ranges(n)).astype(np.int32)
            for s in range(0, len(at), 65536):
                t = slice(s, s + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(w[at[t]].view(np.int64)), pa.array(v[at[t]].view(np.int64)), pa.array(h[k[t]]), pa.array(around[k[t]]), pa.array(offset[t])], names=["w", "v", "h", "around", "back"])

    return run


def _key(again: list[int], digest: str = "digest") -> Column:
    """A text's 64-bit number; those in ``again`` name different texts, which
    get others."""
    key = F.xxhash64("text", F.length("text"))
    return F.when(key.isin(again), F.xxhash64(F.lit(len(again)), digest)).otherwise(key) if again else key


class Shared:
    """The shared spans of a set of documents (doc_id, text).

    ``class_pairs`` gives the pairs between different texts and ``membership``
    the rows of each; ``pairs`` writes out all pairs of rows, ``amounts`` gives
    one row per document with a share. Null texts and texts below the span
    share nothing. Repeated rows of a doc_id are one row.
    """

    def __init__(self, documents: DataFrame, span: int = SPAN):
        self.span = span
        rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") >= span)
        # numbers of texts that different texts share are replaced until there are none
        self.again: list[int] = []
        while True:
            self.members = materialise(rows.select("doc_id", _key(self.again, F.md5("text")).alias("text_key"), F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars")).distinct())
            clash = self.members.groupBy("text_key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("text_key").collect()
            if not clash:
                break
            discard(self.members)
            self.again += [r[0] for r in clash]
        keyed = rows.select("doc_id", "text", _key(self.again, F.md5("text")).alias("text_key"))
        anchors = materialise(keyed.select("text_key", "text").mapInArrow(_anchors(span), _ANCHOR))
        once = materialise(anchors.join(_repeated(anchors, ["h"]), "h").distinct())
        discard(anchors)
        sides = once.select("text_key", "pos", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("w")), F.struct(F.lit(1).alias("side"), F.col("right").alias("w")))).alias("s")).select("text_key", "pos", "h", "s.side", "s.w").where("w <> 0")
        alive = materialise(sides.join(_repeated(sides, ["side", "w"]), ["side", "w"]).select("text_key", "pos", "h").distinct())
        discard(once)
        places = alive.groupBy("text_key").agg(F.collect_list(F.struct("pos", "h")).alias("p")).select("text_key", F.col("p.pos").alias("pos"), F.col("p.h").alias("h"))
        # one copy of each text that has survivors
        if alive.count() * PLACE <= BROADCAST:
            found = keyed.select("text_key", "text").join(F.broadcast(places), "text_key")
        else:
            found = keyed.select("text_key", "text").join(places, "text_key")
        contexts = found.select("text_key", "text", "pos", "h").mapInArrow(_contexts(span), "h bigint, text_key bigint, pos int, before string, after string")
        contexts = contexts.where(F.length("before") + F.length("after") >= span).withColumn("around", F.xxhash64("h", "before", "after"))
        self.contexts = materialise(contexts.dropDuplicates(["text_key", "pos"]))
        discard(alive)
        kinds = self.contexts.groupBy("h", "around").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.max(F.length("before")).alias("back"), F.max(F.length("after")).alias("ahead"))
        self.kinds = materialise(kinds)
        counts = self.kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        some = self.kinds.select("h", "around", "before", "after").join(counts, "h")
        few = some.where(F.col("n") <= DIRECT).select("h", "around", "before", "after").repartition("h").sortWithinPartitions("h", "around").mapInArrow(_direct(span), _LINK)
        many = some.where(F.col("n") > DIRECT).select("h", "around", "before", "after").mapInArrow(_stretches(span), "w bigint, v bigint, h bigint, around bigint, back int")
        self.stretches = materialise(many)
        self.links = materialise(few)

    def representatives(self) -> DataFrame:
        """(text_key, doc_id): the row of least id with each text."""
        return self.members.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))

    def membership(self) -> DataFrame:
        """(doc_id, representative): every row of at least the span, with the
        row that stands for its text in ``class_pairs``."""
        return self.members.select("doc_id", "text_key").join(self.representatives().withColumnRenamed("doc_id", "representative"), "text_key").select("doc_id", "representative")

    def class_pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: representatives of different texts
        that share a span."""
        a, b = (self.representatives().select(F.col("text_key").alias(key), F.col("doc_id").alias(name)) for key, name in (("key_a", "x"), ("key_b", "y")))
        return self.classes().join(a, "key_a").join(b, "key_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def _nodes(self) -> DataFrame:
        return self.contexts.select("h", "around", "text_key").distinct()

    def classes(self) -> DataFrame:
        """(key_a, key_b): pairs of different texts that share a span."""
        nodes = self._nodes()
        same = self.kinds.where("lo <> hi").select("around", "h")
        left, right = nodes.select("h", F.col("around").alias("a"), F.col("text_key").alias("x")), nodes.select("h", F.col("around").alias("b"), F.col("text_key").alias("y"))
        links = self.links.select("h", "a", "b").unionByName(same.select("h", F.col("around").alias("a"), F.col("around").alias("b")))
        # hashed stretches: neighbouring ones have the same set of surroundings; one of them stands for all
        own = self.stretches.select("w", "v", "h", "around").distinct()
        groups = own.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.xxhash64(F.lit(k), "h", "around").cast("decimal(20,0)")).alias(f"sig{k}") for k in range(2))).where("n > 1")
        stand = groups.groupBy("n", "sig0", "sig1").agg(F.min(F.struct("w", "v")).alias("first")).select("first.w", "first.v")
        sets = own.join(stand, ["w", "v"])
        dense = sets.alias("p").join(sets.alias("q"), ["w", "v"]).where("p.around < q.around and p.h = q.h").select(F.col("p.h").alias("h"), F.col("p.around").alias("a"), F.col("q.around").alias("b")).distinct()
        found = links.unionByName(dense).join(left, ["h", "a"]).join(right, ["h", "b"]).where("x <> y")
        return found.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: rows that share a span."""
        m = self.members.select("doc_id", "text_key")
        copies = m.alias("p").join(m.alias("q"), "text_key").where("p.doc_id < q.doc_id").select(F.col("p.doc_id").alias("doc_a"), F.col("q.doc_id").alias("doc_b"))
        a, b = m.select(F.col("text_key").alias("key_a"), F.col("doc_id").alias("x")), m.select(F.col("text_key").alias("key_b"), F.col("doc_id").alias("y"))
        other = self.classes().join(a, "key_a").join(b, "key_b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
        return copies.unionByName(other).distinct()

    def amounts(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, copies): for every document with a
        share, how many of its characters lie in spans of 200 or more that also
        stand in another document, and how many other rows have its text."""
        texts = self.kinds.select("h", "around", "lo", "hi")
        ends = self.links.select("h", F.col("a").alias("mine"), F.col("b").alias("around"), "back", "ahead").unionByName(self.links.select("h", F.col("b").alias("mine"), F.col("a").alias("around"), "back", "ahead"))
        ext = ends.join(texts, ["h", "around"]).select("h", F.col("mine").alias("around"), "back", "ahead", "lo", "hi")
        ext = ext.unionByName(self.kinds.where("lo <> hi").select("h", "around", "back", "ahead", "lo", "hi"))
        s = self.stretches
        sides = s.join(texts, ["h", "around"]).groupBy("h", "w", "v").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
        ext = ext.unionByName(s.join(sides, ["h", "w", "v"]).select("h", "around", "back", (F.lit(self.span) - F.col("back")).alias("ahead"), "lo", "hi"))
        # lo and hi bound the texts on the other side: one of them is another text
        spans = self.contexts.select("h", "around", "text_key", "pos").join(ext, ["h", "around"]).where("lo <> text_key or hi <> text_key")
        spans = spans.select("text_key", (F.col("pos") - F.col("back")).alias("s"), (F.col("pos") + F.col("ahead")).alias("e"))
        from pyspark.sql import Window

        w = Window.partitionBy("text_key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        fresh = spans.distinct().withColumn("top", F.coalesce(F.max("e").over(w), F.lit(0)))
        covered = fresh.groupBy("text_key").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "top"))).alias("covered"))
        size = self.members.select("text_key", "doc_id", "n_chars")
        copies = size.groupBy("text_key").agg((F.count(F.lit(1)) - 1).alias("copies"))
        out = size.join(copies, "text_key").join(covered, "text_key", "left")
        out = out.select("doc_id", "n_chars", F.when(F.col("copies") > 0, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"), "copies")
        return out.where("shared_chars > 0")

    def sharing(self) -> DataFrame:
        """(text_key): texts that share a span with a different text."""
        pairs = self.classes()
        return pairs.select(F.col("key_a").alias("text_key")).union(pairs.select("key_b")).distinct()


def longest(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, shared): for every row with a share, the largest of
    ``span``, twice, four times the span and so on, such that a stretch of that
    length also stands in another row.

    The texts that survive one length, one row for each, are asked at twice
    the length, until none survives. Rows whose text has copies share all of
    it. Nulls, repeats and short texts as in ``Shared``.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first, levels, old = None, [], None
    while True:
        level = Shared(rows, span)
        survivors = materialise(level.representatives().join(level.sharing(), "text_key").select("doc_id"))
        if first is None:
            first = level
        levels.append(survivors.withColumn("shared", F.lit(span).cast("bigint")))
        if survivors.isEmpty():
            break
        # representatives of the first level stay the rows of their texts
        span *= 2
        rows = materialise(rows.join(survivors, "doc_id", "left_semi").where(F.length("text") >= span).dropDuplicates(["doc_id"]))
        if old is not None:
            discard(old)
        old = rows
    reached = reduce(DataFrame.unionByName, levels).groupBy("doc_id").agg(F.max("shared").alias("shared")).withColumnRenamed("doc_id", "representative")
    copies = first.members.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    out = first.members.select("doc_id", "text_key", "n_chars").join(copies, "text_key").join(first.membership(), "doc_id").join(reached, "representative", "left")
    whole = F.lit(first.span) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_chars") / first.span) + 1e-12))
    out = out.select("doc_id", "n_chars", F.when(F.col("copies") > 1, whole.cast("bigint")).otherwise(F.col("shared")).alias("shared"))
    return out.where("shared is not null")
