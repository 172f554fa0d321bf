"""Problem 7: evaluation texts in training texts, by q-gram lemma filtering.

Texts are compared as their words in lower case with one space between them.
If a stretch of ``w`` characters of an item occurs in a document with up to
``e`` edits, the two share at least ``w + 1 - q (e + 1)`` q-grams whose
diagonals (position in the document less position in the item) differ by at
most ``e``. So q-grams of the document are looked up among the items', hits
are counted per document, item and band of diagonals - bands are ``2 B`` wide
and overlap by half, with ``B > e``, so that every such stretch lies in one -
and bands that meet the bound are verified by alignment within the band.

``leaks`` asks for ``words`` consecutive words without an edit, and checks that
what aligns are whole words; ``passages`` allows edits. The items' index is broadcast in blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ints
from .texts import code_points, ranges, slices, spread, windows

#: Characters of item text in one broadcast block.
BLOCK = 8_000_000
SPACE = 32


def normal(text: Column) -> Column:
    """Words (maximal runs of letters and digits, lower case) with one space
    between them; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@dataclass
class Index:
    """q-grams of a block of items: for each q the sorted hashes with item and
    position, a bitmap over 24 bits of the hash, and the items' codes."""

    ids: np.ndarray
    codes: list[np.ndarray]
    bound: np.ndarray  # shared q-grams that a band must have
    length: np.ndarray  # characters of the stretch that the bound is for
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    bits: dict[int, np.ndarray]


def _word_starts(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero((codes != SPACE) & np.r_[True, codes[:-1] == SPACE])


def _word_ends(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero((codes != SPACE) & np.r_[codes[1:] == SPACE, True]) + 1


def _shortest(codes: np.ndarray, words: int) -> int:
    """Characters of the shortest run of ``words`` words; 0 if there is none."""
    s, e = _word_starts(codes), _word_ends(codes)
    return int((e[words - 1 :] - s[: len(s) - words + 1]).min()) if len(s) >= words else 0


def build(ids: list[int], texts: list[str], words: int, edits: int) -> Index:
    """Per item q is the largest of 32, 16, 8 that leaves a bound of at least
    one q-gram; items too short for any run are left out. With runs of single
    letters q is smaller, at last 1."""
    kept, codes, bound, length, by_q = [], [], [], [], {}
    for i, t in zip(ids, texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        w = _shortest(c, words)
        if not w:
            continue
        q = next((q for q in (32, 16, 8, 4, 2) if w + 1 - q * (edits + 1) >= 1), 1)
        by_q.setdefault(q, []).append(len(kept))
        kept.append(i), codes.append(c), length.append(w), bound.append(max(1, w + 1 - q * (edits + 1)))
    grams, bits = {}, {}
    for q, members in by_q.items():
        h = [windows(spread(codes[m]), q) for m in members]
        item = np.repeat(np.array(members), [len(x) for x in h])
        pos = np.concatenate([np.arange(len(x)) for x in h])
        h = np.concatenate(h)
        order = np.argsort(h, kind="stable")
        grams[q] = h[order], item[order], pos[order]
        bits[q] = np.zeros(1 << 21, np.uint8)
        at = h >> np.uint64(40)
        np.bitwise_or.at(bits[q], (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    return Index(np.array(kept, np.int64), codes, np.array(bound, np.int64), np.array(length, np.int64), grams, bits)


def bands(index: Index, letters: np.ndarray, codes: np.ndarray, starts: np.ndarray, edits: int, hits_at_once: int = 1 << 22, piece: int = 4096):
    """(document, item, lower diagonal, upper diagonal, first and last position
    of a shared q-gram in the document, with q added) of each band that meets
    its bound.

    Documents are counted in pieces of ``piece`` positions that overlap by the
    longest stretch asked for, so that every stretch lies in one, and a long
    text that repeats itself is never held with all its hits."""
    width = edits + 1
    wide = 2 * width
    reach = int(index.length.max(initial=0)) + edits
    piece = max(piece, 4 * reach)
    out = []
    for q, (hashes, items, places) in index.grams.items():
        h = windows(letters, q)
        at = h >> np.uint64(40)
        maybe = np.flatnonzero(index.bits[q][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        low = np.searchsorted(hashes, h[maybe], "left")
        many = np.searchsorted(hashes, h[maybe], "right") - low
        doc = np.searchsorted(starts, maybe, "right") - 1
        many[(maybe + q > starts[doc + 1])] = 0
        ok = many > 0
        maybe, low, many, doc = maybe[ok], low[ok], many[ok], doc[ok]
        if not len(maybe):
            continue
        number = (maybe - starts[doc]) // piece
        begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])
        end = np.minimum(starts[doc[begin] + 1], starts[doc[begin]] + (number[begin] + 1) * piece + reach)
        end = np.searchsorted(maybe, end)
        total = np.r_[0, np.cumsum(many)]
        hits = np.cumsum(total[end] - total[begin])
        k = 0
        while k < len(begin):
            z = max(k + 1, int(np.searchsorted(hits, (hits[k - 1] if k else 0) + hits_at_once, "right")))
            n = end[k:z] - begin[k:z]
            at = np.repeat(begin[k:z], n) + ranges(n)
            group = np.repeat(np.arange(k, z), n)
            n = many[at]
            at, group = np.repeat(at, n), np.repeat(group, n)
            entry = low[at] + ranges(n)
            where = maybe[at] - starts[doc[at]]
            i, diagonal = items[entry], where - places[entry]
            for shift in (0, width):
                band = (diagonal - shift) // wide
                order = np.lexsort((where, band, i, group))
                gg, ii, bb, ww = group[order], i[order], band[order], where[order]
                edge = np.flatnonzero(np.r_[True, (gg[1:] != gg[:-1]) | (ii[1:] != ii[:-1]) | (bb[1:] != bb[:-1])])
                last = np.r_[edge[1:], len(gg)] - 1
                good = (last - edge + 1) >= index.bound[ii[edge]]
                e, y = edge[good], last[good]
                out.append(np.stack([doc[begin[gg[e]]], ii[e], bb[e] * wide + shift, bb[e] * wide + shift + wide - 1, ww[e], ww[y] + q], 1))
            k = z
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 6), np.int64)


def run_of_words(doc: np.ndarray, item: np.ndarray, diagonal: int, words: int) -> bool:
    """Whether ``words`` whole consecutive words of both texts are equal at
    this diagonal (position in the document less position in the item)."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return False
    a, b = item[lo:hi], doc[lo + diagonal : hi + diagonal]
    same = a == b
    # words of the item with equal characters and word ends on both sides
    s, e = _word_starts(item), _word_ends(item)
    inside = (s >= lo) & (e <= hi)
    bad = np.cumsum(np.r_[0, ~same])
    si, ei = s[inside], e[inside]
    if len(si) < words:
        return False
    left = (si + diagonal == 0) | (doc[np.maximum(si + diagonal - 1, 0)] == SPACE)
    right = (ei + diagonal == len(doc)) | (doc[np.minimum(ei + diagonal, len(doc) - 1)] == SPACE)
    good = (bad[ei - lo] == bad[si - lo]) & left & right
    run = np.cumsum(np.r_[0, good])
    return bool((run[words:] - run[:-words] == words).any())


def aligned(docs: np.ndarray, starts: np.ndarray, items: np.ndarray, item_starts: np.ndarray, found: np.ndarray, edits: int, length: np.ndarray) -> np.ndarray:
    """Banded alignment of all rows (document, item, lower and upper diagonal,
    first and last place) at once: whether ``length`` characters of the item
    align with a stretch of the document with at most ``edits`` edits, on
    diagonals from ``lower - edits`` to ``upper + edits``."""
    out = np.zeros(len(found), bool)
    if not len(found):
        return out
    doc, item, low, high, first, last = found.T
    d0 = low - edits
    wide = int((high - low).max()) + 2 * edits + 1
    begin = np.maximum(0, first - high - length)
    end = np.minimum(item_starts[item + 1] - item_starts[item], last - low + length)
    big = 1 << 30
    ks = np.arange(wide)[None]
    live = np.arange(len(found))
    # start[e]: least item position from which a path with e edits reaches each diagonal here
    start = np.full((edits + 1, len(found), wide), big)
    size = starts[doc + 1] - starts[doc]
    for t in range(int((end - begin).max(initial=0))):
        keep = (begin[live] + t < end[live]) & ~out[live]
        if not keep.all():
            live, start = live[keep], start[:, keep]
        if not len(live):
            break
        i = (begin[live] + t)[:, None]
        j = i + d0[live][:, None] + ks
        inside = (j >= 0) & (j < size[live][:, None])
        hit = inside & (docs[np.where(inside, starts[doc[live]][:, None] + j, 0)] == items[item_starts[item[live]][:, None] + i])
        new = np.empty_like(start)
        for e in range(edits + 1):
            took = np.where(hit, np.minimum(start[e], i), big)  # a path may begin here
            if e:
                before = np.minimum(start[e - 1], i)
                np.minimum(took, before, out=took)  # substitution
                np.minimum(took[:, :-1], before[:, 1:], out=took[:, :-1])  # item character missing in the document
                np.minimum(took[:, 1:], new[e - 1][:, :-1], out=took[:, 1:])  # document character missing in the item
            new[e] = took
            out[live[i[:, 0] + 1 - took.min(1) >= length[live]]] = True
        start = new
    return out


def _scan(shared, words: int, edits: int):
    def run(batches):
        index = shared.value
        edges = np.r_[0, np.cumsum([len(c) for c in index.codes])].astype(np.int64)
        flat = np.concatenate([*index.codes, np.zeros(0, np.uint32)])
        for batch in batches:
            for part in slices(batch, 1):
                ids = ints(part.column(0))
                codes, starts = code_points(part.column(1))
                found = bands(index, spread(codes), codes, starts, edits)
                hit = np.concatenate([np.zeros(0, int)] + [s + np.flatnonzero(aligned(codes, starts, flat, edges, found[s : s + 8192], edits, index.length[found[s : s + 8192, 1]])) for s in range(0, len(found), 8192)])
                if not edits:  # equal letters may still begin or end within a word
                    hit = [n for n, (d, i, lo, hi, _, _) in zip(hit.tolist(), found[hit].tolist()) if any(run_of_words(codes[starts[d] : starts[d + 1]], index.codes[i], at, words) for at in range(lo, hi + 1))]
                got = np.unique(found[hit][:, :2], axis=0) if len(hit) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[got[:, 0]]), pa.array(index.ids[got[:, 1]])], names=["doc_id", "item_id"])

    return run


def _search(documents: DataFrame, items: DataFrame, words: int, edits: int) -> DataFrame:
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), normal(F.col("text")).alias("t")).where("t <> ''")
    # items are few by nature; blocks bound what is collected and broadcast at once
    normed = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), normal(F.col("text")).alias("t")).where("t <> ''").distinct()
    size = normed.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 if size <= BLOCK else -(-size // (BLOCK // 2))
    out = None
    for b in range(blocks):
        rows = normed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "t").toArrow()
        index = build(rows.column(0).to_pylist(), rows.column(1).to_pylist(), words, edits)
        shared = documents.sparkSession.sparkContext.broadcast(index)
        part = docs.mapInArrow(_scan(shared, words, edits), "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leaks(documents: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """(doc_id, item_id): documents with ``words`` consecutive words of an
    item. Null and empty texts have none; rows that come twice count once."""
    return _search(documents, items, words, 0)


def passages(documents: DataFrame, items: DataFrame, words: int = 10, edits: int = 2) -> DataFrame:
    """(doc_id, item_id): documents with a stretch of the item that is as long
    as its shortest run of ``words`` words, up to ``edits`` edits in it. Nulls
    and repeats as in ``leaks``."""
    return _search(documents, items, words, edits)
