"""Problems 6 to 8 against brute force."""

import re

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecquill.llm import containers, leakage, spans
from vecquill.llm.texts import spread, windows

TEXT = "doc_id bigint, text string"


def words(rng, n, of=400):
    return " ".join(f"{'aeiouбé漢'[w % 8]}{w}" for w in rng.integers(0, of, n))


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=1, max_size=80), st.integers(1, 60))
def test_window_hashes(text, n):
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = windows(spread(codes), n)
    parts = [text[i : i + n] for i in range(len(text) - n + 1)]
    assert len(h) == len(parts)
    assert len(set(h.tolist())) == len(set(parts))
    assert len(set(zip(h.tolist(), parts))) == len(set(parts))


# 6


def test_tokens(spark):
    texts = [None, "", "a b_1  c\n", "x+y=é漢😀", " \t\r\n", "__"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(containers.tokens(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]", t or "")) for t in texts]


@pytest.mark.parametrize("shard", [1024, 60])
def test_packing(spark, shard):
    rng = np.random.default_rng(0)
    sizes = np.r_[rng.integers(0, 900, 300), [0, 0, 2048, 2049, 4096, 4097, 10_000, 2047], rng.integers(1000, 1100, 40)]
    df = spark.createDataFrame([(int(i), int(s)) for i, s in enumerate(sizes)] + [(7, int(sizes[7]))], "doc_id bigint, size bigint").selectExpr("*", "1 as shard", "2 as rest")
    rows = containers.pack(df, shard=shard).collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == sorted([*range(len(sizes)), 7])
    for i, s in enumerate(sizes.tolist()):
        pieces = sorted((r.piece, r["size"]) for r in rows if r.doc_id == i)
        if s > 2048:
            assert pieces == [(p, min(2048, s - 2048 * p)) for p in range(-(-s // 2048))]
        elif i != 7:
            assert pieces == [(0, s)]
    room = {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r["size"]
    assert max(room.values()) <= 2048
    report = containers.report(containers.pack(df, shard=shard)).first()
    assert report.containers == len(room) and report.filled > 0.9 and report.containers >= report.least
    assert {r.doc_id for r in containers.split(containers.pack(df)).collect()} == {i for i, s in enumerate(sizes.tolist()) if s > 2048}
    again = containers.pack(df, shard=shard).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))  # the same on every run


def test_packing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, size bigint")
    assert containers.pack(df).count() == 0 and containers.report(containers.pack(df)).first().containers == 0
    zero = spark.createDataFrame([(1, 0)], "doc_id bigint, size bigint")
    assert containers.pack(zero).count() == 1


def test_children_are_valid_and_better():
    rng = np.random.default_rng(3)
    sizes = rng.integers(600, 1100, 120)  # two or three to a container: best fit alone does poorly
    first = containers.evolve(sizes, np.zeros((0, 120), np.int32), None, 2048, (1,), 6, 0)
    pop = first
    for n in range(8):
        pop = containers.evolve(sizes, pop, pop[0], 2048, (2, n), 6, 60)
        for row in pop:
            assert np.bincount(row, sizes).max() <= 2048
    best = lambda p: containers.unpack(p[0], sizes.tolist(), 2048).score
    assert best(pop) < best(first)


def test_tokenizer_sizes(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "<|endoftext|>")], TEXT)
    got = {r.doc_id: r["size"] for r in containers.tokenizer_sizes(df, path).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] > 1


# 7


def runs(text, n):
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def leak_data(seed):
    rng = np.random.default_rng(seed)
    opening = words(rng, 9)
    items = [(i, f"{opening}. {words(rng, 30)}" if i % 3 else words(rng, 14)) for i in range(25)]
    items += [(50, "a b c d e f g h i j k"), (51, "one two three"), (52, ""), (53, None), (54, " ".join("x" * 12)), (55, "ÄÖ ß Σίσυφος İ " + words(rng, 12))]
    docs = [(i, words(rng, int(rng.integers(5, 200)))) for i in range(120)]
    for d in range(0, 120, 2):
        w = (items[rng.integers(25)][1]).split()
        n = int(rng.integers(8, 15))
        s = int(rng.integers(0, max(1, len(w) - n)))
        part = f" {',- '[d % 3]} ".join(w[s : s + n])
        docs[d] = (d, f"{docs[d][1][:150]} {part.upper() if d % 4 else part}!{docs[d][1]}")
    docs += [(200, None), (201, ""), (202, "A-B c;d\ne f  g h.i j k"), (203, "xa b c d e f g h i jx"), (204, "b c d e f g h i j k"), (205, " ".join("x" * 5000)), (206, items[-1][1].upper() + " tail"), (207, "a b c d e f g h i jk")]
    return docs + docs[:5], items + items[:2]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_leaks(spark, seed):
    docs, items = leak_data(seed)
    d, i = spark.createDataFrame(docs, TEXT).selectExpr("*", "1 as item_id", "2 as t"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(tuple(r) for r in leakage.leaks(d, i).collect())
    truth = sorted({(a, b) for a, t in docs for b, u in items if t and u and runs(t, 10) & runs(u, 10)})
    assert got == truth and (202, 50) in got and (204, 50) in got and (203, 50) not in got


def test_leaks_in_blocks(spark, monkeypatch):
    docs, items = leak_data(5)
    d, i = spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(tuple(r) for r in leakage.leaks(d, i).collect())
    monkeypatch.setattr(leakage, "BLOCK", 600)
    assert sorted(tuple(r) for r in leakage.leaks(d, i).collect()) == whole
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_altered_passages(spark):
    rng = np.random.default_rng(4)
    item = words(rng, 25)
    cut = item[10:110]
    wrong = cut[:40] + "#" + cut[42:70] + cut[71:]  # normalised, this is two edits
    two = cut[:30] + "q" + cut[31:60] + cut[61:]
    five = "".join(c if n % 12 else "q" for n, c in enumerate(cut))
    docs = [(1, f"{words(rng, 30)} {two} {words(rng, 30)}"), (2, words(rng, 90)), (3, f"{words(rng, 9)} {item}"), (4, five), (5, wrong)]
    got = {r.doc_id for r in leakage.passages(spark.createDataFrame(docs, TEXT), spark.createDataFrame([(9, item)], "item_id bigint, text string"), edits=2).collect()}
    assert {1, 3} <= got and not got & {2, 4}


def edits_between(item, doc, length, most):
    """Least edits of any stretch of `length` letters of the item in the document."""
    best = most + 1
    for s in range(len(item) - length + 1):
        part = item[s : s + length]
        row = np.zeros(len(doc) + 1, int)  # may begin anywhere
        for c in part:
            new = np.empty_like(row)
            new[0] = row[0] + 1
            for j in range(1, len(doc) + 1):
                new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (doc[j - 1] != c))
            row = new
        best = min(best, int(row.min()))
    return best


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_passages_against_brute_force(spark, edits):
    """Every stretch with few enough edits is found, and nothing else."""
    rng = np.random.default_rng(edits)
    items = [" ".join(words(rng, 12, 50).split()) for _ in range(4)]
    docs = []
    for n in range(48):
        part = list(items[n % 4][int(rng.integers(0, 6)) :])
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(part)))
            part[at : at + int(rng.integers(0, 2))] = ["", "q", "é"][int(rng.integers(3))]
        docs.append(" ".join(f"{words(rng, 2)} {''.join(part)} {words(rng, 2)}".split()))
    frames = spark.createDataFrame(list(enumerate(docs)), TEXT), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {tuple(r) for r in leakage._search(*frames, 5, edits).collect()}
    codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in items]
    if edits:
        wanted = {(d, i) for d, t in enumerate(docs) for i, u in enumerate(items) if edits_between(u, t, leakage._shortest(codes[i], 5), edits) <= edits}
    else:
        wanted = {(d, i) for d, t in enumerate(docs) for i, u in enumerate(items) if runs(t, 5) & runs(u, 5)}
    assert got == wanted and 4 < len(wanted) < 4 * len(docs)


def test_bands_in_pieces():
    """Pieces of any size give the bands of the whole text."""
    rng = np.random.default_rng(0)
    item = "".join(rng.choice(list("abc "), 60))
    text = "".join(rng.choice(list("abc "), 300)) + item + "".join(rng.choice(list("abc "), 900)) + item[5:50] + "ab " * 400
    index = leakage.build([1], [item + " ab ab ab ab ab ab"], 4, 1)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.array([0, 200, len(codes)])
    whole = leakage.bands(index, spread(codes), codes, starts, 1, piece=1 << 20)
    parts = leakage.bands(index, spread(codes), codes, starts, 1, hits_at_once=50, piece=1)
    assert len(whole) and {tuple(r[:4]) for r in parts.tolist()} <= {tuple(r[:4]) for r in whole.tolist()}
    flat, edges = index.codes[0], np.array([0, len(index.codes[0])])
    verified = [{(d, i) for (d, i, *_), ok in zip(f.tolist(), leakage.aligned(codes, starts, flat, edges, f, 1, index.length[f[:, 1]])) if ok} for f in (whole, parts)]
    assert verified[0] == verified[1] and (1, 0) in verified[0]


@settings(max_examples=40, deadline=None)
@given(st.text("ab ", min_size=12, max_size=20), st.text("ab ", min_size=12, max_size=30), st.integers(0, 2))
def test_banded_alignment(item, doc, edits):
    a, b = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (item, doc))
    band = np.array([[0, 0, -len(item), len(doc), 0, len(doc)]] * 2)
    wide = leakage.aligned(b, np.array([0, len(b)]), a, np.array([0, len(a)]), band, edits, np.array([8, 8]))
    assert wide[0] == wide[1] == (edits_between(item, doc, 8, edits) <= edits)


# 8


def span_data(seed):
    rng = np.random.default_rng(seed)
    letters = lambda n: "".join(rng.choice(list("abcdefgh éß漢😀\n"), n))
    docs = [letters(int(rng.integers(0, 900))) for _ in range(60)]
    for _ in range(50):
        a, b = rng.integers(0, 60, 2)
        n = int(rng.choice([150, 190, 199, 200, 201, 230, 400, 700]))
        piece = docs[a][: n + 40][-n:]
        at = int(rng.integers(0, len(docs[b]) + 1))
        docs[b] = docs[b][:at] + piece + docs[b][at:]
    plate = letters(220)
    for b in range(40):  # many different surroundings of one stretch, some of it too short
        docs.append(letters(60) + (plate if b % 2 else plate[:195]) + letters(60))
    docs += [letters(300)] * 3 + ["-" * 450, "=" * 20 + "-" * 260, "-" * 199, "", "ab" * 150, "ba" * 150 + "c"]
    rows = list(enumerate(docs)) + [(900, None)]
    return rows + rows[:4]


def true_spans(rows):
    where = {}
    for d, t in dict(rows).items():
        for i in range(len(t or "") - 199):
            where.setdefault(t[i : i + 200], []).append((d, i))
    pairs, covered = set(), {}
    for at in where.values():
        ds = sorted({d for d, _ in at})
        if len(ds) > 1:
            pairs |= {(a, b) for n, a in enumerate(ds) for b in ds[n + 1 :]}
            for d, i in at:
                covered.setdefault(d, set()).update(range(i, i + 200))
    return pairs, {d: len(c) for d, c in covered.items()}


@pytest.mark.parametrize("seed,direct", [(0, 24), (1, 2), (2, 100)])
def test_shared_spans(spark, monkeypatch, seed, direct):
    monkeypatch.setattr(spans, "DIRECT", direct)
    rows = span_data(seed)
    df = spark.createDataFrame(rows, TEXT).selectExpr("*", "1 as h", "2 as text_key", "3 as pos").repartition(3)
    pairs, covered = true_spans(rows)
    shared = spans.Shared(df)
    assert sorted(tuple(r) for r in shared.pairs().collect()) == sorted(pairs)
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in shared.amounts().collect()}
    texts = dict(rows)
    assert got == {d: (len(texts[d]), n) for d, n in covered.items()}


def true_longest(rows):
    """By spans of 200, 400 and so on in different rows."""
    texts, out, n = {d: t for d, t in rows if len(t or "") >= 200}, {}, 200
    while True:
        where = {}
        for d, t in texts.items():
            for i in range(len(t) - n + 1):
                where.setdefault(hash(t[i : i + n]), set()).add(d)
        found = {d for ds in where.values() if len(ds) > 1 for d in ds}
        if not found:
            return out
        out.update({d: (len(texts[d]), n) for d in found})
        n *= 2


def test_longest_and_classes(spark, monkeypatch):
    rows = span_data(4)
    rng = np.random.default_rng(8)
    long = "".join(rng.choice(list("abcdefgh"), 2500))
    rows += [(300, long), (301, long[100:1000] + "x"), (302, "y" + long[700:2400]), (303, long), (304, long[:399])]
    df = spark.createDataFrame(rows, TEXT)
    assert {r.doc_id: (r.n_chars, r.shared) for r in spans.longest(df).collect()} == true_longest(rows)
    shared = spans.Shared(df)
    stands = {}
    for d, t in sorted((d, t) for d, t in set(rows) if len(t or "") >= 200):
        stands.setdefault(t, d)
    assert {tuple(r) for r in shared.membership().collect()} == {(d, stands[t]) for d, t in rows if len(t or "") >= 200}
    first = set(stands.values())
    assert sorted(map(tuple, shared.class_pairs().collect())) == sorted((a, b) for a, b in true_spans(rows)[0] if a in first and b in first)
    # texts with one number are told apart
    monkeypatch.setattr(spans, "_key", lambda again, digest: F.when(F.lit(bool(again)), F.xxhash64(F.lit(9), digest)).otherwise(F.lit(5).cast("bigint")))
    assert sorted(map(tuple, spans.Shared(df).pairs().collect())) == sorted(true_spans(rows)[0])


def test_spans_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST", 0)
    rows = span_data(3)
    assert sorted(tuple(r) for r in spans.Shared(spark.createDataFrame(rows, TEXT)).pairs().collect()) == sorted(true_spans(rows)[0])


def test_spans_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short")]):
        shared = spans.Shared(spark.createDataFrame(rows, TEXT))
        assert shared.pairs().count() == 0 and shared.amounts().count() == 0 and shared.class_pairs().count() == 0 and spans.longest(spark.createDataFrame(rows, TEXT)).count() == 0
