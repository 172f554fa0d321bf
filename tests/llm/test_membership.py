"""Problem 1 against a plain dictionary."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecquill.llm import cuckoo

REQ = "req_id bigint, index_name string, external_id string, extra int"
DEL = "req_id bigint, index_name string, external_ids array<string>, return_not_found boolean"


def truth(requests, deletes):
    first = {}
    for r, c, e, *_ in requests:
        if c is not None and e:
            first[c, e] = min(first.get((c, e), r), r)
    out = {(r, 0) for r, c, e, *_ in requests if c is not None and e and first[c, e] < r}
    for r, c, es, *_ in deletes:
        out |= {(r, p) for p, e in enumerate(es or []) if c is not None and e and first.get((c, e), r) < r}
    return out


def data(seed, n=3000):
    rng = np.random.default_rng(seed)
    ids = ["", None, "ä" * 300, "a", " a", "A", "á", "á", "\x01"] + [f"id{i}" for i in range(1500)]
    name = lambda: [None, "x", "y", "x y"][rng.integers(4)]
    pick = lambda: ids[3] if rng.random() < 0.33 else ids[rng.integers(len(ids))]
    order = rng.permutation(2 * n)
    requests = [(int(i), name(), pick(), 1) for i in order[:n]]
    deletes = [(int(i), name(), None if rng.random() < 0.05 else [pick() for _ in range(rng.integers(6))], None) for i in order[n : n + 400]]
    return requests + requests[::50], deletes + deletes[::50]


@pytest.mark.parametrize("keys", [cuckoo.KEYS, 100])
def test_seen_before(spark, keys):
    requests, deletes = data(keys % 7)
    a, b = spark.createDataFrame(requests, REQ).selectExpr("*", "1 as key", "true as is_add").repartition(3), spark.createDataFrame(deletes, DEL)
    got = sorted(tuple(r) for r in cuckoo.seen_before(a, b, keys).collect())
    assert got == sorted(truth(requests, deletes))
    report = cuckoo.audit(a, b, keys).first()
    assert report.repeats + report.answered_seen - report.wrong == len(got) and 0 <= report.wrong_rate < 0.01
    if keys == cuckoo.KEYS:  # no salted keys
        assert report.repeats + report.asked == report.events


@pytest.mark.parametrize("broadcast", [0, cuckoo.BROADCAST])
def test_waves_and_hot_deletes(spark, monkeypatch, broadcast):
    """Any number of waves, tables read back from files, and one id that holds
    most of the deleting events."""
    monkeypatch.setattr(cuckoo, "BROADCAST", broadcast)
    requests, deletes = data(3, 500)
    deletes += [(2000 + i, "x", ["id7", "a", "id7"] * 40, None) for i in range(30)]
    a, b = spark.createDataFrame(requests, REQ), spark.createDataFrame(deletes, DEL)
    wanted = truth(requests, deletes)
    for waves in (1, 3):
        found, asked = cuckoo._suspected(a, b, 200, waves)
        called = {(r.req_id, r.pos) for r in found.collect()}
        assert called >= wanted and asked.count() >= waves
        assert {(r.req_id, r.pos) for r in cuckoo.checked(a, b, found).where("seen").collect()} == wanted


def test_tables_survive_files():
    c = cuckoo.Cuckoo(16)
    keys = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 3000)
    c.add(keys)
    again = cuckoo.Cuckoo.load(c.dump())
    assert again.has(keys).all() and [t.entries for t in again.tables] == [t.entries for t in c.tables] and again.stash == c.stash
    assert all(again.remove(int(k)) for k in keys) and sum(t.entries for t in again.tables) == 0


def test_empty(spark):
    requests, deletes = data(1, 100)
    a, b = spark.createDataFrame(requests, REQ), spark.createDataFrame(deletes, DEL)
    assert cuckoo.seen_before(a.limit(0), b.limit(0)).count() == 0
    assert cuckoo.seen_before(a.limit(0), b).count() == 0
    assert {tuple(r) for r in cuckoo.seen_before(a, b.limit(0)).collect()} == truth(requests, [])
    assert cuckoo.audit(a.limit(0), b.limit(0)).first().wrong_rate == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=300), st.integers(1, 50))
def test_replay(events, step):
    keys, adds = np.array([k for k, _ in events], np.int64), np.array([a for _, a in events], bool)
    got = cuckoo.seen_in_order(keys, adds, cuckoo.Cuckoo(8), step)
    seen = set()
    for k, a, hit in zip(keys.tolist(), adds.tolist(), got.tolist()):
        assert hit or k not in seen
        if a:
            seen.add(k)


def test_growth_never_forgets():
    c = cuckoo.Cuckoo(64)
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    for s in range(0, len(keys), 1000):
        c.add(keys[s : s + 1000])
        assert c.has(keys[: s + 1000]).all()
    assert len(c.tables) > 3
    other = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50_000)
    assert c.has(other).mean() < 0.01


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.booleans()), max_size=400))
def test_removal(steps):
    """Removing keys that are in never loses another."""
    c, inside = cuckoo.Cuckoo(16), []
    for key, add in steps:
        if add:
            c.add(np.array([key]))
            inside.append(key)
        elif key in inside:
            assert c.remove(key)
            inside.remove(key)
        if inside:
            assert c.has(np.array(inside)).all()
    for key in list(inside):
        assert c.remove(key)
    assert sum(t.entries for t in c.tables) == 0 and not c.stash
