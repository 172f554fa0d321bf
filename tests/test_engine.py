import threading

import numpy as np
import pytest

from vecquill import IndexCatalog, VectorEngine, queries
from vecquill.plans.store import Conflict, Store
from vecquill.sources import files
from vecquill.streaming.upserts import last_per_id, stream_into

DIM = 8
X = np.random.default_rng(0).standard_normal((60, DIM))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "deep" / "index")


def engine(spark, path, n=10, **options):
    e = VectorEngine(spark, path, DIM, **options)
    put(e, "build", {f"id{i}": X[i] for i in range(n)})
    return e


def put(e, mode, rows, **options):
    e.init(mode)
    for i, v in rows.items():
        e.ingest(i, v)
    e.finalize(**options)


def test_build_then_insert(spark, path):
    e = VectorEngine(spark, path, 2)
    rows = np.random.default_rng(3).standard_normal((10, 2))
    put(e, "build", {str(i): rows[i] for i in range(5)})
    put(e, "insert", {f"{i}x": rows[5 + i] for i in range(5)})
    assert set(e.search(rows[0], 10)) == {str(i) for i in range(5)} | {f"{i}x" for i in range(5)}
    assert (e.main_size, e.delta_size) == (5, 5)


def test_parameters(spark, path):
    for ratio in (0, -1, 0.6):
        with pytest.raises(ValueError, match="delta_ratio"):
            VectorEngine(spark, path, DIM, delta_ratio=ratio)
    with pytest.raises(ValueError, match="dim must be"):
        VectorEngine(spark, path)
    e = engine(spark, path, 3)
    for k in (0, -1):
        with pytest.raises(ValueError):
            e.search(X[0], k)
    with pytest.raises(ValueError):
        e.search(X[0], 1, efs=0)
    assert e.search(X[1], 100) == e.search(X[1], 3)


def test_states(spark, path):
    e = VectorEngine(spark, path, DIM)
    assert e.search(X[0]) == [] and not e.has_index and not e.needs_rebuild()
    e.optimize_graph()
    with pytest.raises(RuntimeError, match="call init"):
        e.ingest("a", X[0])
    with pytest.raises(RuntimeError, match="no pending"):
        e.finalize()
    with pytest.raises(RuntimeError, match="mode must be"):
        e.init("merge")
    for mode in ("insert", "upsert"):
        with pytest.raises(RuntimeError, match="No index loaded"):
            put(e, mode, {"a": X[0]})
    for call in (lambda: e.delete_items(["a"]), e.rebuild_compact):
        with pytest.raises(RuntimeError, match="No index loaded"):
            call()
    with pytest.raises(RuntimeError, match="empty dataset"):
        put(e, "build", {})
    e.init("build")
    e.ingest("lost", X[0])
    with pytest.raises(RuntimeError, match="pending"):
        e.optimize_graph()
    e.init("build")  # begins again
    e.ingest("kept", X[1])
    e.finalize()
    assert e.search(X[0]) == ["kept"]


@pytest.mark.parametrize("value", [np.nan, np.inf, -np.inf, 2e16])
def test_values_out_of_range(spark, path, value):
    e = VectorEngine(spark, path, DIM)
    e.init("build")
    v = X[0].copy()
    v[5] = value
    with pytest.raises(RuntimeError, match="index 5"):
        e.ingest("a", v)


def test_shapes(spark, path):
    e = engine(spark, path, 2)
    e.init("insert")
    for bad, text in ((X[0][:4], "ingest: dimension"), (X[:2], "vec must be 1-D")):
        with pytest.raises(RuntimeError, match=text):
            e.ingest("a", bad)
    for bad, text in ((X[0][:4], "search: dimension"), (X[:2], "q must be 1-D")):
        with pytest.raises(RuntimeError, match=text):
            e.search(bad)
    assert e.search(X[1].astype(np.float64), 1) == e.search([float(x) for x in X[1]], 1) == ["id1"]


def test_odd_ids(spark, path):
    ids = ["", "x" * 10_000, "new\nline", "tab\t", "q\"uote'", "/a\\b", "日本語", "😀", "\x01", "None"]
    e = VectorEngine(spark, path, DIM)
    put(e, "build", {i: X[n] for n, i in enumerate(ids)})
    assert set(e.search(X[0], 20)) == set(ids)
    assert [e.search(X[n], 1) for n in range(len(ids))] == [[i] for i in ids]


def test_duplicates(spark, path):
    e = VectorEngine(spark, path, DIM)
    for mode in ("build",):
        e.init(mode)
        e.ingest("same", X[0])
        e.ingest("same", X[1])
        with pytest.raises(RuntimeError, match="duplicate external id: same"):
            e.finalize()
    e = engine(spark, path, 3)
    for mode in ("insert", "upsert"):  # a failed upsert loses nothing
        e.init(mode)
        e.ingest("id1", X[5])
        e.ingest("id1", X[6])
        with pytest.raises(RuntimeError, match="duplicate"):
            e.finalize()
    with pytest.raises(RuntimeError, match="duplicate external id: id2"):
        put(e, "insert", {"id2": X[7]})
    put(e, "insert", {"new": X[7]})
    with pytest.raises(RuntimeError, match="duplicate external id: new"):
        put(e, "insert", {"new": X[8]})
    assert set(e.search(X[0], 9)) == {"id0", "id1", "id2", "new"}


def test_deletes(spark, path):
    e = engine(spark, path)
    assert e.delete_items(["no1", "no2", "no1"], True) == (0, ["no1", "no2", "no1"])
    assert e.delete_items([]) == (0, None) and e.delete_items([], True) == (0, [])
    assert e.delete_items(["id1", "id3", "id1"]) == (2, None)
    assert e.delete_items(["id1"], True) == (0, [])  # deleted, yet known
    assert set(e.search(X[1], 20)) == {f"id{i}" for i in range(10)} - {"id1", "id3"}
    assert e.deletes_since_build() == 2 and e.needs_rebuild()
    e.rebuild_compact()
    assert e.delete_items(["id1"], True) == (0, ["id1"]) and e.deletes_since_build() == 0
    put(e, "insert", {"id1": X[1], "d": X[20]})
    assert e.delete_items(["d"], True) == (1, []) and e.delete_items(["d"], True) == (0, [])
    put(e, "insert", {"d2": X[21]})  # rebuilds the delta's view of the past
    assert e.delete_items(["d"], True) == (0, ["d"])
    assert e.delete_items([f"id{i}" for i in range(10)] + ["d2"])[0] == 10
    assert e.search(X[0]) == [] and not e.needs_rebuild()
    with pytest.raises(RuntimeError, match="empty dataset"):
        e.rebuild_compact()


def test_upsert(spark, path):
    e = VectorEngine(spark, path, DIM)
    put(e, "build", {"id1": np.ones(DIM)})
    put(e, "upsert", {"id1": np.full(DIM, 2.0)})
    assert e.search(np.full(DIM, 2.0), 5) == ["id1"]
    assert (e.main_size, e.delta_size) == (1, 0)  # no live row was left in main
    put(e, "upsert", {"id1": np.full(DIM, 3.0), "id2": np.full(DIM, 4.0)})
    put(e, "upsert", {"id2": np.full(DIM, 9.0)})
    assert e.search(np.full(DIM, 4.0), 5) == ["id1", "id2"]


def test_optimize(spark, path):
    e = engine(spark, path, 50, delta_ratio=0.2)
    put(e, "insert", {f"a{i}": X[i] + 1 for i in range(10)}, optimize=True)
    assert (e.main_size, e.delta_size) == (50, 10)  # 10 is not above the threshold
    put(e, "insert", {"b": X[50]}, optimize=True)
    assert (e.main_size, e.delta_size) == (61, 0)
    put(e, "insert", {f"c{i}": X[i] + 2 for i in range(20)})
    before = e.search(X[3], 81)
    assert e.needs_rebuild()
    e.optimize_graph()
    assert (e.main_size, e.delta_size) == (81, 0) and e.search(X[3], 81) == before
    version = e.version
    e.optimize_graph()
    assert e.version == version


def test_reopen_close_destroy(spark, path):
    e = engine(spark, path)
    answer = e.search(X[4], 10)
    e.close()
    assert e.search(X[4], 10) == [] and not e.has_index
    again = VectorEngine(spark, path, 3)  # the files' dim holds
    assert again.dim == DIM and again.search(X[4], 10) == answer
    again.destroy()
    fresh = VectorEngine(spark, path, DIM)
    assert not fresh.has_index and fresh.search(X[0]) == []
    put(fresh, "build", {"one": X[0]})
    assert fresh.search(X[0], 10) == ["one"]


def test_special_vectors(spark, path):
    e = VectorEngine(spark, path, DIM)
    put(e, "build", {"zero": np.zeros(DIM), "huge": np.full(DIM, 1e6), "tiny": np.full(DIM, 1e-6)})
    assert e.search(np.zeros(DIM), 3) == ["zero", "tiny", "huge"]
    wide = VectorEngine(spark, path + "w", 4096)
    put(wide, "build", {"high_d": np.ones(4096)})
    assert wide.search(np.ones(4096), 1) == ["high_d"]


def test_batch_equals_single(spark, path):
    e = engine(spark, path, 40)
    put(e, "insert", {f"n{i}": X[i] for i in range(5)})  # ties with main, which comes first
    e.delete_items(["id7"])
    q = spark.createDataFrame([(i, X[i].tolist()) for i in range(10)], "qid bigint, q array<float>")
    found = {}
    for r in e.search_batch(q, 4).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.external_id)
    assert found == {i: e.search(X[i], 4) for i in range(10)} and found[0][:2] == ["id0", "n0"]


def test_data_frames(spark, path):
    e = VectorEngine(spark, path, DIM)
    rows = spark.createDataFrame([(f"id{i}", X[i].tolist(), i) for i in range(10)], "external_id string, vec array<float>, seq int")
    e.write(rows, "build")
    assert e.search(X[2], 1) == ["id2"]
    bad = spark.createDataFrame([("n", [float("nan")] * DIM)], "external_id string, vec array<float>")
    with pytest.raises(RuntimeError, match="NaN/Inf"):
        e.write(bad)
    with pytest.raises(RuntimeError, match="dimension"):
        e.write(spark.createDataFrame([("n", [1.0])], "external_id string, vec array<float>"))
    e.write(rows.limit(0), "insert")
    assert e.live_count() == 10
    n, missing = e.delete(spark.createDataFrame([("id1",), ("zz",), ("zz",), (None,)], "external_id string"))
    assert n == 1 and sorted((r[0] for r in missing.collect()), key=str) == [None, "zz", "zz"]


def test_versions(spark, path):
    e = engine(spark, path, 5)
    old = e.version
    put(e, "upsert", {"id0": X[30]})
    assert e.search(X[0], 1, version=old) == ["id0"] and e.rows(old).count() == 5
    e.rebuild_compact()
    assert e.vacuum() > 0 and set(e.search(X[0], 9)) == {f"id{i}" for i in range(5)}
    store = Store(spark, path)
    mine, other = store.read(), store.read()
    store.commit(mine)
    with pytest.raises(Conflict):
        store.commit(other)


def test_more_tasks_than_any_number_of_bits(spark, path):
    """Row numbers of one commit don't run into the next."""
    e = VectorEngine(spark, path, DIM)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(f"a{i}", rng.standard_normal(DIM).tolist()) for i in range(1030)], "external_id string, vec array<float>")
    e.write(rows.repartition(1030), "build")
    e.write(spark.createDataFrame([("new", [50.0] * DIM), ("copy", [50.0] * DIM)], "external_id string, vec array<float>").coalesce(1), "insert")
    q = spark.createDataFrame([(1, [50.0] * DIM)], "qid bigint, q array<float>")
    assert [(r["rank"], r.external_id, r.distance) for r in e.search_batch(q, 2).orderBy("rank").collect()] == [(0, "new", 0.0), (1, "copy", 0.0)]
    assert e.search([50.0] * DIM, 2) == ["new", "copy"]
    assert e.search_batch(q.limit(0), 2).count() == 0 and e.search_batch(q, 2).columns == ["qid", "rank", "external_id", "distance"]
    with pytest.raises(RuntimeError, match="Dim mismatch"):
        e.search_batch(spark.createDataFrame([(1, [1.0])], "qid bigint, q array<float>"), 2)
    e.rebuild_compact()
    assert e.live_count() == 1032 and len(e.rows().inputFiles()) == 1


def test_trained_index(spark, path):
    """Cells with deltas and deletions; all cells give the exact result."""
    e = engine(spark, path, 50)
    with pytest.raises(RuntimeError, match="No index"):
        VectorEngine(spark, path + "x", DIM).train()
    exact = {i: e.search(X[i], 5) for i in range(0, 50, 10)}
    shares = e.train(8)
    assert len(shares) == 8 and shares == sorted(shares) and shares[-1] == 1
    assert {i: e.search(X[i], 5, efs=1 << 30) for i in exact} == exact and e.rows().columns == ["external_id", "vec", "seq", "pos"]
    put(e, "insert", {f"n{i}": X[i] for i in range(50, 60)})
    put(e, "upsert", {"id3": X[4]})
    e.delete_items(["id0", "n55"])
    q = spark.createDataFrame([(i, X[i].tolist()) for i in range(60)], "qid bigint, q array<float>")
    order = lambda df: [tuple(r) for r in df.orderBy("qid", "rank").collect()]
    assert order(e.search_batch(q, 5, efs=1 << 30)) == order(e.search_batch(q, 5))
    some = e.search_batch(q, 5, efs=5)
    assert {r.external_id for r in some.where("rank = 0").collect()} - {"id0", "n55"} and some.where("external_id in ('id0', 'n55')").count() == 0
    assert e.search_batch(q.limit(0), 5, efs=5).count() == 0 and e.search(X[57], 1) == ["n57"]
    bad = spark.createDataFrame([("z", [1.0])], "external_id string, vec array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        e.write(bad)
    before = order(e.search_batch(q, 5))
    e.rebuild_compact()
    assert order(e.search_batch(q, 5, efs=1 << 30)) == before
    assert VectorEngine(spark, path).search(X[57], 1, efs=8) == ["n57"] and e.vacuum() > 0 and e.search(X[57], 1) == ["n57"]
    put(e, "build", {"only": X[0]})
    assert e.search(X[9], 3) == ["only"] and not e._manifest().centers


def test_vacuum_spares_what_a_writer_announced(spark, path):
    e = engine(spark, path, 5)
    pending = e.store.folder("rows")
    e.rows().write.parquet(pending)
    e.rebuild_compact()
    assert e.vacuum() == 1 and spark.read.parquet(pending).count() == 5
    assert e.vacuum(abandoned=-1) == 1 and e.live_count() == 5 and e.vacuum(abandoned=-1) == 0


def test_writers_and_readers(spark, path):
    e = engine(spark, path, 20)
    errors = []

    def write(n):
        try:
            put(VectorEngine(spark, path, DIM), "insert", {f"w{n}": X[n]})
        except Exception as x:
            errors.append(x)

    def read():
        try:
            for _ in range(3):
                found = VectorEngine(spark, path).search(X[0], 30)
                assert len(found) == len(set(found)) >= 20
        except Exception as x:
            errors.append(x)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)] + [threading.Thread(target=read) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and e.live_count() == 24


def test_raw_file(spark, tmp_path, path):
    raw = tmp_path / "raw"
    raw.write_bytes(X.astype("<f4").tobytes() + b"tail")
    e = VectorEngine(spark, path, DIM)
    e.build_from_file(str(raw), [f"r{i}" for i in range(60)])
    assert raw.exists() and e.search(X[7], 1) == ["r7"]
    e.build_from_file(str(raw), ["only", "two"])
    assert e.live_count() == 2
    with pytest.raises(RuntimeError, match="file too small"):
        e.build_from_file(str(raw), [str(i) for i in range(61)])


def test_fixed_width(spark, tmp_path):
    data = files.encode_rows([("a" * 40, X[0]), ("", X[1]), ("ü", X[2])])
    f = tmp_path / "rows"
    f.write_bytes(data)
    got = files.fixed_width(spark, str(f), DIM).orderBy("pos").collect()
    assert [r.external_id for r in got] == ["a" * 32, "", "?"]
    assert np.allclose([r.vec for r in got], X[:3].astype(np.float32))
    for cut in (1, 7, 1000):
        rows = list(files.decode_chunks([data[i : i + cut] for i in range(0, len(data), cut)], DIM))
        assert [i for i, _ in rows] == ["a" * 32, "", "?"] and np.allclose([v for _, v in rows], X[:3].astype(np.float32))
    rows = files.decode_chunks([data, b"x"], DIM)
    assert len([next(rows) for _ in range(3)]) == 3
    with pytest.raises(ValueError, match="1 bytes left"):
        next(rows)
    f.write_bytes(data + b"x")
    with pytest.raises(ValueError, match="left over"):
        files.fixed_width(spark, str(f), DIM)


def test_json(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "external_id string, vec array<float>")
    assert files.json_rows(files.to_json_rows(rows, "i")).collect()[0][:3] == ("i", "a", [1.0, 2.0])
    odd = spark.createDataFrame([("{}",), ('{"index_name":"i","external_id":"","vector":[1]}',), ("broken",), (None,), ('{"index_name":"i","external_id":"x"}',)], "value string")
    assert [r.problem for r in files.json_rows(odd).collect()] == ["missing index_name", "missing external_id", "missing index_name", "missing index_name", "missing vector"]


def test_catalog(spark, tmp_path):
    with IndexCatalog(spark, str(tmp_path)) as c:
        for name in ("", "___", "a-b", "x" * 65, "a b"):
            with pytest.raises(ValueError):
                c.create(name, 4)
        c.create("größe_1", 4)
        with pytest.raises(ValueError, match="exists"):
            c.create("größe_1", 4)
        with pytest.raises(KeyError):
            c.search("unknown", [0] * 4)
        c.init("größe_1", "build")
        with pytest.raises(ValueError, match="missing"):
            c.ingest("größe_1", "", [0] * 4)
        assert c.ingest_batch("größe_1", [files.encode_rows([("p", [1, 2, 3, 4]), ("q", [0, 0, 0, 1])])]) == 2
        c.finalize("größe_1")
        assert c.search("größe_1", [1, 2, 3, 4], 1) == ["p"] and c.list() == ["größe_1"] and len(c) == 1
        with pytest.raises(ValueError):
            c.delete("größe_1", [])
        assert c.delete("größe_1", ["p", "z"], True) == (1, ["z"])
        assert c.status("größe_1") == {"index_name": "größe_1", "dim": 4, "has_index": True, "needs_rebuild": True}
        c.optimize("größe_1")
        assert not c.get("größe_1").needs_rebuild()
        c.drop("größe_1")
        assert c.load("größe_1").search([0, 0, 0, 1]) == ["q"]
        c.rebuild("größe_1")
        c.drop("größe_1", destroy=True)
        with pytest.raises(ValueError, match="dim"):
            c.load("größe_1")


def test_stream(spark, tmp_path, path):
    source = tmp_path / "in"
    schema = "external_id string, vec array<float>, at int"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    land([("a", X[0].tolist(), 1), ("a", X[1].tolist(), 2), ("b", X[2].tolist(), 1)])
    e = VectorEngine(spark, path, DIM)
    run = lambda: stream_into(spark.readStream.schema(schema).parquet(str(source)), e, str(tmp_path / "cp"), order="at", once=True).awaitTermination()
    run()
    assert e.search(X[1], 5) == ["a", "b"]
    land([("b", X[3].tolist(), 2), ("c", X[4].tolist(), 1)])
    run()
    assert e.search(X[3], 1) == ["b"] and e.live_count() == 3
    version = e.version
    e.write(spark.createDataFrame([("z", X[9].tolist())], "external_id string, vec array<float>"), stream=("upserts", 1))  # a replay
    assert e.version == version and e.live_count() == 3
    assert last_per_id(spark.createDataFrame([], schema), "at").count() == 0


def test_stream_of_all_collections(spark, tmp_path):
    """Collections may share ids, and names may be the start of others."""
    names, ids = ["catalog_main", "catalog", "a", "a:b", "1:a", None], ["x", "ax", "1:x", "", None]
    rows = [(i, names[i % 6], ids[i % 5], [float(i)] * 32) for i in range(90)] + [(200, "a", "x", [float("nan")] * 32), (None, "a", "x", [1.0] * 32)]
    spark.createDataFrame(rows + rows[:9], "req_id bigint, index_name string, external_id string, vector array<float>").write.parquet(f"{tmp_path}/ingest_requests.parquet")
    last = {(c, e): float(i) for i, c, e, _ in rows[:90] if c is not None and e is not None}
    assert sorted(tuple(r) for r in queries.stream_upserts_all(spark, str(tmp_path)).collect()) == sorted((*k, v) for k, v in last.items())
    assert {tuple(r) for r in queries.stream_upserts(spark, str(tmp_path)).collect()} == {(e, v) for (c, e), v in last.items() if c == "catalog_main"}


def test_internal_numbers(spark, path):
    e = VectorEngine(spark, path, DIM)
    e.write(spark.createDataFrame([(f"id{i:03}", X[i].tolist()) for i in range(50)], "external_id string, vec array<float>").repartition(4), "build")
    rows = e.internal().orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(50)) and {r.external_id for r in rows} == {f"id{i:03}" for i in range(50)}
    order = [r.external_id for r in e.rows().orderBy("seq", "pos").collect()]
    e.delete_items(order[:3])
    assert e.map_internal_to_external([49, 0, 0]) == [order[49], order[0], order[0]] and e.map_internal_to_external([]) == []
    with pytest.raises(IndexError):
        e.map_internal_to_external([50])


def test_json_answers(spark):
    found = spark.createDataFrame([(1, 1, "b\""), (1, 0, "a"), (2, 0, "é")], "qid bigint, rank bigint, external_id string")
    assert dict(files.answers_json(found).collect()) == {1: '["a","b\\""]', 2: '["é"]'}
