import numpy as np
import pytest

from vecquill import all_knn, all_knn_batch, brute_knn_batch, knn, queries
from vecquill.operators import ann
from vecquill.operators.knn import knn_within, nearest_one


def frame(spark, x, names="idx bigint, vec array<float>"):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], names)


def truth(x, q, k, itself=True):
    d = ((q[:, None] - x[None]) ** 2).sum(-1)
    out = []
    for i in range(len(q)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if itself or j != i][:k]
        out += [(i, r, int(j)) for r, j in enumerate(order)]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    # a coarse grid, so that ties are common
    return rng.integers(0, 3, (300, 4)).astype(float)


def got(df):
    return [(r.qid, r["rank"], r.idx) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_exact_with_ties(spark, data, block_bytes):
    x, q = frame(spark, data), frame(spark, data[:20], "qid bigint, q array<float>")
    assert got(knn(x, q, 7, block_bytes=block_bytes)) == truth(data, data[:20], 7)


def test_all(spark, data):
    assert got(all_knn(frame(spark, data), 3)) == truth(data, data, 3, itself=False)


def test_more_than_there_are(spark, data):
    x, q = frame(spark, data[:5]), frame(spark, data[:2], "qid bigint, q array<float>")
    assert got(knn(x, q, 100)) == truth(data[:5], data[:2], 100)
    assert len(got(all_knn(x, 100))) == 20


def test_errors_and_empty(spark, data):
    x, q = frame(spark, data[:5]), frame(spark, data[:2], "qid bigint, q array<float>")
    with pytest.raises(RuntimeError, match="k must be"):
        knn(x, q, 0)
    with pytest.raises(RuntimeError, match="Dim mismatch"):
        knn(x, frame(spark, data[:2, :3], "qid bigint, q array<float>"), 1)
    with pytest.raises(Exception, match="2-D"):
        knn(x.unionByName(frame(spark, data[:1, :3])), q, 1).count()
    assert knn_within(x.selectExpr("*", "1 as g"), q.selectExpr("*", "1 as g").limit(0), "g", 1).count() == 0
    assert knn(x.limit(0), q, 3).count() == 0
    assert knn(x, q.limit(0), 3).count() == 0
    # null vectors take no part, clashing columns do no harm
    odd = x.unionByName(spark.createDataFrame([(99, None)], "idx bigint, vec array<float>")).selectExpr("*", "1 as qid", "2 as dist", "3 as rank")
    assert got(knn(odd, q, 2)) == truth(data[:5], data[:2], 2)


def test_large_values(spark):
    x = np.array([[1e15, 0], [1e15 + 1e9, 0], [1, 1], [1, 2]])
    assert got(knn(frame(spark, x), frame(spark, x, "qid bigint, q array<float>"), 2)) == truth(x.astype(np.float32).astype(float), x.astype(np.float32).astype(float), 2)


def test_within_groups(spark, data):
    x = spark.createDataFrame([(i, "ab"[i % 2] if i else None, r.tolist()) for i, r in enumerate(data[:50])], "idx bigint, g string, vec array<float>")
    q = spark.createDataFrame([(0, "a", data[0].tolist()), (1, "b", data[1].tolist()), (2, "zz", data[2].tolist())], "qid bigint, g string, q array<float>")
    found = {}
    for r in knn_within(x, q, "g", 4).orderBy("qid", "dist", "idx").collect():
        found.setdefault(r.qid, []).append(r.idx)
    for i, rows in ((0, range(2, 50, 2)), (1, range(1, 50, 2))):
        assert found[i] == sorted(rows, key=lambda j: (((data[j] - data[i]) ** 2).sum(), j))[:4]
    assert 2 not in found


def test_one_query_stays_in_the_jvm(spark, data):
    top = nearest_one(frame(spark, data), data[3], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    assert [r.idx for r in top.collect()] == [j for _, _, j in truth(data, data[3:4], 5)]


def test_cells_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((8, 16)) * 5
    x = middle[rng.integers(0, 8, 2000)] + rng.standard_normal((2000, 16))
    q = frame(spark, x[:50], "qid bigint, q array<float>")
    cells = ann.Cells.write(frame(spark, x), str(tmp_path / "c"), 8)
    exact = set(got(knn(frame(spark, x), q, 10)))
    near = set(got(cells.search(q, 10, 3)))
    assert len({(a, c) for a, _, c in exact} & {(a, c) for a, _, c in near}) >= 0.9 * len(exact)
    assert set(got(cells.search(q, 10, 8))) == exact
    assert cells.search(q.limit(0), 10).count() == 0
    found = ann.hashed(frame(spark, x), q, 10, 40.0)
    pairs = {(r.qid, r.idx) for r in found.collect()}
    assert len(pairs & {(a, c) for a, _, c in exact}) >= 0.9 * len(exact)


def test_registered_cells_recall(spark, tmp_path):
    """As registered, on unit vectors without clusters, as in the driver's table."""
    x = np.random.default_rng(4).standard_normal((2000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    frame(spark, x, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = {(r.qid, r.vec_id) for r in queries.ivf_search(spark, str(tmp_path)).collect()}
    asked = sorted({a for a, _ in near})
    exact = {(asked[a], c) for a, _, c in truth(x, x[asked], 10)}
    assert len(asked) >= 10 and len(exact & near) >= 0.9 * len(exact)


def test_approximate_queries_grow_with_the_table(spark, tmp_path):
    x = np.random.default_rng(6).standard_normal((1201, 64))
    frame(spark, x / np.linalg.norm(x, axis=1)[:, None], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for each in (queries.ivf_search, queries.lsh_search):
        assert {r.qid for r in each(spark, str(tmp_path)).collect()} == set(range(0, 1201, 100))


def test_arrays(data):
    idx, dist = brute_knn_batch(data, data[:9], 7)
    assert [(i, r, int(j)) for i, row in enumerate(idx) for r, j in enumerate(row)] == truth(data, data[:9], 7)
    assert idx.dtype == np.int32 and dist.dtype == np.float32 and (dist[:, 0] == 0).all()
    assert [(i, r, int(j)) for i, row in enumerate(all_knn_batch(data, 3)) for r, j in enumerate(row)] == truth(data, data, 3, itself=False)
    assert brute_knn_batch(data[:0], data[:2], 3)[0].shape == (2, 0) and brute_knn_batch(data[:2], data[:3], 9)[0].shape == (3, 2)
    assert all_knn_batch(data[:4], 9).shape == (4, 3) and all_knn_batch(data[:1], 9).shape == (1, 0)
    for bad, text in (((data[0], data, 1), "2-D"), ((data, data[:, :2], 1), "Dim mismatch"), ((data, data, 0), "k must")):
        with pytest.raises(RuntimeError, match=text):
            brute_knn_batch(*bad)
