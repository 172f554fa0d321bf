import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecquill import dot, dot_batch, dot_mat_vec, dot_value, l2_sqr, l2_sqr_batch, l2_sqr_mat_vec, l2_sqr_value
from vecquill.functions.checks import bad_rows, repeated_ids

floats = st.floats(-1e3, 1e3, width=32)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(floats, floats), min_size=1, max_size=40))
def test_values(pairs):
    a, b = np.array(pairs, np.float32).T
    assert l2_sqr_value(a, b) == pytest.approx(((a.astype(float) - b) ** 2).sum(), rel=1e-12, abs=1e-12)
    assert dot_value(a, b) == pytest.approx((a.astype(float) * b).sum(), rel=1e-9, abs=1e-6)


def test_value_errors():
    with pytest.raises(RuntimeError, match="1-D"):
        l2_sqr_value(np.zeros((2, 2)), np.zeros(2))
    with pytest.raises(RuntimeError, match="same length"):
        dot_value(np.zeros(3), np.zeros(2))


def test_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(l2_sqr("a", "b"), dot("a", "b"), l2_sqr("a", np.array([0, 0]))).collect()] == [(13.0, 13.0, 5.0), (None, None, None)]


def test_unequal_columns_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="same length"):
        df.select(l2_sqr("a", "b")).collect()


def test_bad_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("ok", [1.0, 2.0]), ("nan", [nan, 1.0]), ("inf", [1.0, -inf]), ("far", [2e16, 1.0]), ("short", [1.0]), ("none", None), ("part", [1.0, None]), (None, [1.0, 1.0]), ("", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "external_id string, vec array<float>")
    assert {(r.external_id, r.reason) for r in bad_rows(df, 2).collect()} == {("nan", "NaN/Inf"), ("inf", "NaN/Inf"), ("far", "NaN/Inf"), ("part", "NaN/Inf"), ("short", "dimension mismatch"), ("none", "dimension mismatch"), (None, "missing id")}


def test_repeated(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "external_id string")
    assert [tuple(r) for r in repeated_ids(df).collect()] == [("a", 2)]


def test_matrices():
    a, b = np.arange(6.0).reshape(2, 3), np.ones((2, 3))
    assert l2_sqr_batch(a, b).tolist() == [2.0, 29.0] and dot_batch(a, b).tolist() == [3.0, 12.0]
    assert l2_sqr_mat_vec(a, b[0]).tolist() == [2.0, 29.0] and dot_mat_vec(a, b[0]).tolist() == [3.0, 12.0]
    for call in (lambda: l2_sqr_batch(a, b[:1]), lambda: dot_mat_vec(a, b), lambda: l2_sqr_mat_vec(a, b[0, :2])):
        with pytest.raises(RuntimeError):
            call()
