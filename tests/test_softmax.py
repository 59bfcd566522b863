"""Newton steps over rows in several tasks against the gradient, the Hessian and the minimum in plain numpy."""

import numpy as np
import pyarrow as pa
import pytest

from aislekit.operators import softmax as SM


def problem(spark, n=300, terms=25, classes=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, terms))
    rows = []
    for i in range(n):
        idx = np.sort(rng.choice(terms, rng.integers(0, 7), replace=False))
        x[i, idx] = rng.random(len(idx))
        rows.append((idx.tolist(), x[i, idx].tolist(), int(rng.integers(0, classes)), float(rng.random() + 0.5)))
    df = spark.createDataFrame(rows, "idx array<int>, w array<double>, y int, weight double").repartition(6)
    return np.hstack([x, np.ones((n, 1))]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), df


def test_sums_equal_numpy(spark):
    x, y, w, df = problem(spark)
    sums = SM.Sums(df, 4, 25)
    rng = np.random.default_rng(5)
    theta, v = rng.normal(size=(4, 26)), rng.normal(size=(4, 26))
    p = SM._softmax(x @ theta.T)
    loss, g, h = sums.gradient(theta)
    assert loss == pytest.approx(-(w * np.log(p[np.arange(len(y)), y])).sum())
    assert np.allclose(g, ((p - np.eye(4)[y]) * w[:, None]).T @ x)
    assert np.allclose(h, (w[:, None] * p * (1 - p)).T @ (x * x))
    z = x @ v.T
    assert np.allclose(sums.curvature(theta, v), (w[:, None] * p * (z - (p * z).sum(1, keepdims=True))).T @ x)
    e = 1e-6
    assert np.allclose((sums.gradient(theta + e * v)[1] - g) / e, sums.curvature(theta, v), atol=1e-3)


def test_minimum_in_few_passes(spark):
    x, y, w, df = problem(spark, seed=3)
    sums = SM.Sums(df, 4, 25)
    theta, value = SM.solve(sums, tolerance=1e-9)
    p = SM._softmax(x @ theta.T)
    g = ((p - np.eye(4)[y]) * w[:, None]).T @ x
    g[:, :-1] += theta[:, :-1]
    assert np.abs(g).max() < 1e-5 and sums.passes < 90
    assert value == pytest.approx(-(w * np.log(p[np.arange(len(y)), y])).sum() + 0.5 * (theta[:, :-1] ** 2).sum())


def test_more_tasks_than_the_driver_takes(spark):
    x, y, w, df = problem(spark, n=150, seed=1)
    a, b = SM.Sums(df.repartition(3), 4, 25), SM.Sums(df.repartition(70), 4, 25)
    theta = np.random.default_rng(2).normal(size=(4, 26))
    assert np.allclose(a.gradient(theta)[1], b.gradient(theta)[1])


def test_passes_read_blocks_of_documents(spark):
    """Rows of lists took longer to take apart than to add up; a kept row holds many documents, empty ones as well."""
    x, y, w, df = problem(spark, seed=7)
    sums = SM.Sums(df.coalesce(2), 4, 25)
    assert sums.data.count() < 10 and {f.dataType.simpleString() for f in sums.data.schema} == {"binary"}
    batch = pa.RecordBatch.from_arrays([pa.array([[], [1], [0, 2, 3], []], pa.list_(pa.int32())), pa.array([[], [.5], [1., 2., 3.], []], pa.list_(pa.float64())),
                                        pa.array([0, 1, 2, 3], pa.int32()), pa.array([1., 2., 3., 4.])], names=["idx", "w", "y", "weight"])
    for most, n in ((1, 3), (2, 3), (4, 1), (100, 1)):
        SM.BLOCK, whole = most, SM.BLOCK
        try:
            got = list(SM._blocks([batch.slice(0, 0), batch]))
        finally:
            SM.BLOCK = whole
        assert len(got) == n
        read = [np.concatenate([np.frombuffer(b.column(i)[0].as_buffer(), k) for b in got]).tolist()
                for i, k in enumerate((np.int32, np.int32, np.float64, np.int32, np.float64))]
        assert read == [[0, 1, 3, 0], [1, 0, 2, 3], [.5, 1., 2., 3.], [0, 1, 2, 3], [1., 2., 3., 4.]]
