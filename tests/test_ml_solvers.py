"""Logistic regression against a Newton solution, the tree's root split against all splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislekit.operators import classify as C
from aislekit.operators import features as FE
from aislekit.plans import training as T

WORDS = {"x": ["alma", "armut", "kiraz", "elma"], "y": ["ekmek", "simit", "pide", "elma"], "z": ["peynir", "yumurta", "simit"]}


@pytest.fixture(scope="module")
def prepared(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        label = "xxxyyz"[i % 6]
        rows.append((i, " ".join(rng.choice(WORDS[label], 4)), label))
    return T.prepare(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")


def _matrix(p):
    data = C._training_frame(p.coded.join(p.rows("train"), "doc_id"), p.tfidf, p.codes).orderBy("doc_id").collect()
    return (np.array([r["features"].toArray() for r in data]), np.array([int(r["y"]) for r in data]),
            np.array([r["weight"] for r in data]))


def _newton(x, y, w, classes):
    """Weights of sum(w * loss) + |W|^2 / 2, intercepts without penalty."""
    n, d = x.shape
    x1 = np.hstack([x, np.ones((n, 1))])
    theta = np.zeros((classes, d + 1))
    ridge = np.tile(np.r_[np.ones(d), 1e-9], classes)
    for _ in range(100):
        z = x1 @ theta.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - np.eye(classes)[y]) * w[:, None]).T @ x1
        g = g.ravel() + ridge * theta.ravel()
        h = np.diag(ridge)
        for a in range(classes):
            for b in range(classes):
                v = w * p[:, a] * ((a == b) - p[:, b])
                s, t = a * (d + 1), b * (d + 1)
                h[s:s + d + 1, t:t + d + 1] += x1.T @ (x1 * v[:, None])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        theta -= step.reshape(theta.shape)
        if np.abs(step).max() < 1e-10:
            break
    return p


def test_logistic_regression_meets_the_newton_solution(spark, prepared):
    x, y, w = _matrix(prepared)
    expected = _newton(x, y, w, 3)
    m = T.fitted_model(prepared, "logistic_regression")
    got = m.predict(prepared.coded_of("train")).orderBy("doc_id", "code").collect()
    found = np.array([r["proba"] for r in got]).reshape(-1, 3)
    assert np.abs(found - expected).max() < 1e-5
    labels = {r["doc_id"]: r["predicted_code"] for r in m.predict_labels(prepared.coded_of("train")).collect()}
    assert list(expected.argmax(1)) == [labels[k] for k in sorted(labels)]


def test_tree_root_is_the_best_split(spark, prepared):
    x, y, w = _matrix(prepared)
    root = C.fit_decision_tree(prepared.coded.join(prepared.rows("train"), "doc_id"), prepared.tfidf, prepared.codes, max_depth=1).model._call_java("rootNode").split()

    def gini(mask):
        share = np.bincount(y[mask], w[mask], 3) / w[mask].sum()
        return w[mask].sum() * (1 - (share ** 2).sum())

    best = min(gini(x[:, f] <= c) + gini(x[:, f] > c) for f in range(x.shape[1]) for c in np.unique(x[:, f])[:-1])
    low = x[:, root.featureIndex()] <= root.threshold()
    assert gini(low) + gini(~low) == pytest.approx(best)


def test_unknown_model_and_probabilities(spark, prepared):
    with pytest.raises(ValueError):
        T.fitted_model(prepared, "svm")
    for kind in C.MODEL_CHOICES:
        pred, proba = T.holdout(prepared, kind)
        assert pred.count() == prepared.rows("test").count()
        sums = proba.groupBy("doc_id").agg(F.sum("proba").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert all(abs(r["s"] - 1) < 1e-9 and r["n"] == 3 for r in sums)
