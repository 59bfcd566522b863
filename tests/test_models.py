"""TF-IDF, split, Naive Bayes and metrics against plain numpy on small fixtures."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislekit.operators import classify as C
from aislekit.operators import evaluate as E
from aislekit.operators import features as FE

DOCS = [
    (1, "süt peynir süt yoğurt", "dairy"), (2, "peynir kaşar süt", "dairy"), (3, "ekmek simit poğaça", "bakery"),
    (4, "simit ekmek", "bakery"), (5, "elma armut muz", "fruit"), (6, "muz elma elma", "fruit"),
    (7, "yoğurt ayran süt", "dairy"), (8, "poğaça ekmek çörek", "bakery"), (9, "armut kiraz", "fruit"),
    (10, "ayran peynir", "dairy"), (11, "çörek simit", "bakery"), (12, "kiraz muz armut", "fruit"),
]


def _numpy_tfidf(texts, max_features=5000):
    toks = [re.findall(r"[^\W\d_]{2,}|\w{2,}", t.lower()) for t in texts]
    terms = [tk + [a + " " + b for a, b in zip(tk, tk[1:])] for tk in toks]
    total = Counter(x for ts in terms for x in ts)
    vocab = sorted(sorted(total, key=lambda w: (-total[w], w))[:max_features])
    idx = {w: i for i, w in enumerate(vocab)}
    n = len(texts)
    df = Counter(w for ts in terms for w in set(ts) if w in idx)
    idf = np.array([math.log((1 + n) / (1 + df[w])) + 1 for w in vocab])
    X = np.zeros((n, len(vocab)))
    for d, ts in enumerate(terms):
        for w in ts:
            if w in idx:
                X[d, idx[w]] += 1
    X *= idf
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    return vocab, X


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, label string")


def test_tfidf_matches_numpy(spark, docs):
    m = FE.fit_tfidf(docs, "doc_id", "text", normalize="none")
    vocab, X = _numpy_tfidf([t for _, t, _ in DOCS])
    assert [r["term"] for r in m.vocab.orderBy("idx").collect()] == vocab
    got = {(r["doc_id"], r["term"]): r["tfidf"] for r in m.transform(docs, "doc_id", "text").collect()}
    for d, (doc_id, _, _) in enumerate(DOCS):
        for j, w in enumerate(vocab):
            assert got.get((doc_id, w), 0.0) == pytest.approx(X[d, j])
    vec = {r["doc_id"]: r["features"].toArray() for r in FE.tfidf_vectors(docs, "doc_id", "text", m).collect()}
    assert np.allclose(vec[1], X[0])


def test_split_sizes_are_exact(spark):
    rows = [(i, c) for i, c in enumerate(["a"] * 53 + ["b"] * 31 + ["c"] * 9 + ["d"] * 2)]
    df = spark.createDataFrame(rows, "id long, label string")
    s = FE.stratified_split(df, "id", "label")
    counts = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n_test = sum(v for (l, sp), v in counts.items() if sp == "test")
    assert n_test == math.ceil(0.2 * len(rows))
    for lab, n in Counter(c for _, c in rows).items():
        assert abs(counts.get((lab, "test"), 0) - 0.2 * n) <= 1
    again = {r["id"]: r["split"] for r in FE.stratified_split(df, "id", "label").collect()}
    assert again == {r["id"]: r["split"] for r in s.collect()}


def test_naive_bayes_matches_numpy(spark, docs):
    m = FE.fit_tfidf(docs, "doc_id", "text", normalize="none")
    w = m.transform(docs, "doc_id", "text")
    labels = docs.select("doc_id", "label")
    codes = FE.label_codes(docs, "label")
    V = m.vocab.count()
    nb = C.fit_naive_bayes(w, labels, codes, V)
    jll = C.naive_bayes_jll(nb, labels, w)
    got = {(r["doc_id"], r["label"]): r["jll"] for r in jll.collect()}
    vocab, X = _numpy_tfidf([t for _, t, _ in DOCS])
    classes = sorted({c for *_, c in DOCS})
    y = np.array([classes.index(c) for *_, c in DOCS])
    fc = np.stack([X[y == k].sum(axis=0) for k in range(len(classes))]) + 1.0
    flp = np.log(fc) - np.log(fc.sum(axis=1, keepdims=True))
    prior = np.log(np.bincount(y) / len(y))
    expect = X @ flp.T + prior
    for d, (doc_id, _, _) in enumerate(DOCS):
        for k, c in enumerate(classes):
            assert got[(doc_id, c)] == pytest.approx(expect[d, k])
    pred = {r["doc_id"]: r["predicted"] for r in C.argmax_class(jll).collect()}
    assert pred == {doc_id: classes[int(np.argmax(expect[d]))] for d, (doc_id, _, _) in enumerate(DOCS)}
    p = C.probabilities(jll).groupBy("doc_id").agg(F.sum("proba").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in p)


def _auc(y, s):
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(5)
    classes = ["a", "b", "c"]
    n = 120
    y = rng.integers(0, 3, n)
    raw = rng.random((n, 3)).round(2) + np.eye(3)[y] * 0.3
    prob = raw / raw.sum(axis=1, keepdims=True)
    p = prob.argmax(axis=1)
    pred = spark.createDataFrame([(i, classes[y[i]], classes[p[i]]) for i in range(n)], "doc_id long, y string, p string")
    proba = spark.createDataFrame([(i, classes[k], float(prob[i, k])) for i in range(n) for k in range(3)],
                                  "doc_id long, label string, proba double")
    rep = {r["label"]: r for r in E.classification_report(pred).collect()}
    for k, c in enumerate(classes):
        tp = int(((y == k) & (p == k)).sum())
        prec = tp / max((p == k).sum(), 1)
        rec = tp / max((y == k).sum(), 1)
        assert rep[c]["precision"] == pytest.approx(prec) and rep[c]["recall"] == pytest.approx(rec)
    assert rep["accuracy"]["f1"] == pytest.approx((y == p).mean())
    ll = E.log_loss(pred, proba).first()
    assert ll["status"] == "ok"
    assert ll["log_loss"] == pytest.approx(-np.mean(np.log(prob[np.arange(n), y])))
    auc = E.roc_auc_ovr(pred, proba).first()
    weights = np.bincount(y, minlength=3) / n
    expect = sum(weights[k] * _auc(y == k, prob[:, k]) for k in range(3))
    assert auc["roc_auc"] == pytest.approx(expect)


def test_naive_bayes_takes_many_classes(spark):
    n = 12_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 6000).alias("term"),
                                 F.lit(1.0).alias("tfidf"), F.concat(F.lit("c"), "id").alias("label"), F.col("id").cast("int").alias("code"))
    nb = C.fit_naive_bayes(rows.select("doc_id", "term", "tfidf"), rows.select("doc_id", "label"), rows.select("label", "code"), 6000)
    docs = spark.createDataFrame([(1, "t7", 1.0), (2, "t11", 1.0)], "doc_id long, term string, tfidf double")
    got = {r["doc_id"]: r["predicted_code"] for r in C.naive_bayes_predict(nb, docs.select("doc_id"), docs).collect()}
    assert got == {1: 7, 2: 11}  # the smaller code of two equal classes
