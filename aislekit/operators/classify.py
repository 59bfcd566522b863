"""Product-category classifiers.

* Multinomial Naive Bayes (M11) is written as aggregates over the long TF-IDF
  table: Spark ML's ``NaiveBayes`` smooths the class prior as well, which the
  reference's estimator does not.  Scoring never materialises the dense
  class x vocabulary table: for a class c and document d

      jll(d, c) = prior_c + X_d * (ln a - ln(T_c + a V)) + sum_{t in d, F_ct > 0} x_dt (ln(F_ct + a) - ln a)

  where F_ct is the summed TF-IDF of term t in class c, T_c its row sum, V the
  vocabulary size and X_d the sum of the document's weights.  The sparse part
  joins only the (class, term) pairs seen in training.
* Logistic regression (M12) is solved by Newton steps over the coded rows (``softmax``).
* The decision tree (M13) is a ``pyspark.ml`` estimator on ``SparseVector`` features built JVM-side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import softmax
from . import termrows as R
from .features import TfidfModel, balanced_weights, row_vectors

# Fixed values of the reference's estimators.
NB_ALPHA = 1.0
LR_C = 1.0
LR_MAX_ITER = 5000           # of the reference's solver; Newton steps end far earlier
TREE_SEED = 42
TREE_MAX_DEPTH = 30          # Spark's ceiling; the reference grows the tree without limit
TREE_MAX_BINS = 32           # Spark's default number of threshold candidates
MODEL_CHOICES = ("naive_bayes", "decision_tree", "logistic_regression")


@dataclass
class NaiveBayesModel:
    classes: DataFrame      # label, code, n_docs, log_prior, log_norm
    features: DataFrame     # label, term, fc, delta (= ln(fc + a) - ln a) for fc > 0
    alpha: float
    vocab_size: int

    def feature_log_prob(self) -> DataFrame:
        """(label, term, log_prob) for the (class, term) pairs seen in training."""
        return (self.features.join(self.classes.select("label", "log_norm"), "label")
                .select("label", "term", (F.log(F.col("fc") + self.alpha) - F.col("log_norm"))
                        .alias("log_prob")))


def fit_naive_bayes(tfidf: DataFrame, labels: DataFrame, label_codes: DataFrame, vocab_size: int,
                    alpha: float = NB_ALPHA) -> NaiveBayesModel:
    """``tfidf`` = (doc_id, term, tfidf) of training docs, ``labels`` = (doc_id, label)."""
    return _naive_bayes(tfidf.join(labels, "doc_id"), labels, label_codes, vocab_size, alpha)


def fit_naive_bayes_rows(labelled: DataFrame, label_codes: DataFrame, vocab: DataFrame, alpha: float = NB_ALPHA) -> NaiveBayesModel:
    """M11 from ``doc_id, idx, tf, w, label`` rows: what is shuffled are partial sums by class and term."""
    return _naive_bayes(R.long_rows(labelled, vocab, "label"), labelled.select("doc_id", "label"), label_codes, vocab.count(), alpha)


def _naive_bayes(train: DataFrame, labels: DataFrame, label_codes: DataFrame, vocab_size: int, alpha: float) -> NaiveBayesModel:
    fc = train.groupBy("label", "term").agg(F.sum("tfidf").alias("fc"))
    tot = fc.groupBy("label").agg(F.sum("fc").alias("tot"))
    docs = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    n = labels.count()
    classes = (docs.join(tot, "label", "left").join(label_codes, "label")
               .select("label", "code", "n_docs",
                       F.log(F.col("n_docs") / F.lit(float(n))).alias("log_prior"),
                       F.log(F.coalesce(F.col("tot"), F.lit(0.0)) + alpha * vocab_size).alias("log_norm")))
    features = fc.where(F.col("fc") > 0).select(
        "label", "term", "fc", (F.log(F.col("fc") + alpha) - math.log(alpha)).alias("delta"))
    return NaiveBayesModel(cut_lineage(classes), cut_lineage(features), alpha, vocab_size)


def _class_sums(model: NaiveBayesModel, doc_ids: DataFrame, tfidf: DataFrame) -> DataFrame:
    """``doc_id, X, sp``: the weights' sum, and a map from class code to the sparse part of its score.

    The model is grouped by term (an array of (code, delta)), so a document's tokens meet each term once and a
    document stays one row; only classes seen with one of its terms are in its map.
    """
    la = model.features.join(model.classes.select("label", "code"), "label")
    terms = la.groupBy("term").agg(F.collect_list(F.struct("code", "delta")).alias("by_class"))
    parts = (tfidf.select("doc_id", "term", "tfidf").join(terms, "term", "left")
             .select("doc_id", "tfidf", F.explode_outer("by_class").alias("c")))
    sums = parts.groupBy("doc_id", "c.code").agg(F.sum(F.col("tfidf") * F.col("c.delta")).alias("sp"))
    xs = tfidf.groupBy("doc_id").agg(F.sum("tfidf").alias("X"))
    sparse = (sums.where(F.col("code").isNotNull()).groupBy("doc_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("code", "sp"))).alias("sp")))
    return (doc_ids.select("doc_id").join(xs, "doc_id", "left").join(sparse, "doc_id", "left")
            .select("doc_id", F.coalesce("X", F.lit(0.0)).alias("X"), "sp"))


def _with_scores(model: NaiveBayesModel, doc_ids: DataFrame, tfidf: DataFrame) -> DataFrame:
    """``doc_id, scores``: one row a document, its scores an array of (jll, -code, label) over all classes.

    The class parameters are one row of the model, a scalar subquery of the plan.
    """
    la = math.log(model.alpha)
    params = model.classes.agg(F.sort_array(F.collect_list(
        F.struct("code", "label", "log_prior", "log_norm"))).alias("classes"))
    docs = _class_sums(model, doc_ids, tfidf).withColumn("classes", params.scalar())

    def one(c):
        base = c["log_prior"] + F.col("X") * (F.lit(la) - c["log_norm"])
        own = F.coalesce(F.try_element_at(F.col("sp"), c["code"]), F.lit(0.0))
        return F.struct((base + own).alias("jll"), (-c["code"]).alias("nc"), c["label"].alias("label"))

    return docs.select("doc_id", F.transform("classes", one).alias("scores"))


def naive_bayes_jll(model: NaiveBayesModel, doc_ids: DataFrame, tfidf: DataFrame) -> DataFrame:
    """Joint log-likelihood per (doc_id, class): ``doc_id, label, code, jll`` (for probabilities)."""
    return (_with_scores(model, doc_ids, tfidf).select("doc_id", F.explode("scores").alias("s"))
            .select("doc_id", "s.label", (-F.col("s.nc")).alias("code"), "s.jll"))


def naive_bayes_predict(model: NaiveBayesModel, doc_ids: DataFrame, tfidf: DataFrame) -> DataFrame:
    """The class of largest score per document, in its row; ties go to the smallest code."""
    return (_with_scores(model, doc_ids, tfidf).select("doc_id", F.array_max("scores").alias("s"))
            .select("doc_id", F.col("s.label").alias("predicted"), (-F.col("s.nc")).alias("predicted_code")))


#: Numbers of a model that may go to every task; larger ones are joined by term.
MAX_BROADCAST = 1 << 22


def score_rows(model: NaiveBayesModel, rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """``doc_id, scores`` (as :func:`_with_scores`) of ``doc_id, idx, w`` rows, each scored in its row.

    Classes x vocabulary of a model are counted first: up to ``MAX_BROADCAST`` numbers go to the tasks as a matrix, beyond that
    terms meet the model in a join.
    """
    classes = [r["code"] for r in model.classes.select("code").orderBy("code").limit(MAX_BROADCAST // max(1, model.vocab_size) + 1).collect()]
    if len(classes) * model.vocab_size > MAX_BROADCAST:
        return _with_scores(model, rows.select("doc_id"), R.long_rows(rows, vocab))
    place = {c: i for i, c in enumerate(classes)}
    matrix = np.zeros((max(1, model.vocab_size), max(1, len(classes))))
    known = model.features.join(model.classes.select("label", "code"), "label").join(vocab.select("term", "idx"), "term")
    for r in known.select("idx", "code", "delta").collect():  # no more than the matrix
        matrix[r["idx"], place[r["code"]]] = r["delta"]
    sent = rows.sparkSession.sparkContext.broadcast(matrix)

    def scored(batches):
        delta = sent.value
        for batch in batches:
            n = len(batch)
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), lengths)
            idx, w = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            sums = R.products(row, idx, w, n, delta)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(row, w, n)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * delta.shape[1]), pa.array(sums.ravel()))],
                names=["doc_id", "X", "sp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sums = rows.select("doc_id", "idx", "w").mapInArrow(scored, f"doc_id {kind}, X double, sp array<double>")
    la = math.log(model.alpha)
    params = model.classes.agg(F.sort_array(F.collect_list(F.struct("code", "label", "log_prior", "log_norm"))).alias("classes"))

    def one(c, i):
        base = c["log_prior"] + F.col("X") * (F.lit(la) - c["log_norm"])
        return F.struct((base + F.get("sp", i)).alias("jll"), (-c["code"]).alias("nc"), c["label"].alias("label"))

    return sums.withColumn("classes", params.scalar()).select("doc_id", F.transform("classes", one).alias("scores"))


def best_class(scores: DataFrame) -> DataFrame:
    """``doc_id, predicted, predicted_code``; ties go to the smallest code."""
    return scores.select("doc_id", F.array_max("scores").alias("s")).select(
        "doc_id", F.col("s.label").alias("predicted"), (-F.col("s.nc")).alias("predicted_code"))


def score_probabilities(scores: DataFrame) -> DataFrame:
    """``doc_id, label, code, proba``, the softmax of a row's scores in the row."""
    top = F.array_max(F.transform("scores", lambda s: s["jll"]))
    z = scores.withColumn("_m", top).withColumn("_z", F.transform("scores", lambda s: F.exp(s["jll"] - F.col("_m"))))
    total = F.aggregate("_z", F.lit(0.0), lambda a, x: a + x)
    parts = z.select("doc_id", F.posexplode("scores").alias("_i", "s"), "_z", total.alias("_t"))
    return parts.select("doc_id", "s.label", (-F.col("s.nc")).alias("code"), (F.get("_z", F.col("_i")) / F.col("_t")).alias("proba"))


def probabilities(jll: DataFrame, score: str = "jll") -> DataFrame:
    """Softmax over classes per document (a window bounded by the class count)."""
    w = Window.partitionBy("doc_id")
    m = F.max(score).over(w)
    z = F.exp(F.col(score) - m)
    return (jll.withColumn("_z", z)
            .withColumn("proba", F.col("_z") / F.sum("_z").over(w)).drop("_z"))


def argmax_class(scores: DataFrame, score: str = "jll") -> DataFrame:
    """Predicted class per document; ties go to the smallest class code."""
    best = F.max_by(F.struct("label", "code"), F.struct(F.col(score), (-F.col("code")).alias("nc")))
    return scores.groupBy("doc_id").agg(best.alias("b")).select(
        "doc_id", F.col("b.label").alias("predicted"), F.col("b.code").alias("predicted_code"))


# ---------------------------------------------------------------- pyspark.ml estimators

@dataclass
class MLModel:
    kind: str
    model: object
    tfidf: TfidfModel
    label_codes: DataFrame

    def predict_labels(self, rows: DataFrame) -> DataFrame:
        """``doc_id, predicted, predicted_code`` of coded rows: the model's own prediction."""
        out = self.model.transform(row_vectors(rows, self.tfidf))
        return (out.select("doc_id", F.col("prediction").cast("int").alias("code")).join(self.label_codes, "code")
                .select("doc_id", F.col("label").alias("predicted"), F.col("code").cast("int").alias("predicted_code")))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``doc_id, label, code, proba`` per class (for probability metrics)."""
        out = self.model.transform(row_vectors(rows, self.tfidf))
        probs = (out.select("doc_id", F.posexplode(vector_to_array("probability")).alias("code", "proba"))
                 .join(self.label_codes, "code"))
        return probs.select("doc_id", "label", F.col("code").cast("int").alias("code"), "proba")


def _training_frame(labelled: DataFrame, tfidf: TfidfModel, label_codes: DataFrame) -> DataFrame:
    """``doc_id, features, y, weight`` of ``doc_id, idx, tf, label`` rows."""
    w = balanced_weights(labelled, "label").select("label", "weight")
    lab = labelled.select("doc_id", "label").join(w, "label").join(label_codes.select("label", "code"), "label")
    return row_vectors(labelled, tfidf).join(lab, "doc_id").select(
        "doc_id", "features", F.col("code").cast("double").alias("y"), "weight")


def fit_logistic_regression(labelled: DataFrame, tfidf: TfidfModel, label_codes: DataFrame, c: float = LR_C,
                            max_iter: int = LR_MAX_ITER) -> softmax.SoftmaxModel:
    """Multinomial, L2, C = 1, balanced weights: the minimum of C * sum(w_i * loss_i) + ||W||^2 / 2."""
    return softmax.fit(labelled, tfidf.vocab.count(), label_codes, c, max_steps=max_iter)


def fit_decision_tree(labelled: DataFrame, tfidf: TfidfModel, label_codes: DataFrame, max_depth: int = TREE_MAX_DEPTH,
                      seed: int = TREE_SEED, max_bins: int = TREE_MAX_BINS) -> MLModel:
    """Gini tree, balanced weights.

    The reference tries every value of a feature as a threshold and grows without limit; Spark tries
    ``max_bins`` - 1 quantiles of it and stops at depth ``max_depth`` (30 is Spark's maximum), so splits may lie
    elsewhere and very deep leaves stay together.
    """
    data = _training_frame(labelled, tfidf, label_codes)
    dt = DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight",
                                impurity="gini", maxDepth=max_depth, maxBins=max_bins, seed=seed)
    return MLModel("decision_tree", dt.fit(data), tfidf, label_codes)
