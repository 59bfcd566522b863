"""E1 — batch training and evaluation as DataFrame functions.

prepare: F1 dropna -> TF-IDF fitted on all rows (X1-normalised, as the
reference does, leakage included) -> label codes -> F5 rare classes -> M9 split.
Then Naive Bayes / logistic regression / decision tree, scored on the hold-out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import termrows as TR
from ..session import cut_lineage, release, spread


@dataclass
class Prepared:
    docs: DataFrame          # id, text, label (after F1)
    codes: DataFrame         # label, code
    tfidf: FE.TfidfModel
    coded: DataFrame         # doc_id, idx, tf, w (all rows, one a document, checkpointed)
    split: DataFrame         # doc_id, label, split (after F5, checkpointed)
    id_col: str = "doc_id"
    text_col: str = "text"
    label_col: str = "label"
    _cache: dict = field(default_factory=dict)

    @property
    def weights(self) -> DataFrame:
        """The coded rows in long form: doc_id, term, idx, tf, tfidf."""
        return TR.long_rows(self.coded, self.tfidf.vocab)

    def coded_of(self, which: str) -> DataFrame:
        return self.coded.join(self.rows(which).select("doc_id"), "doc_id", "left_semi")

    def rows(self, which: str) -> DataFrame:
        return self.split.where(F.col("split") == which).select("doc_id", "label")

    def docs_of(self, which: str) -> DataFrame:
        ids = self.rows(which).select(F.col("doc_id").alias(self.id_col))
        return self.docs.join(ids, self.id_col, "left_semi")


def prepare(df: DataFrame, id_col: str, text_col: str, label_col: str,
            max_features: int = FE.MAX_FEATURES, fit_on: str = "all") -> Prepared:
    """``fit_on='all'`` reproduces the reference (vocabulary and idf see every row);
    ``'train'`` fits them on the training split only."""
    docs = df.select(id_col, text_col, F.col(label_col).alias("label")).dropna(subset=[text_col, "label"])
    # the narrow (id, label) table is read from the text once and reused by every label step
    labels = cut_lineage(docs.select(id_col, "label"))
    codes = cut_lineage(FE.label_codes(labels, "label"))
    kept = FE.drop_rare_classes(labels, "label")
    split = cut_lineage(FE.stratified_split(kept, id_col, "label")
                        .select(F.col(id_col).alias("doc_id"), "label", "split"))
    fit_ids = None if fit_on == "all" else split.where("split = 'train'").select("doc_id")
    model, coded = FE.fit_rows(TR.letter_rows(spread(docs.select(id_col, text_col)), id_col, text_col, "train"), max_features, "train", fit_ids)
    release(df.sparkSession)  # the numbered words are no longer read
    return Prepared(docs, codes, model, coded, split, id_col, text_col, "label")


def vocab_size(p: Prepared) -> int:
    if "V" not in p._cache:
        p._cache["V"] = p.tfidf.vocab.count()
    return p._cache["V"]


def train_naive_bayes(p: Prepared) -> C.NaiveBayesModel:
    if "nb" not in p._cache:
        labelled = p.coded.join(p.rows("train"), "doc_id")
        p._cache["nb"] = C.fit_naive_bayes_rows(labelled, p.codes, p.tfidf.vocab)
    return p._cache["nb"]


def nb_holdout(p: Prepared) -> tuple[DataFrame, DataFrame]:
    """Hold-out predictions ``(doc_id, y, p)`` and probabilities ``(doc_id, label, proba)``; scored once."""
    if "nb_scores" not in p._cache:
        p._cache["nb_scores"] = cut_lineage(C.score_rows(train_naive_bayes(p), p.coded_of("test"), p.tfidf.vocab))
    scores, test = p._cache["nb_scores"], p.rows("test")
    pred = C.best_class(scores).join(test, "doc_id").select("doc_id", F.col("label").alias("y"), F.col("predicted").alias("p"))
    return pred, C.score_probabilities(scores).select("doc_id", "label", "proba")


def fitted_model(p: Prepared, kind: str) -> C.MLModel:
    """Logistic regression or decision tree fitted once per prepared catalogue."""
    key = f"ml_{kind}"
    if key not in p._cache:
        fits = {"logistic_regression": C.fit_logistic_regression, "decision_tree": C.fit_decision_tree}
        if kind not in fits:
            raise ValueError(kind)
        p._cache[key] = fits[kind](p.coded.join(p.rows("train"), "doc_id"), p.tfidf, p.codes)
    return p._cache[key]


def ml_holdout(p: Prepared, kind: str) -> tuple[DataFrame, DataFrame]:
    m = fitted_model(p, kind)
    test = p.rows("test")
    rows = p.coded_of("test")
    proba = m.predict(rows)
    pred = (m.predict_labels(rows).join(test, "doc_id")
            .select("doc_id", F.col("label").alias("y"), F.col("predicted").alias("p")))
    return pred, proba.select("doc_id", "label", "proba")


def holdout(p: Prepared, kind: str) -> tuple[DataFrame, DataFrame]:
    if kind == "naive_bayes":
        return nb_holdout(p)
    return ml_holdout(p, kind)


def compare_models(p: Prepared, kinds=C.MODEL_CHOICES) -> DataFrame:
    """Accuracy, weighted precision, log loss and ROC-AUC per model, one long table."""
    frames = []
    for k in kinds:
        pred, proba = holdout(p, k)
        pred = cut_lineage(pred.withColumn("model", F.lit(k)))
        proba = cut_lineage(proba.withColumn("model", F.lit(k)))
        frames.append((pred, proba))
    pred = frames[0][0]
    proba = frames[0][1]
    for a, b in frames[1:]:
        pred, proba = pred.unionByName(a), proba.unionByName(b)
    acc = E.accuracy(pred, ["model"])
    wp = E.weighted_precision(pred, ["model"])
    ll = E.log_loss(pred, proba, by=["model"]).select("model", "log_loss")
    auc = E.roc_auc_ovr(pred, proba, by=["model"]).select("model", "roc_auc")
    return acc.join(wp, "model").join(ll, "model").join(auc, "model")
