"""Sinks and sources for the trained artefacts.

The reference pickles its vectoriser, label encoder, train/test matrices and
models into single files.  Here every artefact is a table or a Spark ML model
directory, written and read in parallel:

* train/test sets: long TF-IDF rows with the label, ``partitionBy("split")``;
* vectoriser: vocabulary table (term, idx, df, idf) + the fitted row count;
* label encoder: (label, code);
* Naive Bayes: its class table and (class, term) table;
* logistic regression: its parameters by class; decision tree: ``model.write().overwrite().save``.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import features as FE
from ..operators import termrows as TR
from ..operators.softmax import SoftmaxModel
from . import training as T


def _meta_path(root: str) -> str:
    return os.path.join(root, "meta")


def save_prepared(p: T.Prepared, root: str) -> None:
    """S7 + vectoriser and encoder of S8."""
    spark = p.split.sparkSession
    # a document meets its split as one row, before it becomes a row for each term
    sets = TR.long_rows(p.coded.join(p.split, "doc_id"), p.tfidf.vocab, "label", "split").select("doc_id", "label", "split", "term", "idx", "tfidf")
    sets.write.mode("overwrite").partitionBy("split").parquet(os.path.join(root, "sets"))
    p.tfidf.vocab.write.mode("overwrite").parquet(os.path.join(root, "vocab"))
    p.codes.write.mode("overwrite").parquet(os.path.join(root, "codes"))
    p.split.write.mode("overwrite").parquet(os.path.join(root, "split"))
    meta = {"n_docs": p.tfidf.n_docs, "normalize": p.tfidf.normalize,
            "id_col": p.id_col, "text_col": p.text_col}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(_meta_path(root))


def load_artifacts(spark: SparkSession, root: str) -> dict:
    """Read what :func:`save_prepared` wrote: sets, vocabulary model, codes, split."""
    meta = json.loads(spark.read.text(_meta_path(root)).first()[0])
    vocab = spark.read.parquet(os.path.join(root, "vocab"))
    return {
        "sets": spark.read.parquet(os.path.join(root, "sets")),
        "tfidf": FE.TfidfModel(vocab, int(meta["n_docs"]), meta["normalize"]),
        "codes": spark.read.parquet(os.path.join(root, "codes")),
        "split": spark.read.parquet(os.path.join(root, "split")),
        "meta": meta,
    }


def save_naive_bayes(m: C.NaiveBayesModel, root: str) -> None:
    m.classes.write.mode("overwrite").parquet(os.path.join(root, "classes"))
    m.features.write.mode("overwrite").parquet(os.path.join(root, "features"))
    spark = m.classes.sparkSession
    spark.createDataFrame([(json.dumps({"alpha": m.alpha, "vocab_size": m.vocab_size}),)], "meta string") \
        .write.mode("overwrite").text(_meta_path(root))


def load_naive_bayes(spark: SparkSession, root: str) -> C.NaiveBayesModel:
    meta = json.loads(spark.read.text(_meta_path(root)).first()[0])
    return C.NaiveBayesModel(spark.read.parquet(os.path.join(root, "classes")),
                             spark.read.parquet(os.path.join(root, "features")),
                             float(meta["alpha"]), int(meta["vocab_size"]))


def save_ml_model(m: C.MLModel | SoftmaxModel, root: str) -> None:
    if isinstance(m, SoftmaxModel):
        rows = [(code, row.tolist()) for code, row in enumerate(m.theta)]
        m.label_codes.sparkSession.createDataFrame(rows, "code int, theta array<double>").write.mode("overwrite").parquet(os.path.join(root, "model"))
    else:
        m.model.write().overwrite().save(os.path.join(root, "model"))
    m.label_codes.write.mode("overwrite").parquet(os.path.join(root, "codes"))
    spark = m.label_codes.sparkSession
    spark.createDataFrame([(json.dumps({"kind": m.kind}),)], "meta string") \
        .write.mode("overwrite").text(_meta_path(root))


def load_ml_model(spark: SparkSession, root: str, tfidf: FE.TfidfModel) -> C.MLModel | SoftmaxModel:
    kind = json.loads(spark.read.text(_meta_path(root)).first()[0])["kind"]
    codes = spark.read.parquet(os.path.join(root, "codes"))
    if kind == "logistic_regression":
        rows = spark.read.parquet(os.path.join(root, "model")).orderBy("code").collect()  # one for each class
        return SoftmaxModel(np.array([r["theta"] for r in rows]), codes)
    return C.MLModel(kind, DecisionTreeClassificationModel.load(os.path.join(root, "model")), tfidf, codes)


def split_sets(sets: DataFrame, which: str) -> DataFrame:
    """Partition-pruned read of one saved set (``split`` is the partition column)."""
    return sets.where(F.col("split") == which)
