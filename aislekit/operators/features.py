"""Catalogue features.

TF-IDF is kept as coded rows (``termrows``): a document is one row with its term codes, counts and weights.
:func:`termrows.long_rows` gives the long form for relational use, :func:`row_vectors` ``SparseVector`` features for
``pyspark.ml``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage, small, spread
from . import heavy_hitters as H
from . import selection as S
from . import termrows as R

# Fixed values of the reference's preprocessing.
MAX_FEATURES = 5000      # vocabulary ceiling, word 1-2 grams
TEST_SIZE = 0.2          # hold-out share
SEED = 42                # split seed
MIN_CLASS_ROWS = 2       # classes with fewer rows are removed before the split


# ---------------------------------------------------------------- class table operators

def class_counts(df: DataFrame, label: str) -> DataFrame:
    """A1: rows per class."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def top_classes(counts: DataFrame, k: int = 10) -> DataFrame:
    """O3: the k largest classes (ties by label), a bounded top-k."""
    return counts.orderBy(F.col("n").desc(), F.col("label")).limit(k)


def rare_class_summary(counts: DataFrame, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """A2/A3/A4: classes, singleton classes, kept rows, removed rows."""
    return counts.agg(F.count(F.lit(1)).alias("n_classes"),
                      F.count_if(F.col("n") == 1).alias("n_singletons"),
                      F.coalesce(F.sum(F.when(F.col("n") >= min_rows, F.col("n"))), F.lit(0)).alias("kept_rows"),
                      F.coalesce(F.sum(F.when(F.col("n") < min_rows, F.col("n"))), F.lit(0)).alias("removed_rows"))


def drop_rare_classes(df: DataFrame, label: str, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """keep rows whose class has at least ``min_rows`` rows (left-semi join to the class table)."""
    keep = class_counts(df, label).where(F.col("n") >= min_rows).select(F.col("label").alias(label))
    return df.join(keep, on=label, how="left_semi")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """M7: ``label, code`` with codes 0.. in sorted label order (LabelEncoder).

    The distinct-label table is small by nature; its rank window runs over it only.
    """
    labels = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return labels.withColumn("code", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


# ---------------------------------------------------------------- tf-idf

def doc_terms(docs: DataFrame, id_col: str, text_col: str, normalize: str = "train") -> DataFrame:
    """M1/M2/M4: ``(doc_id, term, tf)`` for all word 1- and 2-grams, whatever the vocabulary.

    A document's terms are counted inside its row (runs of the sorted terms): neither text nor tokens are shuffled.  Rows
    without terms are dropped after the explode: a filter before it would be pushed below the text work and repeat it.
    """
    terms = R.token_rows(docs, id_col, text_col, normalize).select(
        "doc_id", F.sort_array(X.word_ngrams_1_2("tokens")).alias("_s"))
    starts = F.filter(F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)),
                      lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = terms.select("doc_id", "_s", starts.alias("_at"))
    counted = F.transform("_at", lambda i, j: F.struct(
        F.get("_s", i).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_s")) - i).cast("long").alias("tf")))
    return runs.select("doc_id", F.explode_outer(counted).alias("_c")).where("_c is not null").select("doc_id", "_c.term", "_c.tf")


@dataclass
class TfidfModel:
    """Vocabulary with idf; ``vocab`` has ``term, idx, df, idf``; ``n_docs`` = fitted rows."""

    vocab: DataFrame
    n_docs: int
    normalize: str = "train"

    def terms(self) -> list[tuple[str, float]]:
        """(term, idf) by idx: at most ``MAX_FEATURES`` rows."""
        return [(r["term"], r["idf"]) for r in self.vocab.select("term", "idf", "idx").orderBy("idx").collect()]

    def rows(self, docs: DataFrame, id_col: str, text_col: str, normalize: str | None = None) -> DataFrame:
        """``doc_id, idx, tf, w``, one row a document; unknown terms vanish."""
        known = self.terms()
        tokens = R.letter_rows(docs, id_col, text_col, normalize or self.normalize)
        return R.weigh_rows(R.code_rows(tokens, [t for t, _ in known]), [i for _, i in known])

    def transform(self, docs: DataFrame, id_col: str, text_col: str,
                  normalize: str | None = None) -> DataFrame:
        """The same in long form: ``(doc_id, term, idx, tf, tfidf)``."""
        return R.long_rows(self.rows(docs, id_col, text_col, normalize), self.vocab)


def fit_rows(tokens: DataFrame, max_features: int = MAX_FEATURES, normalize: str = "train", fit_ids: DataFrame | None = None,
             capacity: int = H.CAPACITY) -> tuple[TfidfModel, DataFrame]:
    """M3/M5 on token rows: the model, and ``doc_id, idx, tf, w`` of all rows (kept).

    Vocabulary = ``max_features`` terms with the highest corpus count (ties by term), smoothed idf
    ``ln((1 + n) / (1 + df)) + 1``, fitted on the documents of ``fit_ids`` (default: all).  A 2-gram is no more frequent than
    either of its words, so a term of the vocabulary has only words that are among the ``max_features`` most frequent words or tie with the
    last of them: heavy-hitter summaries find these, documents are kept as sequences of their numbers, summaries of these leave
    candidates, and their exact counts decide.  Texts are read twice, and no term is shuffled but those of the summaries and counts.
    """
    def fitted(df: DataFrame) -> DataFrame:
        return df if fit_ids is None else df.join(fit_ids, "doc_id", "left_semi")

    words = H.candidates(fitted(tokens).select("tokens"), R.word_values, max_features, capacity)
    seqs = cut_lineage(R.number_words(tokens, words))
    counted = fitted(seqs)
    n, size = counted.count(), len(words)
    grams = H.candidates(counted.select("seq"), R.gram_number_values(size), max_features, capacity, H.Numbers)
    found = sorted((R.gram_name(g, words), g) for g in grams)
    # codes are places in the sorted candidates, so the smaller code is the smaller term
    top = R.gram_totals(counted, size, [g for _, g in found]).orderBy(F.col("total").desc(), F.col("code")).limit(max_features).collect()
    top = sorted(top, key=lambda r: r["code"])
    rows = [(found[r["code"]][0], i, r["df"], math.log((1.0 + n) / (1.0 + r["df"])) + 1.0, r["total"]) for i, r in enumerate(top)]
    vocab = tokens.sparkSession.createDataFrame(rows, "term string, idx int, df long, idf double, total long")
    weighed = cut_lineage(R.weigh_rows(R.count_rows(seqs, size, [found[r["code"]][1] for r in top]), [r[3] for r in rows]))
    return TfidfModel(cut_lineage(vocab), n, normalize), weighed


def fit_tfidf(docs: DataFrame, id_col: str, text_col: str, max_features: int = MAX_FEATURES,
              normalize: str = "train") -> TfidfModel:
    """M3/M5: :func:`fit_rows` from texts, the model only."""
    return fit_rows(R.letter_rows(spread(docs.select(id_col, text_col)), id_col, text_col, normalize), max_features, normalize)[0]


def row_vectors(rows: DataFrame, model: TfidfModel) -> DataFrame:
    """``doc_id, features`` (``SparseVector``) of ``doc_id, idx, tf`` rows, for ``pyspark.ml``.

    Spark ML transformers do the work JVM-side: ``CountVectorizerModel`` counts the codes, ``ElementwiseProduct``
    multiplies by idf and ``Normalizer`` applies the L2 norm.
    """
    known = model.terms()
    codes = F.flatten(F.transform(F.arrays_zip("idx", "tf"), lambda x: F.array_repeat(x["idx"].cast("string"), x["tf"])))
    cv = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(known))], inputCol="_terms", outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense([i for _, i in known]), inputCol="_tf", outputCol="_w")
    nz = Normalizer(p=2.0, inputCol="_w", outputCol="features")
    base = rows.select("doc_id", codes.alias("_terms"))
    return nz.transform(ep.transform(cv.transform(base))).select("doc_id", "features")


def tfidf_vectors(docs: DataFrame, id_col: str, text_col: str, model: TfidfModel) -> DataFrame:
    """``doc_id, features`` of texts, with the same numbers as :meth:`TfidfModel.rows`."""
    return row_vectors(model.rows(docs, id_col, text_col), model)


# ---------------------------------------------------------------- split and weights

def stratified_split(df: DataFrame, id_col: str, label: str, test_size: float = TEST_SIZE,
                     seed: int = SEED) -> DataFrame:
    """Exact stratified hold-out; adds ``split`` = 'train' | 'test'.

    Sizes follow the reference's splitter: n_test = ceil(test_size * N); train
    quotas per class = floor of the proportional share plus one for the largest
    remainders (ties: label order); test quota = class rows - train quota.  Which
    rows go to test: the first ``quota`` rows of the class in (md5(seed|id), id) order.  Selection finds each class's last
    test key (``selection.quota_thresholds``, on the hash's first 60 bits) without sorting rows; a row then compares its own
    key, and only rows with just that key, one or two for a class, are put in order.
    """
    counts = class_counts(df, label)
    n_total = int(counts.agg(F.sum("n")).first()[0] or 0)
    n_test = math.ceil(test_size * n_total) if n_total else 0
    n_train = n_total - n_test
    cont = F.col("n") * F.lit(float(n_train)) / F.lit(float(max(n_total, 1)))
    q = counts.withColumn("_cont", cont).withColumn("_floor", F.floor("_cont").cast("long"))
    need = n_train - int(q.agg(F.sum("_floor")).first()[0] or 0)
    # the class table is small by nature: this window orders classes, not rows
    w = Window.orderBy((F.col("_cont") - F.col("_floor")).desc(), F.col("label"))
    quotas = (q.withColumn("_r", F.row_number().over(w))
              .select(F.col("label").alias(label),
                      (F.col("n") - F.col("_floor") - F.when(F.col("_r") <= need, 1).otherwise(0)).alias("quota")))
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_h", hashed).withColumn("_k", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    last = S.quota_thresholds(keyed.select(label, "_k"), quotas, label, "_k")
    edge = keyed.join(small(last.withColumnRenamed("threshold", "_k")), [label, "_k"]).select(label, "_h", id_col, "left")
    nth = F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col))
    edge = edge.withColumn("_nth", nth).where("_nth <= left").select(F.col(label).alias("_l"), F.col("_h").alias("_eh"), F.col(id_col).alias("_e"))
    marked = keyed.join(small(last.drop("left")), label, "left").join(
        small(cut_lineage(edge)), (F.col(label) == F.col("_l")) & (F.col("_h") == F.col("_eh")) & (F.col(id_col) == F.col("_e")), "left")
    test = (F.col("_k") < F.col("threshold")) | F.col("_e").isNotNull()
    return marked.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_k", "threshold", "_l", "_eh", "_e")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class weight n / (k * n_c) (``class_weight='balanced'``)."""
    counts = class_counts(df, label)
    agg = counts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k")).first()
    n, k = int(agg["N"] or 0), int(agg["k"] or 0)
    return counts.select(F.col("label"), "n",
                         (F.lit(float(n)) / (F.lit(float(k)) * F.col("n"))).alias("weight"))
