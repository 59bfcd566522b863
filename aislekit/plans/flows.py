"""E2 (basket report) and E3 (shelf placement) as DataFrame flows.

Receipts -> product categories -> category baskets -> association rules
(-> shelf placement).  Products are scored once per *distinct* product text and
joined back to the receipt items, so a product repeated across millions of
receipts costs one model evaluation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import placement as P
from ..operators import rules as R
from ..operators.ordering import row_index
from ..operators.baskets import category_baskets, duplicate_lone_basket
from ..session import cut_lineage
from ..sources.receipts import receipt_items, require_nonempty
from ..sources.shelves import require_shelves
from . import training as T


def predict_categories(products: DataFrame, product_col: str, prepared: T.Prepared,
                       model_choice: str = "naive_bayes", normalizer: str = "fold") -> DataFrame:
    """``product, category`` for the distinct products of ``products``.

    ``normalizer='fold'`` reproduces the reference's serving path (Turkish
    letters folded to ASCII, no training normaliser); ``'train'`` applies the
    training normaliser instead.  Unknown ``model_choice`` -> ValueError.
    """
    if model_choice not in C.MODEL_CHOICES:
        raise ValueError(f"unknown model {model_choice!r}; choose one of {C.MODEL_CHOICES}")
    distinct = products.select(F.col(product_col).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    # a product is scored in its row, from its text to its class
    rows = prepared.tfidf.rows(distinct.withColumn("text", F.col("doc_id")), "doc_id", "text", normalize=normalizer)
    if model_choice == "naive_bayes":
        best = C.best_class(C.score_rows(T.train_naive_bayes(prepared), rows, prepared.tfidf.vocab))
    else:
        best = T.fitted_model(prepared, model_choice).predict_labels(rows)
    return best.select(F.col("doc_id").alias("product"), F.col("predicted").alias("category"))


def receipt_predictions(receipts: DataFrame, prepared: T.Prepared, model_choice: str = "naive_bayes",
                        normalizer: str = "fold") -> DataFrame:
    """``receipt_no, receipt_id, pos, product, category`` (category NULL if unscored)."""
    items = receipt_items(receipts)
    cats = predict_categories(items, "product", prepared, model_choice, normalizer)
    keep = [c for c in items.columns if c not in ("pos", "product")]
    return items.join(cats, "product", "left").select(*keep, "pos", "product", "category")


def receipt_baskets(predictions: DataFrame) -> DataFrame:
    """Per receipt the set of predicted categories (A5)."""
    return category_baskets(predictions, "receipt_id", "category", out_basket="receipt_id")


def receipt_results(predictions: DataFrame) -> DataFrame:
    """One JSON object a receipt, ``{receipt_id, items: [{product, category}]}`` or, where no product could be
    classified, ``{receipt_id, error}``, with its place ``rank`` by receipt id as text (O4)."""
    item = F.struct("pos", "product", "category")
    per = predictions.groupBy("receipt_no", "receipt_id").agg(
        F.sort_array(F.collect_list(item)).alias("all"), F.count("category").alias("n"))
    items = F.transform("all", lambda x: F.struct(x["product"].alias("product"), x["category"].alias("category")))
    good = F.to_json(F.struct("receipt_id", items.alias("items")))
    bad = F.to_json(F.struct("receipt_id", F.lit("no product could be classified").alias("error")))
    out = per.select("receipt_no", "receipt_id", F.when(F.col("n") > 0, good).otherwise(bad).alias("json"))
    # only the keys are put in order; the documents meet their rank by key
    ranks = row_index(per.select("receipt_no", "receipt_id"), ["receipt_id", "receipt_no"], "rank")
    return out.join(ranks, ["receipt_no", "receipt_id"])


def receipt_json(predictions: DataFrame) -> DataFrame:
    """JSON lines ``{receipt_id, pos, product, category}`` sorted by receipt id as text
    and position.

    Each line is one item, so no row grows with a receipt's size and no single
    document holds every receipt; ``write.json`` keeps the output distributed
    and the sort is a range-partitioned distributed sort.
    """
    return (predictions.select("receipt_id", "pos", F.to_json(F.struct(
        "receipt_id", "pos", "product", "category")).alias("json"))
        .orderBy("receipt_id", "pos"))


@dataclass
class BasketReport:
    predictions: DataFrame
    analysis: R.RuleAnalysis

    def summary(self) -> DataFrame:
        return self.analysis.summary()

    def top_rules(self, k: int = R.TOP_RULES) -> DataFrame:
        if self.analysis.positive is None:
            return self.predictions.sparkSession.createDataFrame(
                [], "if_categories array<string>, then_categories array<string>, support double, "
                    "confidence double, lift double")
        return R.rules_output(R.top_rules(self.analysis.positive, k))


def basket_report(receipts: DataFrame, prepared: T.Prepared, model_choice: str = "naive_bayes",
                  support: float | None = None) -> BasketReport:
    """Predictions per receipt plus the association analysis of their category baskets.

    Receipts without any item are an error (S2).
    """
    pred = cut_lineage(receipt_predictions(require_nonempty(receipts), prepared, model_choice))
    baskets = receipt_baskets(pred.where(F.col("category").isNotNull()))
    return BasketReport(pred, R.analyze(baskets, support=support))


@dataclass
class ShelfPlan:
    """E3 result.  ``status`` is R2's outcome; anything but 'ok' is the reference's
    error response, and then every shelf is unassigned (R9)."""

    analysis: R.RuleAnalysis
    status: str
    n_positive: int
    shelves: DataFrame
    scores: DataFrame | None
    relations: DataFrame | None
    assignment: DataFrame | None
    unassigned: DataFrame

    def summary(self) -> DataFrame:
        """A21 + counts: status, total_transactions, min_support_used, total_positive_rules_found,
        assigned_shelves, unassigned_shelves."""
        if self.assignment is None:
            assigned = self.shelves.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"))
        else:
            assigned = self.assignment.agg(F.count(F.lit(1)).alias("a"))
        total = self.shelves.agg(F.count(F.lit(1)).alias("t"))
        both = assigned.unionByName(total.select(F.col("t").alias("a")).withColumn("_t", F.lit(1)),
                                    allowMissingColumns=True)
        row = both.agg(F.max(F.when(F.col("_t").isNull(), F.col("a"))).alias("a"),
                       F.max(F.when(F.col("_t") == 1, F.col("a"))).alias("t"))
        return row.select(F.lit(self.status).alias("status"),
                          F.lit(self.analysis.n).cast("long").alias("total_transactions"),
                          F.lit(self.analysis.choice.min_support).cast("double").alias("min_support_used"),
                          F.lit(self.n_positive).cast("long").alias("total_positive_rules_found"),
                          F.col("a").alias("assigned_shelves"), (F.col("t") - F.col("a")).alias("unassigned_shelves"))


def shelf_optimization(receipts: DataFrame, shelves: DataFrame, prepared: T.Prepared, goal: str,
                       model_choice: str = "naive_bayes", strict: bool = False,
                       support: float | None = None) -> ShelfPlan:
    """Receipts -> categories -> baskets (U4) -> rules -> placement.

    ``support=None`` is the reference's fallback.  Receipts without any item, no shelf, or two shelves of one
    name are errors (S2, S5).

    When the rule analysis ends without positive rules the reference answers
    with an error; ``strict=True`` raises ValueError, otherwise the plan carries
    the status and leaves every shelf unassigned.
    """
    if goal not in P.GOALS:
        raise ValueError(f"goal must be one of {P.GOALS}")
    shelves = require_shelves(shelves)
    # kept as in :func:`basket_report`: lines meet their products in one job, baskets are gathered in the next
    pred = cut_lineage(receipt_predictions(require_nonempty(receipts), prepared, model_choice).select("receipt_id", "category"))
    baskets = cut_lineage(receipt_baskets(pred.where(F.col("category").isNotNull())).select("items"))
    n = baskets.count()
    if n == 0:
        raise ValueError("no receipt holds a product that could be classified")
    baskets = duplicate_lone_basket(baskets, n)   # U4
    a = R.analyze(baskets, support=support)
    n_pos = a.positive.count() if a.positive is not None else 0
    status = (R.STATUS_INSUFFICIENT if a.n <= 1 else R.STATUS_NO_ITEMSETS if a.n_itemsets == 0
              else R.STATUS_NO_RULES if a.n_rules == 0 else R.STATUS_NO_POSITIVE if n_pos == 0
              else R.STATUS_OK)
    if status != R.STATUS_OK:
        if strict:
            raise ValueError(f"category assignment impossible: {status}")
        msg = P.MSG_NO_POSITIVE if status == R.STATUS_NO_POSITIVE else P.MSG_NO_RULES
        return ShelfPlan(a, status, n_pos, shelves, None, None, None, P.all_unassigned(shelves, msg))
    rel = P.category_relations(a.positive)
    scores = P.category_scores(a.positive)
    assignment = P.place(shelves, scores, goal)
    return ShelfPlan(a, status, n_pos, shelves, scores, rel, assignment,
                     P.unassigned_shelves(shelves, assignment))
