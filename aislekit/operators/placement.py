"""Category scores and shelf placement.

Every function takes an optional ``by`` list (e.g. a store id).  With ``by``
each rank, centroid and pairing is computed per group, so one job places all
stores; without it the whole input is one group, as in the reference.  Ranks
use windows partitioned by the group: their size is bounded by the number of
categories or shelves of one store, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference: goals and the explanation texts it attaches.
GOALS = ("maximize", "minimize")
REASON_MAXIMIZE = "Yüksek ilişki puanı"
REASON_EVEN = "İlişkili kategorilerden uzaklaştırma (çift indeksli raf)"
REASON_ODD = "İlişkili kategorilerden uzaklaştırma (tek indeksli raf)"
MSG_NO_RULES = "Birliktelik analizi kuralları bulunamadığı için kategori ataması yapılamadı."
MSG_NO_POSITIVE = "Pozitif birliktelik kuralları bulunamadığı için kategori ataması yapılamadı."
MSG_UNASSIGNED = "Bazı raflara yeterli kategori bulunamadığı için atama yapılamadı."

_G = "_grp_all"


def _groups(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Make sure there is at least one group column (a constant when ``by`` is empty)."""
    by = list(by)
    if by:
        return df, by
    return df.withColumn(_G, F.lit(0)), [_G]


def _drop_g(df: DataFrame) -> DataFrame:
    return df.drop(_G) if _G in df.columns else df


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance."""
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def category_relations(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One edge per (antecedent item, consequent item) of each rule (multi-edges kept)."""
    return (rules.select(*by, F.explode("if_categories").alias("src"), "then_categories",
                         "lift", "confidence")
            .select(*by, "src", F.explode("then_categories").alias("dst"), "lift", "confidence"))


def category_scores(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R4/A10 + W1/O6: score = sum of lift over rules naming the category on either side;
    rank 1 = highest score (ties by category name)."""
    by = list(by)
    s = (rules.select(*by, F.explode(F.concat("if_categories", "then_categories")).alias("category"),
                      "lift")
         .groupBy(*by, "category").agg(F.sum("lift").alias("score")))
    s, g = _groups(s, by)
    w = Window.partitionBy(*g).orderBy(F.col("score").desc(), F.col("category"))
    return _drop_g(s.withColumn("rank", F.row_number().over(w)))


def with_stats(shelves: DataFrame, by: Sequence[str], **stats: Column) -> DataFrame:
    """``shelves`` with aggregates over each group (or over all), computed apart from the rows: no window
    gathers a group."""
    if by:
        return shelves.join(shelves.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), list(by))
    one = shelves.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s")).scalar()
    return shelves.withColumn("_s", one).select(*shelves.columns, "_s.*")


def shelf_centre_distance(shelves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distance of each shelf to the centroid of its group's shelves."""
    out = with_stats(shelves, by, cx=F.avg("x"), cy=F.avg("y"))
    return out.withColumn("distance_to_center", euclid(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")))


def shelf_centre(shelves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroid per group."""
    return shelves.groupBy(*by).agg(F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))


def place(shelves: DataFrame, scores: DataFrame, goal: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per assigned shelf.

    Columns: (by), pos, shelf, category, reason, score, rank, distance_to_center, grp.

    * maximize (R7): shelves ranked by distance to the centre (ties: input
      position) receive categories of the same score rank (J5);
    * minimize (R8): even shelves get even-ranked categories and odd get odd,
      which is exactly "shelf at input position p gets score rank p + 1" (R13, J6).
    """
    if goal not in GOALS:
        raise ValueError(f"goal must be one of {GOALS}")
    by = list(by)
    if goal == "maximize":
        d = shelf_centre_distance(shelves, by)
        if not by:  # no more shelves than categories get one: a bounded top-k, then ranked
            d = d.orderBy("distance_to_center", "pos").limit(scores.count())
        d, g = _groups(d, by)
        w = Window.partitionBy(*g).orderBy("distance_to_center", "pos")
        ranked = _drop_g(d.withColumn("rank", F.row_number().over(w)))
        out = ranked.join(scores, on=[*by, "rank"])
        return out.select(*by, "pos", F.col("name").alias("shelf"), "category",
                          F.lit(REASON_MAXIMIZE).alias("reason"), "score", "rank",
                          "distance_to_center", F.lit(None).cast("string").alias("grp"))
    ranked = shelves.withColumn("rank", (F.col("pos") + 1).cast("int"))
    even = (F.col("pos") % 2) == 0
    out = ranked.join(scores, on=[*by, "rank"])
    return out.select(*by, "pos", F.col("name").alias("shelf"), "category",
                      F.when(even, F.lit(REASON_EVEN)).otherwise(F.lit(REASON_ODD)).alias("reason"),
                      "score", "rank", F.lit(None).cast("double").alias("distance_to_center"),
                      F.when(even, F.lit("even")).otherwise(F.lit("odd")).alias("grp"))


def place_by_parity_groups(shelves: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R8 written literally (J6): parity group + index inside the group on both sides.

    Kept to check R13 (it must equal :func:`place` with ``goal='minimize'``).
    """
    by = list(by)
    sh = shelves.select(*by, "pos", "name", (F.col("pos") % 2).alias("par"),
                        F.floor(F.col("pos") / 2).alias("idx"))
    sc = scores.select(*by, "category", "score", "rank", ((F.col("rank") - 1) % 2).alias("par"),
                       F.floor((F.col("rank") - 1) / 2).alias("idx"))
    j = sh.join(sc, on=[*by, "par", "idx"])
    return j.select(*by, "pos", F.col("name").alias("shelf"), "category", "score",
                    (F.col("idx") * 2 + F.col("par") + 1).cast("int").alias("rank"))


def unassigned_shelves(shelves: DataFrame, assignment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shelves without a category, with the reference's message."""
    by = list(by)
    left = shelves.select(*by, "pos", F.col("name").alias("shelf"))
    return (left.join(assignment.select(*by, "pos"), on=[*by, "pos"], how="left_anti")
            .withColumn("message", F.lit(MSG_UNASSIGNED)))


def all_unassigned(shelves: DataFrame, message: str = MSG_NO_RULES,
                   by: Sequence[str] = ()) -> DataFrame:
    """R9 whole-input failure: without (positive) rules every shelf stays empty."""
    return shelves.select(*by, "pos", F.col("name").alias("shelf"), F.lit(message).alias("message"))


def recommendations_in_shelf_order(shelves: DataFrame, assignment: DataFrame,
                                   by: Sequence[str] = ()) -> DataFrame:
    """Assigned shelves in their input order (unassigned ones skipped)."""
    by = list(by)
    return (shelves.select(*by, "pos", F.col("name").alias("shelf"))
            .join(assignment.select(*by, "pos", "category"), on=[*by, "pos"])
            .orderBy(*by, "pos"))
