"""Derived insight tables.

The reference computes these in the browser; here they are DataFrames built
from the relation, score, shelf and assignment tables.  Every join is an
equi-join on category or shelf name; shelf distances are computed only for
the shelf pairs that hold related categories (never all pairs).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .placement import _drop_g, _groups, euclid, with_stats


@dataclass(frozen=True)
class Limits:
    """Display rules; the defaults are fixed values of the reference."""
    conf_high: float = 0.7          # I1
    conf_medium: float = 0.4
    lift_tiers: tuple[tuple[float, str], ...] = (   # I2, from the highest
        (3.0, "very_strong"), (2.0, "strong"), (1.5, "moderate"), (1.2, "weak"))
    tier_default: str = "very_weak"
    near: float = 100.0             # I3, I8 pixels
    far: float = 200.0
    strong_lift: float = 1.5
    fade_min: float = 50.0          # X11
    fade_max: float = 400.0


DEFAULT = Limits()
MAP_MARGIN = 30.0                   # X10, fixed value of the reference


def confidence_tier(c: Column, limits: Limits = DEFAULT) -> Column:
    """> 0.7 high, > 0.4 medium, else low."""
    return F.when(c > limits.conf_high, "high").when(c > limits.conf_medium, "medium").otherwise("low")


def lift_tier(lift: Column, limits: Limits = DEFAULT) -> Column:
    """> 3 very_strong, > 2 strong, > 1.5 moderate, > 1.2 weak, else very_weak."""
    out = F.when(lift.isNull(), F.lit(None).cast("string"))
    for bound, name in limits.lift_tiers:
        out = out.when(lift > bound, name)
    return out.otherwise(limits.tier_default)


def first_relation(relations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (src, dst) the highest-lift relation (ties: higher confidence)."""
    return (relations.groupBy(*by, "src", "dst")
            .agg(F.max_by(F.struct("lift", "confidence"), F.struct("lift", "confidence")).alias("r"))
            .select(*by, "src", "dst", "r.lift", "r.confidence"))


def fade(distance: Column, limits: Limits = DEFAULT) -> Column:
    """X11: clamp to 50..400 and invert to 0..1."""
    clamped = F.least(F.greatest(distance, F.lit(limits.fade_min)), F.lit(limits.fade_max))
    return (F.lit(limits.fade_max) - clamped) / F.lit(limits.fade_max - limits.fade_min)


def _verdict(goal: Column, distance: Column, lift: Column, limits: Limits) -> Column:
    strong = lift > limits.strong_lift
    near, far = distance < limits.near, distance > limits.far
    return (F.when(distance.isNull(), F.lit(None).cast("string"))
            .when(goal == "maximize", F.when(near & strong, "good").when(far & strong, "bad")
                  .otherwise("neutral"))
            .otherwise(F.when(far & strong, "good").when(near & strong, "bad").otherwise("neutral")))


def _shelf_of(assignment: DataFrame, shelves: DataFrame, by: Sequence[str], suffix: str) -> DataFrame:
    """Category -> its shelf and position (J9 side)."""
    by = list(by)
    a = assignment.select(*by, "shelf", "category")
    s = shelves.select(*by, F.col("name").alias("shelf"), "x", "y")
    return a.join(s, on=[*by, "shelf"]).select(
        *by, F.col("category").alias(f"category_{suffix}"), F.col("shelf").alias(f"shelf_{suffix}"),
        F.col("x").alias(f"x_{suffix}"), F.col("y").alias(f"y_{suffix}"))


def shelf_edges(relations: DataFrame, assignment: DataFrame, shelves: DataFrame, goal: str,
                by: Sequence[str] = (), limits: Limits = DEFAULT) -> DataFrame:
    """Related pairs of assigned shelves with lift, distance, tier, fade, flag.

    fade and separation only apply to *minimize* (as in the reference).
    """
    by = list(by)
    rel = first_relation(relations, by)
    a = _shelf_of(assignment, shelves, by, "a")
    b = _shelf_of(assignment, shelves, by, "b")
    j = (rel.withColumnRenamed("src", "category_a").withColumnRenamed("dst", "category_b")
         .join(a, on=[*by, "category_a"]).join(b, on=[*by, "category_b"]))
    dist = euclid(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    g = F.lit(goal)
    minimize = g == "minimize"
    strong = F.col("lift") > limits.strong_lift
    return j.select(
        *by, "shelf_a", "shelf_b", "category_a", "category_b", "lift", "confidence",
        dist.alias("distance"), lift_tier(F.col("lift"), limits).alias("tier"),
        F.when(minimize, fade(dist, limits)).alias("fade"),
        F.when(minimize & (dist > limits.far) & strong, "good")
        .when(minimize & (dist < limits.near) & strong, "bad").alias("separation"))


def relation_matrix(relations: DataFrame, scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sparse long form of the category x category lift matrix.

    Axis position = score rank (ties by name); the diagonal is blank, so only
    off-diagonal related cells are emitted.
    """
    by = list(by)
    rel = first_relation(relations, by).where(F.col("src") != F.col("dst"))
    r = scores.select(*by, F.col("category").alias("src"), F.col("rank").alias("row_pos"))
    c = scores.select(*by, F.col("category").alias("dst"), F.col("rank").alias("col_pos"))
    return (rel.join(r, on=[*by, "src"]).join(c, on=[*by, "dst"])
            .select(*by, F.col("src").alias("row_category"), F.col("dst").alias("col_category"),
                    "row_pos", "col_pos", "lift", lift_tier(F.col("lift")).alias("tier")))


def score_chart(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Category, score, percent of the top score, rank."""
    s, g = _groups(scores, by)
    out = s.withColumn("_max", F.max("score").over(Window.partitionBy(*g)))
    return _drop_g(out.select(*g, "category", "score",
                              (F.col("score") / F.col("_max") * 100).alias("pct_of_max"), "rank"))


def category_detail(relations: DataFrame, scores: DataFrame, assignment: DataFrame,
                    by: Sequence[str] = ()) -> DataFrame:
    """Per category its score, rank, shelf and relations (long form).

    One row per (category, relation); categories without outgoing relations get one row with NULL relation
    columns.  :func:`category_detail_nested` sorts the relations.
    """
    by = list(by)
    shelf = assignment.select(*by, "category", "shelf")
    rel = relations.select(*by, F.col("src").alias("category"), F.col("dst").alias("related_category"),
                           F.col("lift").alias("related_lift"))
    rshelf = assignment.select(*by, F.col("category").alias("related_category"),
                               F.col("shelf").alias("related_shelf"))
    base = scores.select(*by, "category", "score", "rank").join(shelf, on=[*by, "category"], how="left")
    return (base.join(rel, on=[*by, "category"], how="left")
            .join(rshelf, on=[*by, "related_category"], how="left")
            .select(*by, "category", "score", "rank", "shelf", "related_category", "related_lift",
                    lift_tier(F.col("related_lift")).alias("related_tier"), "related_shelf"))


def category_detail_nested(detail: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """I6/O5 nested: one row per category, relations as an array sorted by lift desc (ties: category desc)."""
    by = list(by)
    rel = F.struct(F.col("related_lift").alias("lift"), F.col("related_category").alias("category"),
                   F.col("related_shelf").alias("shelf"), F.col("related_tier").alias("tier"))
    agg = (detail.groupBy(*by, "category", "score", "rank", "shelf")
           .agg(F.collect_list(F.when(F.col("related_category").isNotNull(), rel)).alias("rels")))
    return agg.select(*by, "category", "score", "rank", "shelf",
                      F.reverse(F.array_sort("rels")).alias("relations"))


def shelf_detail(assignment: DataFrame, relations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per assigned shelf its category, reason, score, rank and relations (long form)."""
    by = list(by)
    rel = relations.select(*by, F.col("src").alias("category"), F.col("dst").alias("related_category"),
                           F.col("lift").alias("related_lift"))
    return (assignment.select(*by, "shelf", "category", "reason", "score", "rank")
            .join(rel, on=[*by, "category"], how="left")
            .select(*by, "shelf", "category", "reason", "score", "rank", "related_category",
                    "related_lift", lift_tier(F.col("related_lift")).alias("related_tier")))


def placement_verdict(relations: DataFrame, assignment: DataFrame, shelves: DataFrame, goal: str,
                      by: Sequence[str] = (), limits: Limits = DEFAULT) -> DataFrame:
    """I8: for each related pair, both shelves (NULL if unassigned), distance and verdict.

    maximize: near (< 100) and lift > 1.5 good, far (> 200) and lift > 1.5 bad,
    otherwise neutral; minimize reversed.  No verdict without both shelves or at
    distance 0 (the reference treats a zero distance as missing).
    """
    by = list(by)
    rel = first_relation(relations, by).withColumnRenamed("src", "category_a") \
        .withColumnRenamed("dst", "category_b")
    a = _shelf_of(assignment, shelves, by, "a")
    b = _shelf_of(assignment, shelves, by, "b")
    j = rel.join(a, on=[*by, "category_a"], how="left").join(b, on=[*by, "category_b"], how="left")
    d = euclid(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    d = F.when(d != 0, d)
    return j.select(*by, "category_a", "category_b", "lift", "confidence",
                    lift_tier(F.col("lift"), limits).alias("tier"), "shelf_a", "shelf_b",
                    d.alias("distance"), _verdict(F.lit(goal), d, F.col("lift"), limits).alias("verdict"))


def shelf_positions_scaled(shelves: DataFrame, width: float = 800.0, height: float = 500.0,
                           by: Sequence[str] = ()) -> DataFrame:
    """Shelf positions scaled into a ``width x height`` box with a 30 px margin."""
    j = with_stats(shelves, by, min_x=F.min("x"), max_x=F.max("x"), min_y=F.min("y"), max_y=F.max("y"))
    rx = F.col("max_x") - F.col("min_x")
    ry = F.col("max_y") - F.col("min_y")
    sx = (F.lit(width) - 2 * MAP_MARGIN) / F.when(rx != 0, rx).otherwise(F.lit(1.0))
    sy = (F.lit(height) - 2 * MAP_MARGIN) / F.when(ry != 0, ry).otherwise(F.lit(1.0))
    return j.select(*by, "pos", "name", "x", "y",
                    ((F.col("x") - F.col("min_x")) * sx + MAP_MARGIN).alias("map_x"),
                    ((F.col("y") - F.col("min_y")) * sy + MAP_MARGIN).alias("map_y"))
