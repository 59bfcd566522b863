"""Category baskets and the support threshold."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference: first threshold 0.1, then 2/N, then 1/N.
FIRST_SUPPORT = 0.1


def category_baskets(lines: DataFrame, basket_col: str, category_col: str,
                     out_basket: str = "basket_id") -> DataFrame:
    """A5: one row per basket with its sorted distinct categories.

    ``collect_set`` aggregates map-side first, so a hot basket ships at most one
    set of distinct categories per map partition, never its raw lines.
    """
    return (lines.where(F.col(category_col).isNotNull())
            .groupBy(F.col(basket_col).alias(out_basket))
            .agg(F.array_sort(F.collect_set(F.col(category_col).cast("string"))).alias("items")))


def duplicate_lone_basket(baskets: DataFrame, n: int) -> DataFrame:
    """U4: a single basket is duplicated so that N = 2 (placement flow only)."""
    return baskets.unionByName(baskets) if n == 1 else baskets


def min_count_for(support: float, n: int) -> int:
    """Smallest count c with c / n >= support, in the reference's float test."""
    if n <= 0:
        return 1
    c = max(1, math.ceil(support * n))
    while c > 1 and (c - 1) / n >= support:
        c -= 1
    while c / n < support:
        c += 1
    return c


@dataclass(frozen=True)
class SupportChoice:
    n_transactions: int
    max_item_count: int
    min_support: float
    min_count: int


def basket_patterns(baskets: DataFrame) -> DataFrame:
    """``items, w``: baskets with the same items as one row, and how many they are.  An item twice in a basket is an error."""
    merged = baskets.groupBy(F.array_sort("items").alias("items")).agg(F.count(F.lit(1)).alias("w"))
    twice = F.size(F.array_distinct("items")) < F.size("items")
    return merged.select(F.when(twice, F.raise_error(F.lit("Items in a transaction must be unique"))).otherwise(F.col("items")).alias("items"), "w")


def item_counts(patterns: DataFrame) -> DataFrame:
    """``item, freq`` of merged baskets."""
    return patterns.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("freq"))


def choose_support(n: int, max_item_count: int, support: float | None = None) -> SupportChoice:
    """The reference tries 0.1, then 2/N, then 1/N while nothing is frequent.

    An itemset is frequent at threshold s only if some single item is, so the
    first threshold that yields anything follows from the top item count alone:
    ``10*top >= N -> 0.1; top >= 2 -> 2/N; else 1/N``.
    """
    if support is not None:
        return SupportChoice(n, max_item_count, support, min_count_for(support, n))
    if n <= 0:
        return SupportChoice(n, max_item_count, FIRST_SUPPORT, 1)
    if max_item_count >= min_count_for(FIRST_SUPPORT, n):
        s = FIRST_SUPPORT
    elif n >= 2 and max_item_count >= 2:
        s = 2 / n
    else:
        s = 1 / n
    return SupportChoice(n, max_item_count, s, min_count_for(s, n))


def support_choice_frame(baskets: DataFrame, basket_set: str | None = None) -> DataFrame:
    """A8 as a one-row DataFrame computed entirely by Spark (no driver scalars).

    Columns: n_transactions, max_item_count, min_support_used, min_count.
    """
    item_counts = baskets.select(F.explode("items").alias("item")).groupBy("item").count()
    one = (baskets.select(F.lit(1).cast("long").alias("_b"), F.lit(0).cast("long").alias("_c"))
           .unionByName(item_counts.select(F.lit(0).cast("long").alias("_b"),
                                           F.col("count").alias("_c")))
           .agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("n"),
                F.coalesce(F.max("_c"), F.lit(0)).alias("top")))
    s = (F.when(F.col("top") * 10 >= F.col("n"), F.lit(FIRST_SUPPORT))
         .when((F.col("n") >= 2) & (F.col("top") >= 2), F.try_divide(F.lit(2.0), F.col("n")))
         .otherwise(F.try_divide(F.lit(1.0), F.col("n"))))
    cnt = (F.when(F.col("top") * 10 >= F.col("n"), F.ceil(F.col("n") / F.lit(10)))
           .when((F.col("n") >= 2) & (F.col("top") >= 2), F.lit(2))
           .otherwise(F.lit(1)))
    cols = [F.col("n").alias("n_transactions"), F.col("top").alias("max_item_count"),
            s.alias("min_support_used"), cnt.cast("long").alias("min_count")]
    if basket_set is not None:
        cols.insert(0, F.lit(basket_set).alias("basket_set"))
    return one.select(*cols)

