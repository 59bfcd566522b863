"""Frequent itemsets and association rules (SURVEY A7, A9, F6, F7, J1, J2, U2, W5, O1, O2,
A13, A21, R1-R3).

Mining is pattern growth over merged baskets: equal baskets are one row with a weight, the conditional base of an itemset
is rows of what its baskets hold after its last item, equal ones merged, and all itemsets grow by one item in a round.
Rule generation is written here as well: the reference emits every non-empty proper split of each itemset.

Two facts keep the rule stage cheap:

* every split of an itemset is generated by a bitmask ``explode``, in blocks that long
  itemsets spread over tasks, and its two sides' counts come from equi-joins
  against the itemset table (both sides are frequent by downward closure);
* the mirrored rule of ``A -> C`` is ``C -> A`` from the *same* itemset, with
  the same support and lift, and confidence ``f(AC)/f(A)`` versus
  ``f(AC)/f(C)``.  Keeping the higher-confidence direction (W5) is therefore a
  row filter ``f(A) < f(C)`` (ties: smaller antecedent key) -- no self-join,
  no window, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small
from .baskets import SupportChoice, basket_patterns, choose_support, item_counts

# Fixed values of the reference: at most 10 rules are displayed, positive means lift > 1.
TOP_RULES = 10

# Split masks of an itemset are exploded this many bits at a time, so no row holds more than 2^12 of them.
MASK_BITS = 12

STATUS_INSUFFICIENT = "insufficient_transactions"
STATUS_NO_ITEMSETS = "no_frequent_itemsets"
STATUS_NO_RULES = "no_rules"
STATUS_NO_POSITIVE = "no_positive_rules"
STATUS_OK = "ok"


def frequent_itemsets(patterns: DataFrame, items: DataFrame, min_count: int, n: int) -> DataFrame:
    """``items ARRAY<STRING> (sorted), k, freq BIGINT, support DOUBLE`` of merged baskets ``items, w`` and their kept
    ``item, freq``.

    A round takes each base row (path, rest) once for every item of its rest that is frequent beside the path; counts of
    (path, item) are plain sums, merged map-side.
    """
    level = cut_lineage(items.where(F.col("freq") >= min_count)
                        .select(F.array().cast("array<string>").alias("path"), F.col("item").alias("j"), "freq"))
    found = []
    rows = patterns.select(F.array().cast("array<string>").alias("path"), F.col("items").alias("rest"), "w").where(F.size("rest") > 0)
    if not items.where(F.col("freq") < min_count).isEmpty():  # rare items are in no base
        rows = rows.withColumn("id", F.monotonically_increasing_id())
        parts = rows.select("id", "w", F.explode("rest").alias("j")).join(small(level.select("j")), "j", "left_semi")
        kept = parts.groupBy("id").agg(F.array_sort(F.collect_list("j")).alias("rest"), F.first("w").alias("w"))
        rows = cut_lineage(kept.groupBy(F.array().cast("array<string>").alias("path"), "rest").agg(F.sum("w").alias("w")))
    while not level.isEmpty():
        found.append(level.select(F.concat("path", F.array("j")).alias("items"), "freq"))
        steps = (rows.select("path", "rest", "w", F.posexplode("rest").alias("p", "j"))
                 .join(small(level.select("path", "j")), ["path", "j"], "left_semi")
                 .select(F.concat("path", F.array("j")).alias("path"), F.slice("rest", F.col("p") + 2, F.size("rest")).alias("rest"), "w")
                 .where(F.size("rest") > 0))
        rows = cut_lineage(steps.groupBy("path", "rest").agg(F.sum("w").alias("w")))
        level = cut_lineage(rows.select("path", "w", F.explode("rest").alias("j")).groupBy("path", "j")
                            .agg(F.sum("w").alias("freq")).where(F.col("freq") >= min_count))
    if not found:
        return patterns.sparkSession.createDataFrame([], "items array<string>, k int, freq bigint, support double")
    return reduce(DataFrame.unionByName, found).select(
        "items", F.size("items").alias("k"), F.col("freq").cast("long").alias("freq"), (F.col("freq") / F.lit(float(n))).alias("support"))


def mask_blocks(itemsets: DataFrame) -> DataFrame:
    """Blocks of split masks of each itemset of size >= 2: ``items, freq, k, high``.

    A BIGINT mask names the antecedent (bit i: item i).  Its bits above the lowest ``MASK_BITS`` are exploded
    chunk by chunk; a block stands for all masks with these high bits.
    """
    df = itemsets.where(F.col("k") >= 2).select("items", "freq", "k", F.lit(0).cast("long").alias("high"))
    for low in range(60 - 60 % MASK_BITS, 0, -MASK_BITS):
        bits = F.greatest(F.least(F.col("k") - low, F.lit(MASK_BITS)), F.lit(0))
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, _bits) - 1"))).alias("_chunk")
        df = df.withColumn("_bits", bits).select("*", chunk).select(
            "items", "freq", "k", (F.col("high") + F.shiftleft("_chunk", low)).alias("high"))
    return df


def rule_splits(itemsets: DataFrame) -> DataFrame:
    """All non-empty proper (antecedent, consequent) splits of each itemset of size >= 2.

    The blocks of long itemsets are rebalanced, so one itemset does not stay in one task.
    """
    blocks = mask_blocks(itemsets).hint("rebalance").withColumn("_bits", F.least("k", F.lit(MASK_BITS)))
    masks = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, _bits) - 1")))
    exploded = (blocks.select("items", "freq", "k", "high", masks.alias("_low"))
                .withColumn("mask", F.col("high") + F.col("_low"))
                .where("mask > 0 AND bit_count(mask) < k"))

    def side(bit: int):
        return F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1L) = {bit})")

    return exploded.select(side(1).alias("if_categories"), side(0).alias("then_categories"),
                           F.col("freq").alias("freq_ab"))


def association_rules(itemsets: DataFrame, n: int) -> DataFrame:
    """Every rule with support, confidence and lift.

    Columns: if_categories, then_categories, freq_ab, freq_a, freq_b, support,
    confidence, lift.  Measures follow the reference's definitions:
    support = P(A u C), confidence = support / P(A), lift = confidence / P(C).
    The joins to the two sides' counts are left to AQE, which knows their measured bytes.
    """
    sides = itemsets.select("items", "freq")
    a = sides.select(F.col("items").alias("if_categories"), F.col("freq").alias("freq_a"))
    c = sides.select(F.col("items").alias("then_categories"), F.col("freq").alias("freq_b"))
    nn = F.lit(float(n))
    r = rule_splits(itemsets).join(a, "if_categories").join(c, "then_categories")
    s_ab, s_a, s_b = F.col("freq_ab") / nn, F.col("freq_a") / nn, F.col("freq_b") / nn
    conf = s_ab / s_a
    return r.select("if_categories", "then_categories", "freq_ab", "freq_a", "freq_b",
                    s_ab.alias("support"), conf.alias("confidence"), (conf / s_b).alias("lift"))


def positive_filter(rules: DataFrame, n: int) -> DataFrame:
    """lift > 1 as the exact integer test ``f(AC) * N > f(A) * f(C)``."""
    d = "decimal(19,0)"
    return rules.where(F.col("freq_ab").cast(d) * F.lit(n).cast(d)
                       > F.col("freq_a").cast(d) * F.col("freq_b").cast(d))


def keep_stronger_direction(rules: DataFrame) -> DataFrame:
    """One rule per mirrored pair, the higher-confidence direction.

    conf(A->C) > conf(C->A)  <=>  f(A) < f(C); equal confidence keeps the
    direction whose antecedent key sorts first.
    """
    ak = F.concat_ws("|", "if_categories")
    ck = F.concat_ws("|", "then_categories")
    return rules.where((F.col("freq_a") < F.col("freq_b"))
                       | ((F.col("freq_a") == F.col("freq_b")) & (ak < ck)))


def order_rules(rules: DataFrame) -> DataFrame:
    """O1: lift desc, then support, confidence desc, antecedent and consequent keys."""
    return rules.orderBy(F.col("lift").desc(), F.col("support").desc(),
                         F.col("confidence").desc(), F.concat_ws("|", "if_categories"),
                         F.concat_ws("|", "then_categories"))


def top_rules(rules: DataFrame, k: int = TOP_RULES) -> DataFrame:
    """O2: the first k rules by O1 (TakeOrderedAndProject, a bounded top-k)."""
    return order_rules(rules).limit(k)


@dataclass
class RuleAnalysis:
    """Result of R1 on one basket table."""

    choice: SupportChoice
    itemsets: DataFrame
    rules: DataFrame | None
    positive: DataFrame | None
    n_itemsets: int
    n_rules: int

    @property
    def n(self) -> int:
        return self.choice.n_transactions

    def status_col(self):
        """R2 as a Column over the positive-rule count ``n_positive``."""
        if self.n <= 1:
            return F.lit(STATUS_INSUFFICIENT)
        if self.n_itemsets == 0:
            return F.lit(STATUS_NO_ITEMSETS)
        if self.n_rules == 0:
            return F.lit(STATUS_NO_RULES)
        return F.when(F.col("n_positive") == 0, F.lit(STATUS_NO_POSITIVE)).otherwise(STATUS_OK)

    def summary(self) -> DataFrame:
        """Status, total_transactions, min_support_used, total_positive_rules_found."""
        if self.positive is None:
            base = self.itemsets.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_positive"))
        else:
            base = self.positive.agg(F.count(F.lit(1)).alias("n_positive"))
        return base.select(
            self.status_col().alias("status"),
            F.lit(self.n).cast("long").alias("total_transactions"),
            F.lit(self.choice.min_support).cast("double").alias("min_support_used"),
            F.col("n_positive").cast("long").alias("total_positive_rules_found"))


def analyze(baskets: DataFrame, support: float | None = None, materialize: bool = True) -> RuleAnalysis:
    """Threshold (A8) -> itemsets (A7) -> rules (A9) -> lift > 1 (F6) -> W5.

    ``support=None`` applies the reference's 0.1 -> 2/N -> 1/N fallback.
    Merged baskets, item counts and itemsets are checkpointed: each is read by several branches and
    is expensive to recompute after an executor loss.
    """
    patterns = cut_lineage(basket_patterns(baskets))
    counts = cut_lineage(item_counts(patterns))
    n = int(patterns.agg(F.sum("w")).first()[0] or 0)
    top = int(counts.agg(F.max("freq")).first()[0] or 0)
    choice = choose_support(n, top, support)
    if n <= 1:
        empty = patterns.sparkSession.createDataFrame([], "items array<string>, k int, freq bigint, support double")
        return RuleAnalysis(choice, empty, None, None, 0, 0)
    its = frequent_itemsets(patterns, counts, choice.min_count, n)
    if materialize:
        its = cut_lineage(its)
    sizes = its.groupBy("k").count().collect()  # one row for each itemset length
    n_its = sum(r["count"] for r in sizes)
    n_rules = sum(r["count"] * (2 ** r["k"] - 2) for r in sizes)
    if n_rules == 0:
        return RuleAnalysis(choice, its, None, None, n_its, 0)
    rules = association_rules(its, n)
    positive = keep_stronger_direction(positive_filter(rules, n))
    return RuleAnalysis(choice, its, rules, positive, n_its, n_rules)


def rules_output(rules: DataFrame) -> DataFrame:
    """D10 shape with sides as sorted arrays (the public rule schema)."""
    return rules.select("if_categories", "then_categories", "support", "confidence", "lift")
