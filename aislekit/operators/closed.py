"""Closed itemsets and their minimal generators.

At support 1/N every subset of every basket is frequent, 2^k of them for a basket of k items.  The closed itemsets (those that no
further item joins in all of their baskets) are never more than the intersections of baskets, and the count of any
itemset is the largest count of a closed set that holds it (:func:`subset_counts`), so counts and rule measures follow
without a list of subsets.

* Items of exactly the same baskets are one class, found by a 128-bit signature of the basket set (two exclusive ors of
  64-bit hashes, and the number of baskets); its members are in one basket, which bounds it.  Equal baskets are one row with a weight
  and a number, by which rows are shuffled instead of their items.
* A lone class is in one distinct basket only: that basket is the closed set of everything that holds the class.  It is taken as it is, and
  baskets are mined without their lone classes; sets that only one such basket holds are not closed and are left out.
* Closed sets come by prefix-preserving extension: a set P is extended by a class j beyond the last one, closed over the
  baskets that hold P and j, and kept if the closure adds nothing before j; so each closed set is found once, along one path, without
  a look at the others.  A round extends all sets by one step; counts of (path, j, i) are plain sums, merged map-side, so a frequent class does
  not end in one task.  Classes are numbered from rare to frequent, which keeps the baskets behind a path few.
* Minimal generators (itemsets all of whose proper subsets are more frequent) are mined by size from the baskets: every subset of
  a generator is a generator.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small
from .baskets import SupportChoice, choose_support
from .rules import STATUS_INSUFFICIENT, STATUS_NO_ITEMSETS, STATUS_NO_POSITIVE, STATUS_NO_RULES, STATUS_OK

_SETS = "path array<bigint>, codes array<bigint>, freq bigint"


@dataclass
class ClosedItemsets:
    choice: SupportChoice
    classes: DataFrame    # code, members (sorted items of the same baskets), freq, m (distinct baskets)
    patterns: DataFrame   # codes (sorted), w: distinct baskets of classes and how often they occur
    coded: DataFrame      # codes (sorted), freq: the closed sets

    @property
    def n(self) -> int:
        return self.choice.n_transactions

    def lengths(self) -> DataFrame:
        """``k`` of the closed sets, without their items."""
        parts = (self.coded.select("codes", F.explode("codes").alias("code"))
                 .join(self.classes.select("code", F.size("members").alias("size")), "code"))
        return parts.groupBy("codes").agg(F.sum("size").cast("int").alias("k")).select("k")

    def sets(self) -> DataFrame:
        """``items ARRAY<STRING> (sorted), k, freq, support`` of the closed sets."""
        return (_spell(self.coded, self.classes, "codes", "items", "codes", "freq")
                .select("items", F.size("items").alias("k"), "freq", (F.col("freq") / F.lit(float(max(1, self.n)))).alias("support")))


def _spell(rows: DataFrame, classes: DataFrame, codes: str, out: str, *keys: str) -> DataFrame:
    """``rows`` with the items of the classes in ``codes`` as the sorted array ``out``; ``keys`` name a row."""
    parts = rows.select(*keys, F.explode(codes).alias("code")).join(classes.select("code", "members"), "code")
    return parts.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("members"))).alias(out))


def item_classes(patterns: DataFrame) -> DataFrame:
    """``members, freq, m, s1, s2`` of ``items, w, number`` rows: items of equal basket sets; of a lone class ``s1`` is its basket's number."""
    lines = patterns.select(F.explode("items").alias("item"), "w", "number")
    signed = lines.groupBy("item").agg(F.sum("w").alias("freq"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64(F.lit(1), "number")).alias("s1"),
                                       F.bit_xor(F.xxhash64(F.lit(2), "number")).alias("s2"), F.max("number").alias("number"))
    lone = F.col("m") == 1
    signed = signed.select("item", "freq", "m", F.when(lone, F.col("number")).otherwise(F.col("s1")).alias("s1"),
                           F.when(lone, 0).otherwise(F.col("s2")).alias("s2"))
    return cut_lineage(signed.groupBy("freq", "m", "s1", "s2").agg(F.array_sort(F.collect_list("item")).alias("members")))


def numbered(classes: DataFrame, min_count: int) -> DataFrame:
    """The classes of at least ``min_count`` baskets with a ``code``, which grows from rare to frequent (then by first member)."""
    ordered = classes.where(F.col("freq") >= min_count).orderBy("freq", F.col("members")[0])
    return cut_lineage(ordered.withColumn("code", F.monotonically_increasing_id() + 1))


def class_patterns(patterns: DataFrame, classes: DataFrame) -> DataFrame:
    """``codes, w, lone``: each basket as its sorted class codes, equal ones merged, and its lone classes.  A lone class knows its basket; any other
    is looked up by its first member."""
    own = classes.where(F.col("m") == 1).select(F.col("s1").alias("number"), "code", F.col("freq").alias("w"), F.lit(True).alias("lone"))
    first = small(classes.where(F.col("m") > 1).select(F.col("members")[0].alias("item"), "code"))
    lines = patterns.select("number", "w", F.explode("items").alias("item")).join(first, "item")
    rows = own.unionByName(lines.select("number", "code", "w", F.lit(False).alias("lone"))).groupBy("number").agg(
        F.array_sort(F.collect_list("code")).alias("codes"), F.first("w").alias("w"),
        F.array_sort(F.collect_list(F.when(F.col("lone"), F.col("code")))).alias("lone"))
    return cut_lineage(rows.groupBy("codes", "lone").agg(F.sum("w").alias("w")))


def closed_codes(patterns: DataFrame, classes: DataFrame, n: int, min_count: int) -> DataFrame:
    """``codes, freq``: the closed sets of classes, each found once (see the module)."""
    everywhere = [r["code"] for r in classes.where(F.col("freq") == n).select("code").collect()]  # one class at most
    root = F.array(*[F.lit(c).cast("long") for c in everywhere]).cast("array<bigint>")
    spark = patterns.sparkSession
    found = [spark.range(1).select(root.alias("codes"), F.lit(n).cast("long").alias("freq")).where(F.size("codes") > 0)]
    # the class of all baskets is lone if they are equal; then it is the root
    own = F.array_except("lone", root)
    found.append(patterns.where(F.size(own) > 0).select("codes", F.col("w").alias("freq")))
    # rows of a path: what its baskets hold beyond its set, their weight, number, and how many of them have lone classes
    rows = patterns.select(F.array().cast("array<bigint>").alias("path"), root.alias("set"), F.lit(0).cast("long").alias("core"),
                           F.array_except(F.array_except("codes", root), own).alias("rest"), "w", F.lit(1).cast("long").alias("m"),
                           F.when(F.size(own) > 0, 1).otherwise(0).cast("long").alias("lone")).where(F.size("rest") > 0)
    if rows.isEmpty():
        return reduce(DataFrame.unionByName, found)
    while True:
        steps = rows.select("path", "set", "core", "rest", "w", "m", "lone", F.explode(F.filter("rest", lambda j: j > F.col("core"))).alias("j"))
        counts = (steps.select("path", "j", "w", "m", "lone", F.explode("rest").alias("i"))
                  .groupBy("path", "j", "i").agg(F.sum("w").alias("c"), F.sum("m").alias("m"), F.sum("lone").alias("lone"))
                  .where(F.col("c") >= min_count))
        # j itself has the largest counts; a single basket with a lone class is found already, with all that it holds
        by_step = counts.groupBy("path", "j").agg(F.max("c").alias("freq"), F.collect_list(F.struct("i", "c")).alias("_l"),
                                                  F.max("m").alias("m"), F.max("lone").alias("lone")).where("m > 1 OR lone = 0")
        picked = lambda test: F.transform(F.filter("_l", test), lambda x: x["i"])
        kept = (by_step.select("path", "j", "freq", picked(lambda x: x["c"] == F.col("freq")).alias("add"),
                               picked(lambda x: x["c"] < F.col("freq")).alias("keep"))
                .where(F.array_min("add") == F.col("j")))
        grown = steps.join(kept, ["path", "j"]).select(
            F.concat("path", F.array("j")).alias("path"), F.array_sort(F.concat("set", "add")).alias("set"), F.col("j").alias("core"),
            F.array_sort(F.array_intersect("rest", "keep")).alias("rest"), "w", "m", "lone", "freq")
        # a basket may have nothing left: it stays, as the one row that carries the set
        rows = cut_lineage(grown.groupBy("path", "set", "core", "freq", "rest").agg(F.sum("w").alias("w"), F.sum("m").alias("m"),
                                                                                    F.sum("lone").alias("lone")))
        if rows.isEmpty():
            break
        found.append(cut_lineage(rows.groupBy("path").agg(F.first("set").alias("codes"), F.first("freq").alias("freq")).select("codes", "freq")))
        rows = rows.where(F.array_max("rest") > F.col("core"))
    return reduce(DataFrame.unionByName, found)


def closed_itemsets(baskets: DataFrame, support: float | None = None) -> ClosedItemsets:
    """Closed itemsets of ``items`` arrays at ``support``, by default that of the fallback 0.1, 2/N, 1/N.

    Null items are no items; an empty basket counts in N.  Without baskets, or with a single one, there are sets as with more.
    """
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    merged = (baskets.select(F.coalesce(items, F.array().cast("array<string>")).alias("items"))
              .groupBy("items").agg(F.count(F.lit(1)).alias("w")))
    patterns = cut_lineage(merged.withColumn("number", F.monotonically_increasing_id()))
    same = item_classes(patterns)
    n, top = patterns.agg(F.sum("w")).first()[0], same.agg(F.max("freq")).first()[0]
    choice = choose_support(int(n or 0), int(top or 0), support)
    classes = numbered(same, choice.min_count)
    coded = class_patterns(patterns, classes)
    return ClosedItemsets(choice, classes, coded, closed_codes(coded, classes, choice.n_transactions, choice.min_count))


def minimal_generators(closed: ClosedItemsets) -> DataFrame:
    """``codes, freq, closure``: the minimal generators in classes (any member stands for its class) and the codes of the closed set
    that each generates."""
    patterns, mc = closed.patterns, closed.choice.min_count
    classes = closed.classes.where(F.col("freq") < closed.n)
    level = cut_lineage(classes.select(F.array("code").alias("codes"), "freq"))
    rows = (patterns.select("codes", "w").withColumnRenamed("codes", "all")
            .select("all", "w", F.explode("all").alias("c")).join(classes.select(F.col("code").alias("c")), "c", "left_semi")
            .select(F.array("c").alias("codes"), F.filter("all", lambda x: x > F.col("c")).alias("rest"), "w"))
    found = [level]
    while True:
        steps = rows.select("codes", "rest", "w", F.explode("rest").alias("j"))
        longer = steps.select(F.concat("codes", F.array("j")).alias("codes"), F.filter("rest", lambda x: x > F.col("j")).alias("rest"), "w")
        longer = cut_lineage(longer.groupBy("codes", "rest").agg(F.sum("w").alias("w")))
        counts = longer.groupBy("codes").agg(F.sum("w").alias("freq")).where(F.col("freq") >= mc)
        # all subsets without one class are generators, and more frequent
        without = counts.select("codes", "freq", F.explode("codes").alias("x")).select(
            "codes", "freq", F.array_except("codes", F.array("x")).alias("sub"))
        below = level.select(F.col("codes").alias("sub"), F.col("freq").alias("f"))
        level = cut_lineage(without.join(below, "sub").where("f > freq").groupBy("codes", "freq").agg(F.count(F.lit(1)).alias("m"))
                            .where(F.col("m") == F.size("codes")).select("codes", "freq"))
        if level.isEmpty():
            break
        found.append(level)
        rows = longer.join(level.select("codes"), "codes", "left_semi").where(F.size("rest") > 0)
    free = reduce(DataFrame.unionByName, found)
    # the closure has the generator's count, so it is found by that and the rarest class
    sets = closed.coded.select(F.col("codes").alias("closure"), "freq", F.explode("codes").alias("rare"))
    pairs = free.withColumn("rare", F.array_min("codes")).join(sets, ["rare", "freq"])
    return pairs.where(F.size(F.array_except("codes", "closure")) == 0).select("codes", "freq", "closure")


def generator_items(closed: ClosedItemsets, every_member: bool = False) -> DataFrame:
    """``items, closure, freq`` of the minimal generators, each class by its first item; with ``every_member`` by each of its items in
    turn, a row for every choice."""
    members = "members" if every_member else F.slice("members", 1, 1).alias("members")
    gens = cut_lineage(minimal_generators(closed))
    parts = gens.select("codes", "closure", "freq", F.explode("codes").alias("code")).join(closed.classes.select("code", members), "code")
    grown = lambda acc, ms: F.flatten(F.transform(acc, lambda a: F.transform(ms, lambda m: F.concat(a, F.array(m)))))
    start = F.array(F.array().cast("array<string>"))
    named = parts.groupBy("codes", "closure", "freq").agg(F.aggregate(F.collect_list("members"), start, grown).alias("_all"))
    named = named.select(F.explode("_all").alias("items"), "closure", "freq").withColumn("items", F.array_sort("items"))
    return _spell(named, closed.classes, "closure", "closed", "items", "closure", "freq").select(
        "items", F.col("closed").alias("closure"), "freq")


def subset_counts(closed: ClosedItemsets, itemsets: DataFrame) -> DataFrame:
    """``items, freq`` of any ``items`` arrays: the largest count of a closed set that holds them, 0 below the threshold."""
    member = closed.classes.select(F.explode("members").alias("item"), "code")
    asked = itemsets.select(F.array_sort(F.array_distinct("items")).alias("items")).where(F.size("items") > 0).distinct()
    known = (asked.select("items", F.explode("items").alias("item")).join(member, "item")
             .groupBy("items").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.count(F.lit(1)).alias("m"))
             .where(F.col("m") == F.size("items")).select("items", "codes", F.array_min("codes").alias("rare")))
    sets = closed.coded.select(F.col("codes").alias("set"), "freq", F.explode("codes").alias("rare"))
    held = (known.join(sets, "rare").where(F.size(F.array_except("codes", "set")) == 0)
            .groupBy("items").agg(F.max("freq").alias("freq")))
    return asked.join(held, "items", "left").select("items", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def rule_measures(closed: ClosedItemsets, rules: DataFrame) -> DataFrame:
    """A9 for given ``if_categories, then_categories`` pairs (disjoint, not empty), whatever the length of their itemset."""
    sides = rules.select(F.array_sort("if_categories").alias("if_categories"), F.array_sort("then_categories").alias("then_categories"),
                         F.array_sort(F.concat("if_categories", "then_categories")).alias("both"))
    asked = reduce(DataFrame.union, [sides.select(F.col(c).alias("items")) for c in ("both", "if_categories", "then_categories")])
    counts = cut_lineage(subset_counts(closed, asked))
    for side, name in (("both", "freq_ab"), ("if_categories", "freq_a"), ("then_categories", "freq_b")):
        sides = sides.join(counts.select(F.col("items").alias(side), F.col("freq").alias(name)), side)
    n = F.lit(float(max(1, closed.n)))
    support, confidence = F.col("freq_ab") / n, F.try_divide(F.col("freq_ab") / n, F.col("freq_a") / n)
    return sides.where("freq_ab > 0").select("if_categories", "then_categories", "freq_ab", "freq_a", "freq_b", support.alias("support"),
                                             confidence.alias("confidence"), (confidence / (F.col("freq_b") / n)).alias("lift"))


# ---------------------------------------------------------------- no item in two baskets: the fallback's last threshold

def _power(base: int, exponent) -> F.Column:
    """An exact power as DECIMAL(38,0); null beyond it (3^79 is the last)."""
    one = F.lit(1).cast("decimal(38,0)")
    times = F.aggregate(F.sequence(F.lit(1), F.least(exponent, F.lit(128))), one,
                        lambda a, _: F.try_multiply(a, F.lit(base).cast("decimal(1,0)")).cast("decimal(38,0)"))
    return F.when(exponent == 0, one).otherwise(times)


def _need_lone(closed: ClosedItemsets) -> None:
    if closed.choice.max_item_count > 1:
        raise ValueError("an item is in two baskets: the counts below hold where the fallback ends at 1/N")


def sparse_summary(closed: ClosedItemsets) -> DataFrame:
    """A21/R2 where the fallback ends at 1/N, so that no item is in two baskets and each basket is one closed set.

    A basket of k items has 2^k - 1 itemsets and 3^k - 2^(k+1) + 1 rules, all of confidence 1 and lift N; of two mirrored rules one
    stays.  Columns: status, total_transactions, min_support_used, n_closed, n_itemsets, total_positive_rules_found, the last two
    DECIMAL(38,0), null where that overflows.
    """
    _need_lone(closed)
    n = closed.n
    k = F.col("k")
    itemsets = F.when(k <= 120, _power(2, k) - 1).cast("decimal(38,0)")
    rules = F.when(k <= 75, (_power(3, k) - 2 * _power(2, k) + 1) / 2).cast("decimal(38,0)")

    def total(column, longest: int):
        return F.when(F.max("k") <= longest, F.try_sum(column)).cast("decimal(38,0)")

    sums = closed.lengths().agg(F.count(F.lit(1)).alias("n_closed"), F.max("k").alias("longest"),
                                  total(itemsets, 120).alias("n_itemsets"), total(rules, 75).alias("all"))
    status = (F.when(F.lit(n <= 1), STATUS_INSUFFICIENT).when(F.col("n_closed") == 0, STATUS_NO_ITEMSETS)
              .when(F.col("longest") < 2, STATUS_NO_RULES).when(F.lit(n) <= 1, STATUS_NO_POSITIVE).otherwise(STATUS_OK))
    return sums.select(status.alias("status"), F.lit(n).cast("long").alias("total_transactions"),
                       F.lit(closed.choice.min_support).cast("double").alias("min_support_used"), "n_closed",
                       F.coalesce("n_itemsets", F.when(F.col("n_closed") == 0, 0)).cast("decimal(38,0)").alias("n_itemsets"),
                       F.coalesce("all", F.when(F.col("n_closed") == 0, 0)).cast("decimal(38,0)").alias("total_positive_rules_found"))


def sparse_scores(closed: ClosedItemsets) -> DataFrame:
    """A10 where the fallback ends at 1/N: ``category, score``, the sum of lifts of the kept rules with the category on a side.

    Of a basket of k items these are 3^(k-1) - 2^(k-1) rules of lift N.  Items alone in their basket have no rule and no row.
    """
    _need_lone(closed)
    k = F.col("k") - 1
    score = (F.pow(F.lit(3.0), k) - F.pow(F.lit(2.0), k)) * F.lit(float(closed.n))
    return (closed.sets().where(F.lit(closed.n > 1) & (F.col("k") >= 2))
            .select(F.explode("items").alias("category"), score.alias("score")))
