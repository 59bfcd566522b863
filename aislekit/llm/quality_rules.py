"""Quality rules: a learned decision list as ordered Spark conditional expressions.

Sequential covering on labelled statistics: a rule is a conjunction of threshold tests that is grown
test by test on one part of the labelled documents (largest FOIL gain), pruned on
another part (the prefix of its tests with the best value) and kept while it
rejects precisely there; the documents that it covers are left out for the next rule.  Each step is one
Spark aggregate over all labelled documents, whose result is a count for each feature and
threshold interval.  Only DataFrame functions run on the executors.

Nulls and ties: a null text has no words; statistics of empty texts are 0 and ratios without words
null, which no test accepts; rows without doc_id have statistics and are never learned from; a
document with several labels counts with each; equal gains go to the first feature, the smaller
threshold and ``>=``; with no usable label there is no rule and only the base decides.
Equality of 3-word windows is that of their 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common
from .common import GAP_PATTERN, crc_fold


def feature_columns() -> dict[str, Column]:
    """What rules test, from the base statistics."""
    words = F.nullif(F.col("n_words"), F.lit(0))
    return {"chars_per_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
            "dup_lines_per_word": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words,
            "n_words": F.col("n_words").cast("double")}


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(
        "doc_id", F.filter(F.split(text, GAP_PATTERN), lambda x: x != "").alias("w"), lines.alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).alias("n_symbols"))
    at = F.sequence(F.lit(0), F.size("w") - 3)
    window = F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    df = df.select(
        "doc_id", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("w") >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("h"))
    # (hash, position) in order of hash, only where some window comes twice
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    df = df.select(*kept, F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).otherwise(none).alias("s"))
    twice = F.filter("s", lambda x, j: F.coalesce(x["h"] == F.get("s", j - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get("s", j + 1)["h"], F.lit(False)))
    df = df.select(*kept, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    covered = F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3))))
    df = df.select(*kept, F.aggregate(covered, F.lit(0), lambda a, x: a + x).alias("n_repeat_words"))
    # a filter on the result would be pushed below and repeat the work on words, so it is kept
    return cut_lineage(df.select("doc_id", *[F.col(c).cast("long").alias(c) for c in df.columns[1:]]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    limit: float

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return F.coalesce(value >= self.limit if self.at_least else value < self.limit, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.limit:.6g}"


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class CoveringPlan:
    cuts: int = 24  #: candidate thresholds of a feature and label (quantiles)
    max_tests: int = 4
    max_rules: int = 8
    precision: float = 0.9  #: least precision of a rule on the pruning part
    support: int = 5  #: least rejected documents there


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [t.column() for t in rule], F.lit(True))


def _interval(cuts: list[float], value: Column) -> Column:
    """How many thresholds a value reaches; null for null."""
    reached = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= value))
    return F.when(value.isNotNull(), reached)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else -math.inf


def learn(stats: DataFrame, labels: DataFrame, plan: CoveringPlan = CoveringPlan()) -> list[Rule]:
    """Rules that reject, from the documents outside fold 0: fold 1 prunes, folds 2 to 4 grow."""
    names = list(feature_columns())
    known = labels.select("doc_id", F.col("quality").cast("int").alias("bad")).where(
        F.col("doc_id").isNotNull() & F.col("bad").isin(0, 1)).withColumn("bad", 1 - F.col("bad"))
    rows = (stats.where(~base_failed() & (crc_fold(F.col("doc_id")) != 0)).join(known, "doc_id")
            .select("bad", (crc_fold(F.col("doc_id")) == 1).alias("prune"),
                    *[c.alias(f"f_{n}") for n, c in feature_columns().items()]))
    rows = cut_lineage(rows)
    found = rows.groupBy("bad").agg(*[F.percentile_approx(
        f"f_{n}", [i / plan.cuts for i in range(plan.cuts + 1)], 10000).alias(n) for n in names]).collect()
    cuts = {n: sorted({v for r in found for v in (r[n] or []) if v is not None}) for n in names}
    interval = [F.struct(F.lit(n).alias("f"), _interval(cuts[n], F.col(f"f_{n}")).alias("b")) for n in names if cuts[n]]
    if not interval:
        return []
    rules: list[Rule] = []
    left = rows
    while len(rules) < plan.max_rules:
        rule: Rule = ()
        while len(rule) < plan.max_tests:
            inside = left.where(~F.col("prune") & covers(rule))
            counted = (inside.select("bad", F.explode(F.array(*interval)).alias("x")).where(F.col("x.b").isNotNull())
                       .groupBy("x.f", "x.b", "bad").count().collect())
            test, done = _best_test(counted, names, cuts)
            if test is None:
                break
            rule += (test,)
            if done:
                break
        if not rule:
            break
        prefixes = [covers(rule[:i]) for i in range(1, len(rule) + 1)]
        held = left.where("prune").agg(*[F.sum(F.when(c, F.lit(1 - b) + (2 * b - 1) * F.col("bad")).otherwise(0))
                                         for c in prefixes for b in (1, 0)]).first()
        value = [((held[2 * i] or 0), (held[2 * i + 1] or 0)) for i in range(len(rule))]
        best = max(range(len(rule)), key=lambda i: ((value[i][0] - value[i][1]) / max(1, sum(value[i])), -i))
        bad, good = value[best]
        if bad < plan.support or bad < plan.precision * (bad + good):
            break
        rules.append(rule[:best + 1])
        left = left.where(~covers(rules[-1]))
    return rules


def _best_test(counted: list, names: list[str], cuts: dict[str, list[float]]) -> tuple[Test | None, bool]:
    """The test of largest gain, and whether it leaves only documents to reject."""
    bins = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
    for r in counted:
        bins[r["f"]][r["b"]][r["bad"]] += r["count"]
    best: tuple[float, Test | None, bool] = (1e-9, None, False)
    for n in names:
        good0, bad0 = (sum(b[i] for b in bins[n]) for i in (0, 1))
        good, bad = 0, 0  # below the threshold
        for i, limit in enumerate(cuts[n]):
            good, bad = good + bins[n][i][0], bad + bins[n][i][1]
            for at_least, p, q in ((True, bad0 - bad, good0 - good), (False, bad, good)):
                gain = _gain(p, q, bad0, good0)
                if gain > best[0] + 1e-9:
                    best = (gain, Test(n, at_least, limit), q == 0)
    return best[1], best[2]


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, or null: one conditional expression, in order."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(covers(rules[0]), 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(covers(rule), i)
    return out


def judge(docs: DataFrame, labels: DataFrame, plan: CoveringPlan = CoveringPlan()) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the number of the rejecting rule (null: none)."""
    stats = text_statistics(docs)
    rules = learn(stats, labels, plan)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    tested = {f"f_{n}": c for n, c in feature_columns().items()}
    df = stats.withColumns(tested | {"base_failed": base_failed()}).withColumn("rule", verdict(rules))
    return df.select(*names, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
