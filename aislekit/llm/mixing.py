"""Mixing sources to target weights: hierarchical budgeting.

The levels of a tree (domain, language, source) carry weights.  The token budget goes down the tree: each
node's budget is divided among its children by weight, none getting more than ``max_epochs`` times the
tokens below it; what a child cannot take goes to its siblings by weight, and only what all siblings lack
goes back to the ancestors' other children.  A child's share is min(capacity, weight * x) with the x that uses up the
budget, found from running sums in order of capacity / weight.

A leaf's budget takes whole epochs of its documents and then the token-prefix of one more: documents in
order of md5(seed:epoch:doc_id), until the budget is reached; the last one counts with the tokens that
still fit (``take_tokens``).  Running sums go through 4096 hash buckets of each leaf, so that no task holds a leaf.

Nulls and ties: a null level is a child of its own, named ''; a null or wordless text has 0
tokens; a missing weight is 1, a weight of 0 gives nothing; shares are rounded down to
whole tokens; rows of equal hash are ordered by doc_id, tokens and the text's hash (equal rows either way); an empty table
gives an empty result.  Columns named like those added (n_tokens, epoch, take_tokens) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common
from .common import WORD_PATTERN

PATH_SEPARATOR = "/"


@dataclass(frozen=True)
class MixingPlan:
    levels: Sequence[str] = ("domain", "lang", "source")
    #: weight of a node by its path, such as "web/en"; 1 where missing
    weights: Mapping[str, float] = ()
    share: float = 0.5  #: budget as a share of all tokens
    max_epochs: int = 4
    seed: int = 7


#: Of the registered query: two domains, English twice as heavy in one of them.
PLAN = MixingPlan(weights={"web": 3, "books": 5, "web/en": 2, "books/de": 2, "books/fr": 2})


def domain_of(source: Column) -> Column:
    """Domain of a source of the driver's tables: src0 to src9 are web, the others books."""
    return F.when(source.rlike("^src[0-9]$"), "web").otherwise("books")


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long"))


def _weight(path: Column, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, path), F.lit(1.0))


def leaf_budgets(leaves: DataFrame, plan: MixingPlan) -> DataFrame:
    """Levels, tokens and budget of every leaf, from a table of levels and tokens with a row for each leaf."""
    levels = list(plan.levels)
    df = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs)
    whole = Window.partitionBy(F.lit(0))  # a row for each leaf of the tree, no more
    df = df.withColumn("budget", F.least(F.sum("cap").over(whole), F.floor(F.sum("tokens").over(whole) * F.lit(plan.share))))
    for depth, _ in enumerate(levels):
        parent, node = levels[:depth], levels[:depth + 1]
        below = Window.partitionBy(*node) if node else whole
        df = df.withColumn("_cap", F.sum("cap").over(below))
        df = df.withColumn("_w", _weight(F.concat_ws(PATH_SEPARATOR, *node), plan.weights))
        # one row of each node carries its capacity and weight in the running sums over siblings
        df = df.withColumn("_one", F.row_number().over(Window.partitionBy(*node).orderBy(*levels)) == 1)
        around = Window.partitionBy(*(parent or [F.lit(0)]))
        ratio = F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(float("inf")))
        df = df.withColumn("_ratio", ratio)
        before = around.orderBy("_ratio", levels[depth], F.desc("_one"), *levels).rowsBetween(Window.unboundedPreceding, -1)
        one_cap = F.when(F.col("_one") & (F.col("_w") > 0), F.col("_cap")).otherwise(0)
        one_w = F.when(F.col("_one"), F.col("_w")).otherwise(0.0)
        df = df.withColumns({"_used": F.coalesce(F.sum(one_cap).over(before), F.lit(0)),
                             "_rest": F.sum(one_w).over(around) - F.coalesce(F.sum(one_w).over(before), F.lit(0.0))})
        level = F.max(F.when(F.col("_one") & (F.col("_w") > 0), (F.col("budget") - F.col("_used")) / F.col("_rest"))).over(around)
        df = df.withColumn("_x", F.coalesce(level, F.lit(0.0)))
        df = df.withColumn("budget", F.least(F.col("_cap"), F.floor(F.col("_w") * F.col("_x")).cast("long")))
    return df.select(*levels, "tokens", "budget")


def mix(docs: DataFrame, plan: MixingPlan = PLAN) -> DataFrame:
    """The rows of ``docs`` (with the levels and n_tokens) that are taken, once for each epoch, with epoch and take_tokens."""
    levels = list(plan.levels)
    docs = docs.drop("epoch", "take_tokens")
    keys = {f"_l{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(levels)}
    named = docs.withColumns(keys)
    leaves = named.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    inner = MixingPlan(tuple(keys), plan.weights, plan.share, plan.max_epochs, plan.seed)
    budgets = cut_lineage(leaf_budgets(leaves, inner).where("tokens > 0").withColumns({
        "_full": F.expr("budget div tokens").cast("int"), "_left": F.col("budget") % F.col("tokens")})
        .drop("tokens", "budget"))
    # the order of the last, partial epoch of a document's leaf
    order = F.md5(F.concat_ws(":", F.lit(plan.seed).cast("string"), (F.col("_full") + 1).cast("string"),
                              F.col("doc_id").cast("string")).cast("binary"))
    rows = named.join(budgets, list(keys)).withColumn("_h", order).withColumn("_b", F.substring("_h", 1, 3))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    ties = ["doc_id", "n_tokens"] + (["_t"] if "text" in docs.columns else [])
    if "text" in docs.columns:
        rows = rows.withColumn("_t", F.xxhash64("text"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*keys, "_b"]).withColumn(
        "_before", F.col("_ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.withColumn("_n", F.col("_full") + F.when(F.col("_before") < F.col("_left"), 1).otherwise(0)).where("_n > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("take_tokens", F.when(F.col("epoch") <= F.col("_full"), F.col("n_tokens")).otherwise(
        F.least(F.col("n_tokens"), F.col("_left") - F.col("_before"))))
    return rows.select(*docs.columns, "epoch", "take_tokens")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tokens(common.documents(spark, sf_dir)).withColumn("domain", domain_of(F.col("source")))
    sized = cut_lineage(docs.select("doc_id", "domain", "lang", "source", "n_tokens"))
    return mix(sized).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "take_tokens")


def _weight_sql(path: str, plan: MixingPlan) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in plan.weights.items())
    return f"(CASE {path} {cases} ELSE 1.0 END)::DOUBLE"


def mixing_sql(plan: MixingPlan = PLAN) -> str:
    """DuckDB SQL for ``op3_mixing``: one node table for each level, budgets from the root down."""
    cols = ["domain", "lang", "source"]
    parts = [f"""sized AS MATERIALIZED (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'books' END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
             f"leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {plan.max_epochs} AS cap FROM sized GROUP BY ALL)",
             f"b0 AS (SELECT least(sum(cap), floor(sum(tokens)::DOUBLE * {plan.share!r}))::BIGINT AS budget FROM leaves)"]
    for depth in range(len(cols)):
        node, parent = cols[:depth + 1], cols[:depth]
        path = " || '/' || ".join(node)
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        join = f"JOIN b{depth} USING ({', '.join(parent)})" if parent else f", b{depth}"
        parts += [f"n{depth} AS (SELECT {', '.join(node)}, sum(cap)::BIGINT AS c, {_weight_sql(path, plan)} AS w FROM leaves GROUP BY {', '.join(node)})",
                  f"""x{depth} AS (SELECT n.*, budget, coalesce(sum(CASE WHEN w > 0 THEN c ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER ({over}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM n{depth} n {join} WINDOW o AS ({over} ORDER BY CASE WHEN w > 0 THEN c / w ELSE 'inf'::DOUBLE END, {cols[depth]}))""",
                  f"""b{depth + 1} AS (SELECT {', '.join(node)}, least(c, floor(w * coalesce(max(CASE WHEN w > 0 THEN (budget - used) / rest END) OVER ({over}), 0))::BIGINT) AS budget FROM x{depth})"""]
    return "WITH " + ",\n".join(parts) + f""",
plan AS (SELECT l.domain, l.lang, l.source, budget // tokens AS n_full, budget % tokens AS n_left FROM leaves l JOIN b3 USING (domain, lang, source) WHERE tokens > 0),
r AS (SELECT s.*, n_full, n_left, md5('{plan.seed}:' || (n_full + 1)::VARCHAR || coalesce(':' || doc_id::VARCHAR, '')) AS h FROM sized s JOIN plan USING (domain, lang, source)),
o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM r),
e AS (SELECT *, unnest(range(1, (n_full + CASE WHEN before < n_left THEN 1 ELSE 0 END + 1)::BIGINT)) AS k FROM o)
SELECT doc_id, domain, lang, source, n_tokens, k::INT AS epoch,
  CASE WHEN k <= n_full THEN n_tokens ELSE least(n_tokens, n_left - before) END::BIGINT AS take_tokens FROM e"""
