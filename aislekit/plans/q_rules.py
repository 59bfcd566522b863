"""Registered basket and rule queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sorted_key
from ..operators import closed as CL
from ..operators import rules as R
from ..operators.baskets import category_baskets, support_choice_frame
from ..sources.tables import table
from .driver_tables import baskets_by_name, cached_analysis, order_baskets, sql_basket_items
from .registry import register

R6 = 6  # output doubles are rounded to 6 places so engines hash alike


def _rule_cols(df: DataFrame) -> DataFrame:
    return df.select(sorted_key("if_categories").alias("if_key"),
                     sorted_key("then_categories").alias("then_key"),
                     F.round("support", R6).alias("support"),
                     F.round("confidence", R6).alias("confidence"),
                     F.round("lift", R6).alias("lift"))


# ---------------------------------------------------------------- oracle SQL builders

FALLBACK_COUNT = ("CASE WHEN top * 10 >= n THEN (n + 9) // 10 WHEN n >= 2 AND top >= 2 THEN 2 ELSE 1 END")
FALLBACK_SUPPORT = ("CASE WHEN top * 10 >= n THEN 0.1 WHEN n >= 2 AND top >= 2 THEN 2.0 / n ELSE 1.0 / n END")


def _support_count(support: str) -> str:
    """Exact integer minimum count for the supports used here (0.1, 0.05, 0.01, or the A8 fallback)."""
    return {"0.1": "(n + 9) // 10", "0.05": "(n + 19) // 20", "0.01": "(n + 99) // 100", "fallback": FALLBACK_COUNT}[support]


def sql_itemsets_ctes(name: str, support: str, max_k: int, bi_sql: str | None = None) -> str:
    """CTEs bi, nn, mc, sub, its for a basket set; subsets enumerated up to ``max_k`` items.

    ``bi_sql`` (DISTINCT basket_id, item rows) overrides the named basket set.
    """
    parts = ["SELECT [a1.item] AS items FROM bi a1"]
    for k in range(2, max_k + 1):
        joins = " ".join(
            f"JOIN bi a{j} ON a{j}.basket_id = a1.basket_id AND a{j - 1}.item < a{j}.item"
            for j in range(2, k + 1))
        items = ", ".join(f"a{j}.item" for j in range(1, k + 1))
        parts.append(f"SELECT [{items}] AS items FROM bi a1 {joins}")
    sub = "\n UNION ALL ".join(parts)
    return f"""bi AS ({bi_sql or sql_basket_items(name)}),
nn AS (SELECT count(DISTINCT basket_id) AS n FROM bi),
topc AS (SELECT coalesce(max(c), 0) AS top FROM (SELECT count(*) AS c FROM bi GROUP BY item)),
mc AS (SELECT {_support_count(support)} AS c, {FALLBACK_SUPPORT if support == 'fallback' else support} AS s
       FROM nn, topc),
sub AS ({sub}),
its AS (SELECT items, len(items) AS k, count(*) AS freq FROM sub GROUP BY items
        HAVING count(*) >= (SELECT c FROM mc))"""


RULES_CTES = """masks AS (SELECT items, freq, unnest(range(1, (1 << k) - 1)) AS mask FROM its WHERE k >= 2),
spl AS (SELECT list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 1) AS a_items,
               list_filter(items, lambda x, i: ((mask >> (i - 1)) & 1) = 0) AS c_items,
               freq AS freq_ab FROM masks),
rules AS (SELECT s.a_items, s.c_items, s.freq_ab, a.freq AS freq_a, c.freq AS freq_b,
                 array_to_string(s.a_items, '|') AS if_key, array_to_string(s.c_items, '|') AS then_key,
                 CAST(s.freq_ab AS DOUBLE) / (SELECT n FROM nn) AS support,
                 (CAST(s.freq_ab AS DOUBLE) / (SELECT n FROM nn)) / (CAST(a.freq AS DOUBLE) / (SELECT n FROM nn)) AS confidence
          FROM spl s JOIN its a ON a.items = s.a_items JOIN its c ON c.items = s.c_items),
rules2 AS (SELECT *, confidence / (CAST(freq_b AS DOUBLE) / (SELECT n FROM nn)) AS lift FROM rules),
pos AS (SELECT * FROM rules2
        WHERE CAST(freq_ab AS HUGEINT) * (SELECT n FROM nn) > CAST(freq_a AS HUGEINT) * freq_b),
kept AS (SELECT * FROM pos p WHERE NOT EXISTS (
           SELECT 1 FROM pos q WHERE q.if_key = p.then_key AND q.then_key = p.if_key
             AND (q.confidence > p.confidence OR (q.confidence = p.confidence AND q.if_key < p.if_key))))"""

RULE_SELECT = ("if_key, then_key, round(support, 6) AS support, round(confidence, 6) AS confidence, "
               "round(lift, 6) AS lift")


# ---------------------------------------------------------------- queries

@register("category_baskets", "A5 A6 S4",
          sql="""SELECT l.l_orderkey AS basket_id,
       array_to_string(list_sort(list(DISTINCT p.p_type)), '|') AS items_key,
       CAST(count(DISTINCT p.p_type) AS INTEGER) AS n_items
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE p.p_type IS NOT NULL GROUP BY l.l_orderkey""")
def q_category_baskets(spark: SparkSession, sf: str) -> DataFrame:
    b = order_baskets(spark, sf, "p_type")
    return b.select("basket_id", sorted_key("items").alias("items_key"),
                    F.size("items").alias("n_items"))


@register("frequent_itemsets", "A7 F7", sql=f"""WITH {sql_itemsets_ctes('p_type', '0.1', 5)}
SELECT array_to_string(items, '|') AS items_key, CAST(k AS INTEGER) AS k, freq,
       round(CAST(freq AS DOUBLE) / (SELECT n FROM nn), 6) AS support FROM its""")
def q_frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    a = cached_analysis(spark, sf, "p_type", 0.1)
    return a.itemsets.select(sorted_key("items").alias("items_key"), "k", "freq",
                             F.round("support", R6).alias("support"))


_FALLBACK_SETS = ["p_type", "p_brand", "p_size", "p_name", "events"]


def _sql_fallback(name: str) -> str:
    return f"""SELECT '{name}' AS basket_set, n AS n_transactions, top AS max_item_count,
  CASE WHEN top * 10 >= n THEN 0.1 WHEN n >= 2 AND top >= 2 THEN 2.0 / n ELSE 1.0 / n END AS min_support_used,
  CAST(CASE WHEN top * 10 >= n THEN (n + 9) // 10 WHEN n >= 2 AND top >= 2 THEN 2 ELSE 1 END AS BIGINT) AS min_count
FROM (SELECT (SELECT count(DISTINCT basket_id) FROM bi_{name}) AS n,
             (SELECT max(c) FROM (SELECT count(*) AS c FROM bi_{name} GROUP BY item)) AS top)"""


@register("support_fallback", "A8 A6", sql="WITH " + ",\n".join(
    f"bi_{s} AS ({sql_basket_items(s)})" for s in _FALLBACK_SETS) + "\n" + "\nUNION ALL\n".join(
    _sql_fallback(s) for s in _FALLBACK_SETS))
def q_support_fallback(spark: SparkSession, sf: str) -> DataFrame:
    frames = [support_choice_frame(baskets_by_name(spark, sf, s), s) for s in _FALLBACK_SETS]
    return reduce(DataFrame.unionByName, frames)


@register("association_rules", "A9 J1", sql=f"""WITH {sql_itemsets_ctes('p_type', '0.1', 5)},
{RULES_CTES}
SELECT {RULE_SELECT} FROM rules2""")
def q_association_rules(spark: SparkSession, sf: str) -> DataFrame:
    a = cached_analysis(spark, sf, "p_type", 0.1)
    return _rule_cols(a.rules)


@register("positive_rules", "F6 W5 J2 U2 A13", sql=f"""WITH {sql_itemsets_ctes('p_brand', '0.01', 4)},
{RULES_CTES}
SELECT {RULE_SELECT} FROM kept""")
def q_positive_rules(spark: SparkSession, sf: str) -> DataFrame:
    a = cached_analysis(spark, sf, "p_brand", 0.01)
    return _rule_cols(a.positive)


@register("top_rules", "O1 O2", sql=f"""WITH {sql_itemsets_ctes('p_brand', '0.01', 4)},
{RULES_CTES}
SELECT {RULE_SELECT} FROM kept
ORDER BY lift DESC, support DESC, confidence DESC, if_key, then_key LIMIT 10""")
def q_top_rules(spark: SparkSession, sf: str) -> DataFrame:
    a = cached_analysis(spark, sf, "p_brand", 0.01)
    return _rule_cols(R.top_rules(a.positive))


_STATUS_SETS = [("p_brand", "0.1", 3), ("events", "0.1", 5), ("p_type", "0.1", 5)]


def _sql_status(name: str, support: str, max_k: int) -> str:
    return f"""(WITH {sql_itemsets_ctes(name, support, max_k)},
{RULES_CTES}
SELECT '{name}' AS basket_set,
  CASE WHEN (SELECT n FROM nn) <= 1 THEN 'insufficient_transactions'
       WHEN (SELECT count(*) FROM its) = 0 THEN 'no_frequent_itemsets'
       WHEN (SELECT count(*) FROM its WHERE k >= 2) = 0 THEN 'no_rules'
       WHEN (SELECT count(*) FROM kept) = 0 THEN 'no_positive_rules' ELSE 'ok' END AS status,
  (SELECT n FROM nn) AS total_transactions, {support} AS min_support_used,
  (SELECT count(*) FROM kept) AS total_positive_rules_found)"""


@register("rule_status", "R1 R2 A21", sql="\nUNION ALL\n".join(_sql_status(*s) for s in _STATUS_SETS))
def q_rule_status(spark: SparkSession, sf: str) -> DataFrame:
    frames = []
    for name, support, _ in _STATUS_SETS:
        a = cached_analysis(spark, sf, name, float(support))
        frames.append(a.summary().select(F.lit(name).alias("basket_set"), "*"))
    return reduce(DataFrame.unionByName, frames)


# ---------------------------------------------------------------- closed itemsets, the fallback's last threshold

_ORIGIN_SUPPORT = 0.05
_ORIGIN_BI = """SELECT DISTINCT l.l_orderkey AS basket_id, unnest([n.n_name, r.r_name]) AS item
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""


def _sql_levels(max_k: int) -> str:
    """Itemsets by size over baskets as bit masks: an itemset of k - 1 and a later item, counted in the masks that hold both."""
    parts = ["l1 AS MATERIALIZED (SELECT (1::BIGINT << b) AS m, b, [item] AS items, freq FROM it)"]
    for k in range(2, max_k + 1):
        parts.append(f"""c{k} AS MATERIALIZED (SELECT l.m | (1::BIGINT << it.b) AS m, it.b, list_append(l.items, it.item) AS items
       FROM l{k - 1} l JOIN it ON it.b > l.b),
l{k} AS MATERIALIZED (SELECT c{k}.m, b, items, CAST(sum(w) AS BIGINT) AS freq FROM c{k} JOIN bm ON bm.m & c{k}.m = c{k}.m
       GROUP BY ALL HAVING sum(w) >= (SELECT c FROM mc))""")
    return ",\n".join(parts)


# up to 8 items: more than any origin set with the support has (5 at sf0.01)
_CLOSED_CTES = f"""bi AS (SELECT DISTINCT basket_id, item FROM ({_ORIGIN_BI})),
nn AS (SELECT count(DISTINCT basket_id) AS n FROM bi),
mc AS (SELECT {_support_count(str(_ORIGIN_SUPPORT))} AS c FROM nn),
it AS MATERIALIZED (SELECT item, freq, row_number() OVER (ORDER BY item) - 1 AS b FROM (
  SELECT item, count(*) AS freq FROM bi GROUP BY item HAVING count(*) >= (SELECT c FROM mc))),
bm AS MATERIALIZED (SELECT m, count(*) AS w FROM (
  SELECT basket_id, CAST(sum(1::BIGINT << b) AS BIGINT) AS m FROM bi JOIN it USING (item) GROUP BY basket_id) GROUP BY m),
{_sql_levels(8)},
its AS MATERIALIZED ({" UNION ALL ".join(f"SELECT items, len(items) AS k, freq FROM l{k}" for k in range(1, 9))}),
parts AS (SELECT items, freq, unnest(range(1, k + 1)) AS drop FROM its WHERE k >= 2),
subs AS (SELECT list_filter(items, lambda x, i: i <> drop) AS sub, items, freq FROM parts),
closed AS (SELECT * FROM its WHERE NOT EXISTS (SELECT 1 FROM subs WHERE subs.sub = its.items AND subs.freq = its.freq))"""

_CLOSED: dict = {}


def _closed(spark: SparkSession, sf: str, name: str) -> CL.ClosedItemsets:
    """Closed sets of the orders' supplier nations and regions, or of the orders' own lines; once per process."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CLOSED:
        li = table(spark, sf, "lineitem")
        if name == "lines":
            item = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
            _CLOSED[key] = CL.closed_itemsets(category_baskets(li.select("l_orderkey", item.alias("item")), "l_orderkey", "item"))
        else:
            places = (table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                      .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
            lines = (li.select("l_orderkey", "l_suppkey").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
                     .select("l_orderkey", F.explode(F.array("n_name", "r_name")).alias("item")))
            _CLOSED[key] = CL.closed_itemsets(category_baskets(lines, "l_orderkey", "item"), _ORIGIN_SUPPORT)
    return _CLOSED[key]


@register("closed_itemsets", "A7 F7", sql=f"""WITH {_CLOSED_CTES}
SELECT array_to_string(items, '|') AS items_key, CAST(k AS INTEGER) AS k, freq,
       round(CAST(freq AS DOUBLE) / (SELECT n FROM nn), 6) AS support FROM closed""")
def q_closed_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    return _closed(spark, sf, "origins").sets().select(
        sorted_key("items").alias("items_key"), "k", "freq", F.round("support", R6).alias("support"))


@register("itemset_generators", "A7 A9", sql=f"""WITH {_CLOSED_CTES},
gen AS (SELECT items, freq FROM its WHERE freq < (SELECT n FROM nn) AND NOT EXISTS (
          SELECT 1 FROM subs JOIN its s ON s.items = subs.sub AND s.freq = subs.freq WHERE subs.items = its.items))
SELECT array_to_string(gen.items, '|') AS generator_key, array_to_string(c.items, '|') AS closure_key, gen.freq
FROM gen JOIN closed c ON c.freq = gen.freq AND list_has_all(c.items, gen.items)""")
def q_itemset_generators(spark: SparkSession, sf: str) -> DataFrame:
    return CL.generator_items(_closed(spark, sf, "origins"), every_member=True).select(
        sorted_key("items").alias("generator_key"), sorted_key("closure").alias("closure_key"), "freq")


# brute force: every subset and every rule of every basket is listed
_LINE_BI = "SELECT DISTINCT l_orderkey AS basket_id, concat_ws('-', l_orderkey, l_linenumber) AS item FROM lineitem"


def _sql_lines(max_k: int = 7) -> str:
    return f"""{sql_itemsets_ctes('', 'fallback', max_k, _LINE_BI)},
{RULES_CTES.rsplit(",\nkept AS", 1)[0]},
kept AS (SELECT * FROM pos WHERE freq_a < freq_b OR (freq_a = freq_b AND if_key < then_key))"""


@register("sparse_rule_status", "A8 A9 A21 R1 R2", sql=f"""WITH {_sql_lines()}
SELECT CASE WHEN (SELECT n FROM nn) <= 1 THEN 'insufficient_transactions'
            WHEN (SELECT count(*) FROM its) = 0 THEN 'no_frequent_itemsets'
            WHEN (SELECT count(*) FROM its WHERE k >= 2) = 0 THEN 'no_rules'
            WHEN (SELECT count(*) FROM kept) = 0 THEN 'no_positive_rules' ELSE 'ok' END AS status,
       (SELECT n FROM nn) AS total_transactions, round((SELECT s FROM mc), 12) AS min_support_used,
       (SELECT count(DISTINCT basket_id) FROM bi) AS n_closed, (SELECT count(*) FROM its) AS n_itemsets,
       (SELECT count(*) FROM kept) AS total_positive_rules_found""")
def q_sparse_rule_status(spark: SparkSession, sf: str) -> DataFrame:
    """Baskets whose items are their own: the fallback ends at 1/N."""
    s = CL.sparse_summary(_closed(spark, sf, "lines"))
    return s.select("status", "total_transactions", F.round("min_support_used", 12).alias("min_support_used"), "n_closed",
                    F.col("n_itemsets").cast("long").alias("n_itemsets"),
                    F.col("total_positive_rules_found").cast("long").alias("total_positive_rules_found"))


@register("sparse_category_scores", "A8 A10 R4", sql=f"""WITH {_sql_lines()},
sides AS (SELECT unnest(list_concat(a_items, c_items)) AS category, lift FROM kept)
SELECT category, round(sum(lift), 6) AS score FROM sides GROUP BY category""")
def q_sparse_category_scores(spark: SparkSession, sf: str) -> DataFrame:
    return CL.sparse_scores(_closed(spark, sf, "lines")).select("category", F.round("score", R6).alias("score"))
