"""Registered end-to-end queries.

Receipt file = ``conversations.text`` lines; products are classified by the
Naive Bayes model trained on ``documents`` (text -> lang) with the serving
normaliser (fold), exactly the reference's E2/E3 flows on the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rules as R
from ..session import cut_lineage
from ..sources.receipts import receipts_from_texts
from ..sources.shelves import shelf_grid
from ..sources.tables import table
from . import flows as FL
from . import training as T
from .q_model import CHAIN, prepared
from .q_placement import _sql_shelves
from .q_rules import RULE_SELECT, RULES_CTES, _rule_cols, sql_itemsets_ctes
from .q_text import SQL_RECEIPTS
from .registry import register

R6 = 6


_RECEIPTS: dict = {}
_REPORTS: dict = {}


def _report(spark: SparkSession, sf: str) -> FL.BasketReport:
    """One E2 basket report per process, shared by its summary and rule queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REPORTS:
        _REPORTS[key] = FL.basket_report(_receipts(spark, sf), prepared(spark, sf))
    return _REPORTS[key]


def _receipts(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed receipt file, once per process (checkpointed: products, items and baskets read it)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RECEIPTS:
        conv = table(spark, sf, "conversations").where(F.col("text").isNotNull())
        _RECEIPTS[key] = cut_lineage(receipts_from_texts(conv, "text", ["conv_id", "turn"]))
    return _RECEIPTS[key]


_PRODUCTS_SQL = f"""prod AS (SELECT DISTINCT product FROM rit),
ptok AS (SELECT product, regexp_extract_all(lower(translate(product, '{X.FOLD_FROM}', '{X.FOLD_TO}')),
                                            '{X.TOKEN_PATTERN}') AS toks FROM prod),
puni AS (SELECT product, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS tpos FROM ptok),
pbig AS (SELECT a.product, a.term || ' ' || b.term AS term FROM puni a JOIN puni b
         ON a.product = b.product AND b.tpos = a.tpos + 1),
ptf AS (SELECT product, term, count(*) AS tf FROM (SELECT product, term FROM puni UNION ALL
        SELECT product, term FROM pbig) GROUP BY product, term),
pw AS (SELECT ptf.product, ptf.term, ptf.tf * v.idf AS w FROM ptf JOIN vocab v USING (term)),
ptfidf AS (SELECT product, term, w / sqrt(sum(w * w) OVER (PARTITION BY product)) AS tfidf FROM pw),
pxs AS (SELECT product, sum(tfidf) AS x FROM ptfidf GROUP BY product),
pbase AS (SELECT prod.product, c.label, c.code, c.log_prior + coalesce(pxs.x, 0) * (0.0 - c.log_norm) AS base
          FROM prod LEFT JOIN pxs USING (product) CROSS JOIN cls c),
psp AS (SELECT t.product, f.label, sum(t.tfidf * f.delta) AS sp FROM ptfidf t JOIN feat f USING (term)
        GROUP BY t.product, f.label),
pjll AS (SELECT b.product, b.label, b.code, b.base + coalesce(psp.sp, 0) AS jll
         FROM pbase b LEFT JOIN psp USING (product, label)),
pbest AS (SELECT product, label AS category FROM (SELECT *, row_number() OVER (PARTITION BY product
          ORDER BY jll DESC, code) AS rn FROM pjll) WHERE rn = 1),
rpred AS (SELECT rit.receipt_no, rit.receipt_id, rit.pos, rit.product, pbest.category
          FROM rit LEFT JOIN pbest USING (product))"""

FLOW_CHAIN = f"{CHAIN},\n{SQL_RECEIPTS},\n{_PRODUCTS_SQL}"
_BI = "SELECT DISTINCT receipt_id AS basket_id, category AS item FROM rpred WHERE category IS NOT NULL"
FLOW_RULES = f"""{FLOW_CHAIN},
{sql_itemsets_ctes('receipts', 'fallback', 4, _BI)},
{RULES_CTES}"""


@register("receipt_predictions", "M14 M16 J3 D3", sql=f"""{FLOW_CHAIN}
SELECT receipt_no, receipt_id, pos, product, category FROM rpred""")
def q_receipt_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return FL.receipt_predictions(_receipts(spark, sf), prepared(spark, sf))


@register("receipt_json", "S9 O4", sql=None)
def q_receipt_json(spark: SparkSession, sf: str) -> DataFrame:
    pred = FL.receipt_predictions(_receipts(spark, sf), prepared(spark, sf))
    return FL.receipt_json(pred)


@register("basket_report", "R12 R1 R2 A21", sql=f"""{FLOW_RULES}
SELECT CASE WHEN (SELECT n FROM nn) <= 1 THEN 'insufficient_transactions'
            WHEN (SELECT count(*) FROM its) = 0 THEN 'no_frequent_itemsets'
            WHEN (SELECT count(*) FROM its WHERE k >= 2) = 0 THEN 'no_rules'
            WHEN (SELECT count(*) FROM kept) = 0 THEN 'no_positive_rules' ELSE 'ok' END AS status,
       (SELECT n FROM nn) AS total_transactions, CAST((SELECT s FROM mc) AS DOUBLE) AS min_support_used,
       (SELECT count(*) FROM kept) AS total_positive_rules_found""")
def q_basket_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).summary()


@register("basket_report_rules", "R12 O1 O2", sql=f"""{FLOW_RULES}
SELECT {RULE_SELECT} FROM kept ORDER BY lift DESC, support DESC, confidence DESC, if_key, then_key LIMIT 10""")
def q_basket_report_rules(spark: SparkSession, sf: str) -> DataFrame:
    rep = _report(spark, sf)
    if rep.analysis.positive is None:
        return _rule_cols(rep.top_rules())
    return _rule_cols(R.top_rules(rep.analysis.positive))


@register("shelf_optimization", "R11 U4 R9 A21", sql=f"""{FLOW_RULES},
sc AS (SELECT DISTINCT unnest(list_concat(a_items, c_items)) AS category FROM kept),
sh AS ({_sql_shelves('nation')}),
ost AS (SELECT CASE WHEN (SELECT n FROM nn) <= 1 THEN 'insufficient_transactions'
            WHEN (SELECT count(*) FROM its) = 0 THEN 'no_frequent_itemsets'
            WHEN (SELECT count(*) FROM its WHERE k >= 2) = 0 THEN 'no_rules'
            WHEN (SELECT count(*) FROM kept) = 0 THEN 'no_positive_rules' ELSE 'ok' END AS status),
asg AS (SELECT CASE WHEN (SELECT status FROM ost) = 'ok'
                    THEN least((SELECT count(*) FROM sc), (SELECT count(*) FROM sh)) ELSE 0 END AS a)
SELECT (SELECT status FROM ost) AS status, (SELECT n FROM nn) AS total_transactions,
       CAST((SELECT s FROM mc) AS DOUBLE) AS min_support_used, (SELECT count(*) FROM kept) AS total_positive_rules_found,
       (SELECT a FROM asg) AS assigned_shelves, (SELECT count(*) FROM sh) - (SELECT a FROM asg) AS unassigned_shelves""")
def q_shelf_optimization(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    plan = FL.shelf_optimization(_receipts(spark, sf), shelf_grid(n, "k"), prepared(spark, sf), "maximize")
    return plan.summary()


# ---------------------------------------------------------------- receipts of parts
# Catalogue = part (p_name -> p_brand); a receipt line = the comma-joined p_name of an order's lines.  With the
# classes this close to each other and support 0.01 the flows find rules and place shelves.

PART_SUPPORT = 0.01


def _part_prepared(spark: SparkSession, sf: str) -> T.Prepared:
    key = (spark.sparkContext.applicationId, sf, "part")
    if key not in _RECEIPTS:
        _RECEIPTS[key] = T.prepare(table(spark, sf, "part"), "p_partkey", "p_name", "p_brand")
    return _RECEIPTS[key]


def _order_receipts(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, "orders")
    if key not in _RECEIPTS:
        lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        item = F.struct("l_linenumber", "l_partkey", "p_name")
        orders = lines.join(names, "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("l"))
        text = F.array_join(F.transform("l", lambda x: x["p_name"]), ", ")
        # orders are gathered once, and their receipts parsed and numbered once: several jobs read them
        texts = cut_lineage(orders.select("l_orderkey", text.alias("text")))
        _RECEIPTS[key] = cut_lineage(receipts_from_texts(texts, "text", ["l_orderkey"]))
    return _RECEIPTS[key]


def _order_report(spark: SparkSession, sf: str) -> FL.BasketReport:
    key = (spark.sparkContext.applicationId, sf, "orders")
    if key not in _REPORTS:
        _REPORTS[key] = FL.basket_report(_order_receipts(spark, sf), _part_prepared(spark, sf), support=PART_SUPPORT)
    return _REPORTS[key]


_PART_DOCS = "(SELECT p_partkey AS doc_id, p_name AS text, p_brand AS lang FROM part) documents"
PART_CHAIN = f"""{CHAIN.replace("FROM documents", "FROM " + _PART_DOCS)},
oi AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey) AS items
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
rnz AS (SELECT items, row_number() OVER (ORDER BY l_orderkey) AS receipt_no FROM oi),
rit AS (SELECT receipt_no, printf('Siparis_%02d', receipt_no) AS receipt_id, unnest(items) AS product,
               CAST(unnest(range(0, len(items))) AS INTEGER) AS pos FROM rnz),
{_PRODUCTS_SQL}"""


def part_rules_sql(max_k: int) -> str:
    """Itemsets up to ``max_k`` items (the largest that occurs), rules and what is kept of them."""
    return f"""{PART_CHAIN},
{sql_itemsets_ctes('receipts', '0.01', max_k, _BI)},
{RULES_CTES}"""


MAX_ITEMSET = 4  #: no itemset of the orders is larger at support 0.01 (checked by a test)


@register("order_report", "R12 R1 R2 A21", sql=f"""{part_rules_sql(MAX_ITEMSET)}
SELECT 'ok' AS status, (SELECT n FROM nn) AS total_transactions, CAST(0.01 AS DOUBLE) AS min_support_used,
       (SELECT count(*) FROM kept) AS total_positive_rules_found""")
def q_order_report(spark: SparkSession, sf: str) -> DataFrame:
    return _order_report(spark, sf).summary()


@register("order_report_rules", "R12 O1 O2", sql=f"""{part_rules_sql(MAX_ITEMSET)}
SELECT {RULE_SELECT} FROM kept ORDER BY lift DESC, support DESC, confidence DESC, if_key, then_key LIMIT 10""")
def q_order_report_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rule_cols(_order_report(spark, sf).top_rules())


@register("order_results", "S9 O4 M16", sql=f"""{PART_CHAIN},
per AS (SELECT receipt_no, receipt_id, list(product ORDER BY pos) AS ps, list(category ORDER BY pos) AS cs FROM rpred GROUP BY ALL)
SELECT receipt_no, receipt_id, array_to_string(ps, '|') AS products, array_to_string(cs, '|') AS categories,
       row_number() OVER (ORDER BY receipt_id, receipt_no) AS rank FROM per""")
def q_order_results(spark: SparkSession, sf: str) -> DataFrame:
    pred = FL.receipt_predictions(_order_receipts(spark, sf), _part_prepared(spark, sf))
    parsed = F.from_json("json", "receipt_id string, items array<struct<product:string,category:string>>")
    out = FL.receipt_results(pred).select("receipt_no", "rank", parsed.alias("r"))
    return out.select("receipt_no", "r.receipt_id", F.array_join("r.items.product", "|").alias("products"),
                      F.array_join("r.items.category", "|").alias("categories"), "rank")


def _sql_assignment(goal: str) -> str:
    base = part_rules_sql(MAX_ITEMSET) + f""",
sc0 AS (SELECT cat AS category, sum(lift) AS score
        FROM (SELECT unnest(list_concat(a_items, c_items)) AS cat, lift FROM kept) GROUP BY cat),
sc AS (SELECT category, score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, category) AS INTEGER) AS rank FROM sc0),
sh AS ({_sql_shelves('nation')}),
ctr AS (SELECT avg(x) AS cx, avg(y) AS cy FROM sh),
shr AS (SELECT sh.*, CAST(row_number() OVER (ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), pos) AS INTEGER) AS rank FROM sh, ctr)"""
    place = "shr JOIN sc ON sc.rank = shr.rank" if goal == "maximize" else "shr JOIN sc ON sc.rank = shr.pos + 1"
    return f"{base}\nSELECT shr.pos, shr.name AS shelf, sc.category, round(sc.score, 6) AS score FROM {place}"


def _assignment(spark: SparkSession, sf: str, goal: str) -> DataFrame:
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    plan = FL.shelf_optimization(_order_receipts(spark, sf), shelf_grid(n, "k"), _part_prepared(spark, sf), goal,
                                 support=PART_SUPPORT)
    if plan.assignment is None:  # without positive rules no shelf gets a category
        return spark.createDataFrame([], "pos long, shelf string, category string, score double")
    return plan.assignment.select("pos", "shelf", "category", F.round("score", R6).alias("score"))


@register("shelf_optimization_together", "R11 R7", sql=_sql_assignment("maximize"))
def q_shelf_optimization_together(spark: SparkSession, sf: str) -> DataFrame:
    return _assignment(spark, sf, "maximize")


@register("shelf_optimization_apart", "R11 R8", sql=_sql_assignment("minimize"))
def q_shelf_optimization_apart(spark: SparkSession, sf: str) -> DataFrame:
    return _assignment(spark, sf, "minimize")


@register("lone_basket", "U4", sql=f"""{PART_CHAIN},
b AS (SELECT count(DISTINCT category) AS n FROM rpred WHERE receipt_no = (SELECT max(receipt_no) FROM rpred) AND category IS NOT NULL)
SELECT CASE WHEN n > 1 THEN 'no_positive_rules' ELSE 'no_rules' END AS status, CAST(2 AS BIGINT) AS total_transactions FROM b""")
def q_lone_basket(spark: SparkSession, sf: str) -> DataFrame:
    """The last order's receipt on its own, found over all receipts: its basket is duplicated, so no lift is above 1."""
    receipts = _order_receipts(spark, sf)
    last = receipts.agg(F.max("receipt_no").alias("receipt_no"))
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    plan = FL.shelf_optimization(receipts.join(last, "receipt_no", "left_semi"), shelf_grid(n, "k"), _part_prepared(spark, sf),
                                 "maximize", support=0.1)
    return plan.summary().select("status", "total_transactions")
