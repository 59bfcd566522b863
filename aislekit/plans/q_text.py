"""Registered text, receipt and profiling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import profile as PR
from ..sources.receipts import receipt_items, receipts_from_texts
from ..sources.tables import table
from .registry import register

WS = X.WS_CLASS


def _sql_normalize(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-zçğıöşü{X._WS}]', ' ', 'g'),"
            f" '[0-9]+', ' ', 'g'), '{WS}+', ' ', 'g'), ' ')")


@register("normalize_names", "X1 F1 F2 F3", sql=f"""SELECT doc_id, {_sql_normalize('text')} AS processed_text
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL""")
def q_normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").dropna(subset=["text", "lang"]).select("doc_id", "text")
    return d.select("doc_id", X.normalize_train("text").alias("processed_text"))


@register("fold_ascii", "X2", sql=f"""SELECT p_partkey AS id, translate(p_name, '{X.FOLD_FROM}', '{X.FOLD_TO}') AS folded
FROM part UNION ALL
SELECT doc_id AS id, translate(text, '{X.FOLD_FROM}', '{X.FOLD_TO}') AS folded FROM documents""")
def q_fold_ascii(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.fold_ascii("p_name").alias("folded"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.fold_ascii("text").alias("folded"))
    return p.unionByName(d)


@register("title_case", "X8 X7", sql="""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '),
  lambda w: upper(w[1:1]) || w[2:]), ' ') AS title,
  replace(printf('Siparis_%02d', p_partkey + 1), 'Siparis_', '#') AS display_no FROM part""")
def q_title_case(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.title_case("p_name").alias("title"),
                    X.receipt_display(X.receipt_id(F.col("p_partkey") + 1)).alias("display_no"))


_SPLIT_ITEMS_SQL = (f"list_filter(list_transform(string_split_regex(line, '{X.ITEM_SEPARATOR}'), "
                    f"lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')")


SQL_RECEIPTS = f"""rt AS (
  SELECT conv_id, turn, CASE WHEN row_number() OVER (ORDER BY conv_id, turn) = 1 THEN regexp_replace(text, '^\\x{{feff}}+', '') ELSE text END AS text
  FROM conversations WHERE text IS NOT NULL),
rlines AS (SELECT conv_id, turn, unnest(string_split_regex(text, '{X.LINE_BREAK}')) AS line,
                 unnest(range(1, len(string_split_regex(text, '{X.LINE_BREAK}')) + 1)) AS line_no FROM rt),
rr AS (SELECT conv_id, turn, line_no, {_SPLIT_ITEMS_SQL} AS items FROM rlines),
rnz AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, line_no) AS receipt_no FROM rr WHERE len(items) > 0),
rit AS (SELECT receipt_no, printf('Siparis_%02d', receipt_no) AS receipt_id, unnest(items) AS product,
               CAST(unnest(range(0, len(items))) AS INTEGER) AS pos FROM rnz)"""


@register("receipt_lines", "S2 S3 S4 X3 X4 X5 X6 F4 O4", sql=f"""WITH {SQL_RECEIPTS}
SELECT receipt_no, receipt_id, pos, product FROM rit""")
def q_receipt_lines(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations").where(F.col("text").isNotNull())
    rec = receipts_from_texts(conv, "text", ["conv_id", "turn"])
    return receipt_items(rec).select("receipt_no", "receipt_id", "pos", "product")


# ---------------------------------------------------------------- profiling

# every numeric column of the tables (the query finds them by type)
_NUM = {"part": ["p_partkey", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
        "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax"]}
_CAT = {"part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
        "lineitem": ["l_returnflag", "l_linestatus"]}


def _sql_describe_numeric(t: str, c: str) -> str:
    d = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{t}' AS tbl, '{c}' AS column, count({c}) AS count, round(avg({d}), 6) AS mean, "
            f"round(stddev_samp({d}), 6) AS std, round(min({d}), 6) AS min, "
            f"round(quantile_cont({d}, 0.25), 6) AS p25, round(quantile_cont({d}, 0.5), 6) AS p50, "
            f"round(quantile_cont({d}, 0.75), 6) AS p75, round(max({d}), 6) AS max FROM {t}")


@register("profile_numeric", "P4", sql="\nUNION ALL\n".join(
    _sql_describe_numeric(t, c) for t, cs in _NUM.items() for c in cs))
def q_profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    d = PR.describe_tables({t: (table(spark, sf, t), PR.numeric_columns(table(spark, sf, t))) for t in _NUM})
    return d.select("tbl", "column", "count",
                    *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def _sql_describe_cat(t: str, c: str) -> str:
    return (f"SELECT '{t}' AS tbl, '{c}' AS column, sum(n) AS count, count(*) AS unique, "
            f"arg_min(v, (-n, v)) AS top, max(n) AS freq FROM "
            f"(SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})")


@register("profile_categorical", "P5", sql="\nUNION ALL\n".join(
    _sql_describe_cat(t, c) for t, cs in _CAT.items() for c in cs))
def q_profile_categorical(spark: SparkSession, sf: str) -> DataFrame:
    frames = [PR.describe_categorical(table(spark, sf, t), cs).select(F.lit(t).alias("tbl"), "*")
              for t, cs in _CAT.items()]
    return reduce(DataFrame.unionByName, frames).select(
        "tbl", "column", F.col("count").cast("long").alias("count"), "unique", "top", "freq")




# column lists and Spark type names of the driver tables (FIXTURES §4)
_INFO_SCHEMAS = {
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
}


def _sql_profile_nulls() -> str:
    parts = []
    for t, cols in _INFO_SCHEMAS.items():
        for i, (c, ty) in enumerate(cols):
            parts.append(f"SELECT '{t}' AS tbl, {i} AS position, '{c}' AS column, '{ty}' AS dtype, "
                         f"count({c}) AS non_null, count(*) - count({c}) AS nulls, count(*) AS n_rows FROM {t}")
    return "\nUNION ALL\n".join(parts)


@register("profile_nulls", "P6 P3 P2", sql=_sql_profile_nulls())
def q_profile_nulls(spark: SparkSession, sf: str) -> DataFrame:
    frames = [PR.profile_columns(table(spark, sf, t)).select(F.lit(t).alias("tbl"), "*")
              for t in _INFO_SCHEMAS]
    return reduce(DataFrame.unionByName, frames)


@register("first_rows", "P1 O7", sql="""SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice
FROM part ORDER BY p_partkey LIMIT 5""")
def q_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return PR.first_rows(table(spark, sf, "part"), ["p_partkey"], 5)
