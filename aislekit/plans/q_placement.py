"""Registered placement and insight queries (SURVEY R3-R10, S6, A10-A14, I1-I9, J4-J10, J13, W1-W3,
W6, W7, U3, X9-X13).

Inputs: positive rules of order x ``p_brand`` baskets at support 0.01 (25
brands), shelves from the default grid over ``nation`` (25) or ``supplier``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import insight as I
from ..operators import placement as P
from ..operators import rules as R
from ..functions.text import fixed, title_case
from ..sources.shelves import grid_position, shelf_grid, shelves_from_json
from ..sources.tables import table
from .driver_tables import cached_analysis, order_baskets
from .q_rules import RULES_CTES, sql_itemsets_ctes
from .registry import register

R6 = 6


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    a = cached_analysis(spark, sf, "p_brand", 0.01)
    return a.positive


def _nation_shelves(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("k"))
    return shelf_grid(n, "k")


def _supplier_shelves(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("k"))
    return shelf_grid(s, "k")


def _inputs(spark: SparkSession, sf: str, shelves: str = "nation"):
    rules = _rules(spark, sf)
    rel = P.category_relations(rules)
    scores = P.category_scores(rules)
    sh = _nation_shelves(spark, sf) if shelves == "nation" else _supplier_shelves(spark, sf)
    return rules, rel, scores, sh


def _r(c: str):
    return F.round(c, R6).alias(c)


# ---------------------------------------------------------------- oracle SQL

def _sql_shelves(src: str) -> str:
    key = {"nation": "n_nationkey", "supplier": "s_suppkey"}[src]
    return (f"SELECT CAST({key} AS BIGINT) AS pos, 'Raf ' || CAST({key} + 1 AS VARCHAR) AS name, "
            f"CAST((({key} + 1) % 5) * 90 + 10 AS DOUBLE) AS x, "
            f"CAST((({key} + 1) // 5) * 40 + 10 AS DOUBLE) AS y FROM {src}")


REASON_SQL = {
    "max": P.REASON_MAXIMIZE, "even": P.REASON_EVEN, "odd": P.REASON_ODD,
    "unassigned": P.MSG_UNASSIGNED,
}


def sql_place_base(shelves: str = "nation") -> str:
    """CTE chain: rules (kept), rel, sc (scores + rank), sh, shd, amax, amin."""
    return f"""{sql_itemsets_ctes('p_brand', '0.01', 4)},
{RULES_CTES},
rel0 AS (SELECT unnest(a_items) AS src, c_items, lift, confidence FROM kept),
rel AS (SELECT src, unnest(c_items) AS dst, lift, confidence FROM rel0),
sc0 AS (SELECT cat AS category, sum(lift) AS score
        FROM (SELECT unnest(list_concat(a_items, c_items)) AS cat, lift FROM kept) GROUP BY cat),
sc AS (SELECT category, score, CAST(row_number() OVER (ORDER BY score DESC, category) AS INTEGER) AS rank FROM sc0),
sh AS ({_sql_shelves(shelves)}),
ctr AS (SELECT avg(x) AS cx, avg(y) AS cy FROM sh),
shd AS (SELECT sh.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS distance_to_center FROM sh, ctr),
shr AS (SELECT *, CAST(row_number() OVER (ORDER BY distance_to_center, pos) AS INTEGER) AS rank FROM shd),
amax AS (SELECT shr.pos, shr.name AS shelf, sc.category, '{REASON_SQL["max"]}' AS reason, sc.score,
                sc.rank, shr.distance_to_center, CAST(NULL AS VARCHAR) AS grp
         FROM shr JOIN sc ON sc.rank = shr.rank),
amin AS (SELECT sh.pos, sh.name AS shelf, sc.category,
                CASE WHEN sh.pos % 2 = 0 THEN '{REASON_SQL["even"]}' ELSE '{REASON_SQL["odd"]}' END AS reason,
                sc.score, sc.rank, CAST(NULL AS DOUBLE) AS distance_to_center,
                CASE WHEN sh.pos % 2 = 0 THEN 'even' ELSE 'odd' END AS grp
         FROM sh JOIN sc ON sc.rank = sh.pos + 1),
frel AS (SELECT src, dst, max(lift) AS lift,
                max_by(confidence, struct_pack(l := lift, c := confidence)) AS confidence
         FROM rel GROUP BY src, dst)"""


def _tier(c: str, limits: I.Limits = I.DEFAULT) -> str:
    steps = " ".join(f"WHEN {c} > {bound} THEN '{name}'" for bound, name in limits.lift_tiers)
    return f"CASE {steps} WHEN {c} IS NULL THEN NULL ELSE '{limits.tier_default}' END"


ASSIGN_COLS = "pos, shelf, category, reason, round(score, 6) AS score, rank, round(distance_to_center, 6) AS distance_to_center, grp"


def _assign_out(df: DataFrame) -> DataFrame:
    return df.select("pos", "shelf", "category", "reason", _r("score"), "rank",
                     _r("distance_to_center"), "grp")


# ---------------------------------------------------------------- queries

@register("category_relations", "R3 X14", sql=f"""WITH {sql_place_base()}
SELECT src, dst, round(lift, 6) AS lift, round(confidence, 6) AS confidence FROM rel""")
def q_category_relations(spark: SparkSession, sf: str) -> DataFrame:
    _, rel, _, _ = _inputs(spark, sf)
    return rel.select("src", "dst", _r("lift"), _r("confidence"))


@register("category_scores", "R4 A10 W1 O6", sql=f"""WITH {sql_place_base()}
SELECT category, round(score, 6) AS score, rank FROM sc""")
def q_category_scores(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, _ = _inputs(spark, sf)
    return scores.select("category", _r("score"), "rank")


@register("shelf_grid", "S6", sql=f"SELECT * FROM ({_sql_shelves('nation')})")
def q_shelf_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _nation_shelves(spark, sf)


@register("shelf_centre", "R6 A11 X9 W2", sql=f"""WITH sh AS ({_sql_shelves('nation')}),
ctr AS (SELECT avg(x) AS cx, avg(y) AS cy FROM sh)
SELECT pos, name, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 6) AS distance_to_center,
       CAST(row_number() OVER (ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), pos) AS INTEGER) AS centre_rank,
       round(cx, 6) AS center_x, round(cy, 6) AS center_y
FROM sh, ctr""")
def q_shelf_centre(spark: SparkSession, sf: str) -> DataFrame:
    sh = _nation_shelves(spark, sf)
    d = P.shelf_centre_distance(sh)
    w = Window.orderBy("distance_to_center", "pos")   # shelves of one store: a bounded table
    return d.select("pos", "name", _r("distance_to_center"),
                    F.row_number().over(w).alias("centre_rank"),
                    F.round("cx", R6).alias("center_x"), F.round("cy", R6).alias("center_y"))


@register("place_maximize", "R7 R10 J5 W2", sql=f"WITH {sql_place_base()}\nSELECT {ASSIGN_COLS} FROM amax")
def q_place_maximize(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, sh = _inputs(spark, sf)
    return _assign_out(P.place(sh, scores, "maximize"))


@register("place_minimize", "R8 R10 R13 J6 W3", sql=f"WITH {sql_place_base()}\nSELECT {ASSIGN_COLS} FROM amin")
def q_place_minimize(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, sh = _inputs(spark, sf)
    return _assign_out(P.place(sh, scores, "minimize"))


@register("place_minimize_parity", "J6 R13", sql=f"""WITH {sql_place_base()}
SELECT pos, shelf, category, round(score, 6) AS score, rank FROM amin""")
def q_place_minimize_parity(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, sh = _inputs(spark, sf)
    return P.place_by_parity_groups(sh, scores).select("pos", "shelf", "category", _r("score"), "rank")


@register("unassigned_shelves", "R9 J7", sql=f"""WITH {sql_place_base('supplier')}
SELECT pos, name AS shelf, '{P.MSG_UNASSIGNED}' AS message FROM sh
WHERE name NOT IN (SELECT shelf FROM amax)""")
def q_unassigned_shelves(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, sh = _inputs(spark, sf, "supplier")
    return P.unassigned_shelves(sh, P.place(sh, scores, "maximize"))


@register("recommendations", "J10", sql=f"""WITH {sql_place_base('supplier')}
SELECT a.pos, a.shelf, a.category FROM amax a""")
def q_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, sh = _inputs(spark, sf, "supplier")
    return P.recommendations_in_shelf_order(sh, P.place(sh, scores, "maximize"))


# Second set of display rules, under which every tier, flag and verdict occurs in the driver's tables.
TIGHT = I.Limits(lift_tiers=((1.06, "very_strong"), (1.045, "strong"), (1.03, "moderate"), (1.015, "weak")),
                 near=150.0, far=150.0, strong_lift=1.02, conf_high=0.135, conf_medium=0.125)


def _sql_edges(limits: I.Limits) -> str:
    d = "sqrt((sa.x - sb.x) * (sa.x - sb.x) + (sa.y - sb.y) * (sa.y - sb.y))"
    return f"""WITH {sql_place_base()}
SELECT a.shelf AS shelf_a, b.shelf AS shelf_b, f.src AS category_a, f.dst AS category_b,
       round(f.lift, 6) AS lift, round(f.confidence, 6) AS confidence, round({d}, 6) AS distance,
       {_tier('f.lift', limits)} AS tier,
       round((400.0 - least(greatest({d}, 50.0), 400.0)) / 350.0, 6) AS fade,
       CASE WHEN {d} > {limits.far} AND f.lift > {limits.strong_lift} THEN 'good'
            WHEN {d} < {limits.near} AND f.lift > {limits.strong_lift} THEN 'bad' END AS separation
FROM frel f JOIN amin a ON a.category = f.src JOIN amin b ON b.category = f.dst
JOIN sh sa ON sa.name = a.shelf JOIN sh sb ON sb.name = b.shelf"""


def _edges(spark: SparkSession, sf: str, limits: I.Limits) -> DataFrame:
    _, rel, scores, sh = _inputs(spark, sf)
    e = I.shelf_edges(rel, P.place(sh, scores, "minimize"), sh, "minimize", limits=limits)
    return e.select("shelf_a", "shelf_b", "category_a", "category_b", _r("lift"), _r("confidence"),
                    _r("distance"), "tier", _r("fade"), "separation")


@register("shelf_edges", "I3 J8 F8 W6 X11 I2", sql=_sql_edges(I.DEFAULT))
def q_shelf_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, I.DEFAULT)


@register("shelf_edges_tight", "I2 I3", sql=_sql_edges(TIGHT))
def q_shelf_edges_tight(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf, TIGHT)


@register("relation_matrix", "I4 U3 W6", sql=f"""WITH {sql_place_base()}
SELECT f.src AS row_category, f.dst AS col_category, r.rank AS row_pos, c.rank AS col_pos,
       round(f.lift, 6) AS lift, {_tier('f.lift')} AS tier
FROM frel f JOIN sc r ON r.category = f.src JOIN sc c ON c.category = f.dst WHERE f.src <> f.dst""")
def q_relation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    _, rel, scores, _ = _inputs(spark, sf)
    m = I.relation_matrix(rel, scores)
    return m.select("row_category", "col_category", "row_pos", "col_pos", _r("lift"), "tier")


@register("score_chart", "I5 A14 X13 W7", sql=f"""WITH {sql_place_base()}
SELECT category, round(score, 6) AS score, round(score / (SELECT max(score) FROM sc) * 100, 6) AS pct_of_max,
       rank FROM sc""")
def q_score_chart(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, _ = _inputs(spark, sf)
    return I.score_chart(scores).select("category", _r("score"), _r("pct_of_max"), "rank")


@register("category_detail", "I6 J9 J13 O5", sql=f"""WITH {sql_place_base()}
SELECT s.category, round(s.score, 6) AS score, s.rank, a.shelf, r.dst AS related_category,
       round(r.lift, 6) AS related_lift, {_tier('r.lift')} AS related_tier, b.shelf AS related_shelf
FROM sc s LEFT JOIN amax a ON a.category = s.category
LEFT JOIN rel r ON r.src = s.category
LEFT JOIN amax b ON b.category = r.dst""")
def q_category_detail(spark: SparkSession, sf: str) -> DataFrame:
    _, rel, scores, sh = _inputs(spark, sf)
    d = I.category_detail(rel, scores, P.place(sh, scores, "maximize"))
    return d.select("category", _r("score"), "rank", "shelf", "related_category",
                    F.round("related_lift", R6).alias("related_lift"), "related_tier", "related_shelf")


@register("category_detail_sorted", "I6 O5", sql=f"""WITH {sql_place_base()},
cd AS (SELECT s.category, s.score, s.rank, a.shelf, r.dst, r.lift, b.shelf AS related_shelf
FROM sc s LEFT JOIN amax a ON a.category = s.category LEFT JOIN rel r ON r.src = s.category LEFT JOIN amax b ON b.category = r.dst)
SELECT category, round(any_value(score), 6) AS score, any_value(rank) AS rank, any_value(shelf) AS shelf,
       coalesce(string_agg(dst, '>' ORDER BY lift DESC, dst DESC) FILTER (dst IS NOT NULL), '') AS related,
       count(dst) AS n_related FROM cd GROUP BY category""")
def q_category_detail_sorted(spark: SparkSession, sf: str) -> DataFrame:
    _, rel, scores, sh = _inputs(spark, sf)
    d = I.category_detail_nested(I.category_detail(rel, scores, P.place(sh, scores, "maximize")))
    return d.select("category", _r("score"), "rank", "shelf",
                    F.array_join(F.transform("relations", lambda r: r["category"]), ">").alias("related"),
                    F.size("relations").cast("long").alias("n_related"))


@register("shelf_detail", "I7 J13", sql=f"""WITH {sql_place_base()}
SELECT a.shelf, a.category, a.reason, round(a.score, 6) AS score, a.rank, r.dst AS related_category,
       round(r.lift, 6) AS related_lift, {_tier('r.lift')} AS related_tier
FROM amin a LEFT JOIN rel r ON r.src = a.category""")
def q_shelf_detail(spark: SparkSession, sf: str) -> DataFrame:
    _, rel, scores, sh = _inputs(spark, sf)
    d = I.shelf_detail(P.place(sh, scores, "minimize"), rel)
    return d.select("shelf", "category", "reason", _r("score"), "rank", "related_category",
                    F.round("related_lift", R6).alias("related_lift"), "related_tier")


def _sql_verdict(goal: str, limits: I.Limits) -> str:
    good, bad = ("d0 < {near}", "d0 > {far}") if goal == "maximize" else ("d0 > {far}", "d0 < {near}")
    good, bad = (f"{x.format(near=limits.near, far=limits.far)} AND lift > {limits.strong_lift}" for x in (good, bad))
    table = "amax" if goal == "maximize" else "amin"
    return f"""WITH {sql_place_base()},
pv AS (SELECT f.src AS category_a, f.dst AS category_b, f.lift, f.confidence, a.shelf AS shelf_a, b.shelf AS shelf_b,
              sqrt((sa.x - sb.x) * (sa.x - sb.x) + (sa.y - sb.y) * (sa.y - sb.y)) AS d0
       FROM frel f LEFT JOIN {table} a ON a.category = f.src LEFT JOIN {table} b ON b.category = f.dst
       LEFT JOIN sh sa ON sa.name = a.shelf LEFT JOIN sh sb ON sb.name = b.shelf)
SELECT category_a, category_b, round(lift, 6) AS lift, round(confidence, 6) AS confidence, {_tier('lift', limits)} AS tier,
       shelf_a, shelf_b, round(CASE WHEN d0 <> 0 THEN d0 END, 6) AS distance,
       CASE WHEN d0 IS NULL OR d0 = 0 THEN NULL WHEN {good} THEN 'good' WHEN {bad} THEN 'bad' ELSE 'neutral' END AS verdict
FROM pv"""


def _verdicts(spark: SparkSession, sf: str, goal: str, limits: I.Limits) -> DataFrame:
    _, rel, scores, sh = _inputs(spark, sf)
    v = I.placement_verdict(rel, P.place(sh, scores, goal), sh, goal, limits=limits)
    return v.select("category_a", "category_b", _r("lift"), _r("confidence"), "tier", "shelf_a", "shelf_b",
                    _r("distance"), "verdict")


@register("placement_verdict", "I8 J9", sql=_sql_verdict("maximize", I.DEFAULT))
def q_placement_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, "maximize", I.DEFAULT)


@register("placement_verdict_tight", "I8", sql=_sql_verdict("maximize", TIGHT))
def q_placement_verdict_tight(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, "maximize", TIGHT)


@register("placement_verdict_apart", "I8", sql=_sql_verdict("minimize", TIGHT))
def q_placement_verdict_apart(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, "minimize", TIGHT)


@register("shelf_positions_scaled", "I9 A12 X10", sql=f"""WITH sh AS ({_sql_shelves('supplier')}),
b AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM sh)
SELECT pos, name, x, y,
  round((x - min_x) * ((800.0 - 60.0) / CASE WHEN max_x - min_x <> 0 THEN max_x - min_x ELSE 1.0 END) + 30.0, 6) AS map_x,
  round((y - min_y) * ((500.0 - 60.0) / CASE WHEN max_y - min_y <> 0 THEN max_y - min_y ELSE 1.0 END) + 30.0, 6) AS map_y
FROM sh, b""")
def q_shelf_positions_scaled(spark: SparkSession, sf: str) -> DataFrame:
    s = I.shelf_positions_scaled(_supplier_shelves(spark, sf))
    return s.select("pos", "name", "x", "y", _r("map_x"), _r("map_y"))


# ---------------------------------------------------------------- rule cards and JSON shelves

@register("rule_cards", "I1 X8 X12 O2", sql=f"""WITH {sql_itemsets_ctes('p_brand', '0.01', 4)},
{RULES_CTES},
top AS (SELECT *, CAST(row_number() OVER (ORDER BY lift DESC, support DESC, confidence DESC, if_key, then_key)
                       AS INTEGER) AS card FROM kept)
SELECT card, array_to_string(list_transform(a_items, lambda c: array_to_string(list_transform(
         string_split(lower(c), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')), ', ') AS if_title,
       array_to_string(list_transform(c_items, lambda c: array_to_string(list_transform(
         string_split(lower(c), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')), ', ') AS then_title,
       printf('%.3f', support) AS support, printf('%.3f', confidence) AS confidence,
       printf('%.2f', lift) AS lift,
       CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS confidence_tier,
       CASE WHEN confidence > 0.135 THEN 'high' WHEN confidence > 0.125 THEN 'medium' ELSE 'low' END AS tight_tier
FROM top WHERE card <= 10""")
def q_rule_cards(spark: SparkSession, sf: str) -> DataFrame:
    top = R.top_rules(_rules(spark, sf))
    w = Window.orderBy(F.col("lift").desc(), F.col("support").desc(), F.col("confidence").desc(),
                       F.concat_ws("|", "if_categories"), F.concat_ws("|", "then_categories"))
    return top.select(F.row_number().over(w).alias("card"),   # window over the 10 cards only
                      F.array_join(F.transform("if_categories", title_case), ", ").alias("if_title"),
                      F.array_join(F.transform("then_categories", title_case), ", ").alias("then_title"),
                      fixed("support", 3).alias("support"), fixed("confidence", 3).alias("confidence"),
                      fixed("lift", 2).alias("lift"),
                      I.confidence_tier(F.col("confidence")).alias("confidence_tier"),
                      I.confidence_tier(F.col("confidence"), TIGHT).alias("tight_tier"))


def _region_shelf_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON shelf list per region (store): the region's nations on the default grid."""
    n = table(spark, sf, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")   # one store's shelves
    k = F.row_number().over(w)
    g = n.select("n_regionkey", "n_nationkey", k.alias("k"))
    x, y = grid_position(F.col("k"))
    items = g.select("n_regionkey", F.struct(F.col("k").alias("k"),
                                             F.concat(F.lit("Raf "), F.col("k").cast("string")).alias("name"),
                                             x.alias("x"), y.alias("y")).alias("s"))
    per = items.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("s")).alias("a"))
    return per.select("n_regionkey", F.to_json(F.transform("a", lambda s: F.struct(
        s["name"].alias("name"), s["x"].alias("x"), s["y"].alias("y")))).alias("cabinets"))


@register("shelves_json", "S5 X15", sql=f"""SELECT n_regionkey,
  CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos,
  'Raf ' || CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR) AS name,
  CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) % 5) * 90 + 10 AS DOUBLE) AS x,
  CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) // 5) * 40 + 10 AS DOUBLE) AS y
FROM nation""")
def q_shelves_json(spark: SparkSession, sf: str) -> DataFrame:
    return shelves_from_json(_region_shelf_json(spark, sf), "cabinets", by=["n_regionkey"])
