"""Registered feature, classifier and evaluation queries.

Catalogue stand-in: ``documents`` (text -> lang).  One :class:`training.Prepared`
per (session, sf) is reused by the queries of one process.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import classify as C
from ..operators import evaluate as E
from ..operators import features as FE
from ..operators import tree as TR
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_catalogue, table
from . import persist as PS
from . import training as T
from .registry import register

R6 = 6
_PREPARED: dict = {}


def prepared(spark: SparkSession, sf: str) -> T.Prepared:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREPARED:
        _PREPARED[key] = T.prepare(table(spark, sf, "documents"), "doc_id", "text", "lang")
    return _PREPARED[key]


def _r(c: str, name: str | None = None):
    return F.round(c, R6).alias(name or c)


# ---------------------------------------------------------------- oracle SQL chain

_WS = X._WS
_NORM = (f"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-zçğıöşü{_WS}]', ' ', 'g'),"
         f" '[0-9]+', ' ', 'g'), '[{_WS}]+', ' ', 'g'), ' ')")

SQL_TFIDF = f"""d AS (SELECT doc_id, {_NORM} AS t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
tok AS (SELECT doc_id, regexp_extract_all(lower(t), '{X.TOKEN_PATTERN}') AS toks FROM d),
uni AS (SELECT doc_id, unnest(toks) AS term, unnest(range(1, len(toks) + 1)) AS pos FROM tok),
big AS (SELECT a.doc_id, a.term || ' ' || b.term AS term FROM uni a JOIN uni b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
allt AS (SELECT doc_id, term FROM uni UNION ALL SELECT doc_id, term FROM big),
tf AS (SELECT doc_id, term, count(*) AS tf FROM allt GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM d),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term),
vtop AS (SELECT term, df, total FROM st ORDER BY total DESC, term LIMIT {FE.MAX_FEATURES}),
vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df,
                 ln((1.0 + (SELECT n FROM nd)) / (1.0 + df)) + 1.0 AS idf FROM vtop),
w AS (SELECT tf.doc_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN vocab v USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""

SQL_SPLIT = """lab AS (SELECT doc_id, lang AS label FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
cc AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
keep AS (SELECT * FROM cc WHERE n >= 2),
labk AS (SELECT lab.* FROM lab JOIN keep USING (label)),
ntot AS (SELECT sum(n) AS nn, sum(n) - CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n)) AS BIGINT) AS ntrain FROM keep),
q AS (SELECT label, n, n * (SELECT ntrain FROM ntot) / (SELECT nn FROM ntot) AS cont FROM keep),
q2 AS (SELECT *, floor(cont) AS fl FROM q),
need AS (SELECT (SELECT ntrain FROM ntot) - sum(fl) AS need FROM q2),
q3 AS (SELECT label, n - fl - CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, label) <= (SELECT need FROM need)
                              THEN 1 ELSE 0 END AS test_quota FROM q2),
rk AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS k
       FROM labk),
split AS (SELECT rk.doc_id, rk.label, CASE WHEN k <= test_quota THEN 'test' ELSE 'train' END AS split
          FROM rk JOIN q3 USING (label)),
codes AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT label FROM lab))"""

SQL_NB = """tr AS (SELECT doc_id, label FROM split WHERE split = 'train'),
te AS (SELECT doc_id, label FROM split WHERE split = 'test'),
vsize AS (SELECT count(*) AS v FROM vocab),
fc AS (SELECT tr.label, t.term, sum(t.tfidf) AS fc FROM tfidf t JOIN tr USING (doc_id) GROUP BY tr.label, t.term),
tot AS (SELECT label, sum(fc) AS tot FROM fc GROUP BY label),
ntr AS (SELECT count(*) AS n FROM tr),
cls AS (SELECT d.label, c.code, d.n_docs, ln(d.n_docs / (SELECT n FROM ntr)) AS log_prior,
               ln(coalesce(t.tot, 0) + 1.0 * (SELECT v FROM vsize)) AS log_norm
        FROM (SELECT label, count(*) AS n_docs FROM tr GROUP BY label) d
        LEFT JOIN tot t USING (label) JOIN codes c USING (label)),
feat AS (SELECT label, term, fc, ln(fc + 1.0) AS delta FROM fc WHERE fc > 0),
xs AS (SELECT doc_id, sum(tfidf) AS x FROM tfidf GROUP BY doc_id),
base AS (SELECT te.doc_id, c.label, c.code, c.log_prior + coalesce(xs.x, 0) * (0.0 - c.log_norm) AS base
         FROM te LEFT JOIN xs USING (doc_id) CROSS JOIN cls c),
sp AS (SELECT t.doc_id, f.label, sum(t.tfidf * f.delta) AS sp
       FROM tfidf t JOIN te USING (doc_id) JOIN feat f USING (term) GROUP BY t.doc_id, f.label),
jll AS (SELECT b.doc_id, b.label, b.code, b.base + coalesce(sp.sp, 0) AS jll FROM base b LEFT JOIN sp USING (doc_id, label)),
jm AS (SELECT *, exp(jll - max(jll) OVER (PARTITION BY doc_id)) AS z FROM jll),
prob AS (SELECT doc_id, label, code, z / sum(z) OVER (PARTITION BY doc_id) AS proba FROM jm),
best AS (SELECT doc_id, label AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jll DESC, code) AS rn FROM jll) WHERE rn = 1),
pred AS (SELECT te.doc_id, te.label AS y, best.p FROM te JOIN best USING (doc_id)),
labs AS (SELECT y AS label FROM pred UNION SELECT p AS label FROM pred),
pc0 AS (SELECT l.label, sum(CASE WHEN pr.y = l.label AND pr.p = l.label THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN pr.y = l.label THEN 1 ELSE 0 END) AS support,
               sum(CASE WHEN pr.p = l.label THEN 1 ELSE 0 END) AS predicted
        FROM labs l CROSS JOIN pred pr GROUP BY l.label),
pc1 AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall, support FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pc1)"""

CHAIN = f"WITH {SQL_TFIDF},\n{SQL_SPLIT},\n{SQL_NB}"


# ---------------------------------------------------------------- class tables over part

def _part_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("category"))


_SQL_PART_CLASSES = "SELECT p_partkey, concat_ws('/', p_brand, CAST(p_size AS VARCHAR)) AS category FROM part"


@register("class_counts", "A1", sql=f"""SELECT category AS label, count(*) AS n FROM ({_SQL_PART_CLASSES}) GROUP BY category""")
def q_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return FE.class_counts(_part_classes(spark, sf), "category")


@register("top_classes", "O3", sql=f"""SELECT category AS label, count(*) AS n FROM ({_SQL_PART_CLASSES})
GROUP BY category ORDER BY n DESC, label LIMIT 10""")
def q_top_classes(spark: SparkSession, sf: str) -> DataFrame:
    return FE.top_classes(FE.class_counts(_part_classes(spark, sf), "category"))


@register("rare_class_filter", "A2 A3 A4 F5", sql=f"""WITH c AS (SELECT category, count(*) AS n FROM ({_SQL_PART_CLASSES}) GROUP BY category),
k AS (SELECT count(*) AS kept_check FROM ({_SQL_PART_CLASSES}) WHERE category IN (SELECT category FROM c WHERE n >= 2))
SELECT count(*) AS n_classes, count(*) FILTER (WHERE n = 1) AS n_singletons,
       CAST(coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS kept_rows,
       CAST(coalesce(sum(n) FILTER (WHERE n < 2), 0) AS BIGINT) AS removed_rows,
       (SELECT kept_check FROM k) AS kept_after_filter FROM c""")
def q_rare_class_filter(spark: SparkSession, sf: str) -> DataFrame:
    pc = _part_classes(spark, sf)
    s = FE.rare_class_summary(FE.class_counts(pc, "category"))
    kept = FE.drop_rare_classes(pc, "category").agg(F.count(F.lit(1)).alias("kept_after_filter"))
    return s.unionByName(kept, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("n_classes", "n_singletons", "kept_rows", "removed_rows", "kept_after_filter")])


# ---------------------------------------------------------------- documents: features

@register("label_encode", "M7 M8 J11", sql=f"""WITH {SQL_SPLIT} SELECT label, code FROM codes""")
def q_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).codes.select("label", "code")


@register("stratified_split", "M9 W4", sql=f"""WITH {SQL_SPLIT} SELECT doc_id, label, split FROM split""")
def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).split.select("doc_id", "label", "split")


@register("tfidf_vocabulary", "M2 M3 M5", sql=f"""WITH {SQL_TFIDF}
SELECT term, idx, df, round(idf, 6) AS idf FROM vocab""")
def q_tfidf_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    v = prepared(spark, sf).tfidf.vocab
    return v.select("term", "idx", "df", _r("idf"))


@register("tfidf_terms", "M1 M2 M4 M6 J12", sql=f"""WITH {SQL_TFIDF}
SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf""")
def q_tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, sf).weights.select("doc_id", "term", _r("tfidf"))


@register("balanced_weights", "M10", sql=f"""WITH {SQL_SPLIT},
tr AS (SELECT label FROM split WHERE split = 'train'),
c AS (SELECT label, count(*) AS n FROM tr GROUP BY label)
SELECT label, n, round((SELECT count(*) FROM tr) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def q_balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = prepared(spark, sf)
    return FE.balanced_weights(p.rows("train"), "label").select("label", "n", _r("weight"))


# ---------------------------------------------------------------- naive bayes

@register("nb_model", "M11", sql=f"""{CHAIN}
SELECT label, code, n_docs, round(log_prior, 6) AS log_prior, round(log_norm, 6) AS log_norm FROM cls""")
def q_nb_model(spark: SparkSession, sf: str) -> DataFrame:
    nb = T.train_naive_bayes(prepared(spark, sf))
    return nb.classes.select("label", "code", "n_docs", _r("log_prior"), _r("log_norm"))


@register("nb_feature_log_prob", "M11", sql=f"""{CHAIN}
SELECT f.label, f.term, round(ln(f.fc + 1.0) - c.log_norm, 6) AS log_prob FROM feat f JOIN cls c USING (label)""")
def q_nb_feature_log_prob(spark: SparkSession, sf: str) -> DataFrame:
    nb = T.train_naive_bayes(prepared(spark, sf))
    return nb.feature_log_prob().select("label", "term", _r("log_prob"))


@register("nb_predict", "M14 M17 J3", sql=f"""{CHAIN}
SELECT doc_id, y, p FROM pred""")
def q_nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    pred, _ = T.nb_holdout(prepared(spark, sf))
    return pred


@register("nb_proba", "M15", sql=f"""{CHAIN}
SELECT doc_id, label, round(proba, 6) AS proba FROM prob""")
def q_nb_proba(spark: SparkSession, sf: str) -> DataFrame:
    _, proba = T.nb_holdout(prepared(spark, sf))
    return proba.select("doc_id", "label", _r("proba"))


# ---------------------------------------------------------------- evaluation

@register("classification_report", "A15 A16 U1", sql=f"""{CHAIN},
acc AS (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS a, count(*) AS s FROM pred)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(a, 6), s FROM acc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc""")
def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    pred, _ = T.nb_holdout(prepared(spark, sf))
    r = E.classification_report(pred)
    return r.select("label", _r("precision"), _r("recall"), _r("f1"), F.col("support").cast("long"))


@register("weighted_precision", "A17", sql=f"""{CHAIN}
SELECT round(sum(precision * support) / sum(support), 6) AS weighted_precision FROM pc""")
def q_weighted_precision(spark: SparkSession, sf: str) -> DataFrame:
    pred, _ = T.nb_holdout(prepared(spark, sf))
    return E.weighted_precision(pred).select(_r("weighted_precision"))


_SQL_CHECK = """chk AS (SELECT count(*) AS bad FROM (SELECT label AS rl FROM labs) r
             FULL JOIN (SELECT DISTINCT label AS cl FROM prob) c ON r.rl = c.cl
             WHERE r.rl IS NULL OR c.cl IS NULL)"""


@register("log_loss", "A18", sql=f"""{CHAIN},
{_SQL_CHECK},
ll AS (SELECT -avg(ln(least(greatest(pr.proba, {E.EPS!r}), 1 - {E.EPS!r}))) AS v
       FROM prob pr JOIN te ON te.doc_id = pr.doc_id AND te.label = pr.label)
SELECT round(CASE WHEN (SELECT bad FROM chk) = 0 THEN v END, 6) AS log_loss,
       CASE WHEN (SELECT bad FROM chk) = 0 THEN 'ok' ELSE 'label_mismatch' END AS status FROM ll""")
def q_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    pred, proba = T.nb_holdout(prepared(spark, sf))
    return E.log_loss(pred, proba).select(_r("log_loss"), "status")


@register("roc_auc_ovr", "A19", sql=f"""{CHAIN},
{_SQL_CHECK},
sc AS (SELECT pr.label, pr.proba AS score, CASE WHEN te.label = pr.label THEN 1 ELSE 0 END AS pos
       FROM prob pr JOIN te USING (doc_id)),
h AS (SELECT label, score, sum(pos) AS p, sum(1 - pos) AS q FROM sc GROUP BY label, score),
hc AS (SELECT *, sum(q) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cq FROM h),
per AS (SELECT label, sum(p * (cq - q + q / 2.0)) AS u, sum(p) AS pp, sum(q) AS qq FROM hc GROUP BY label),
atot AS (SELECT sum(u / (pp * qq) * pp) / sum(pp) AS auc, count(*) FILTER (WHERE pp = 0) AS undef FROM per)
SELECT round(CASE WHEN (SELECT bad FROM chk) = 0 AND undef = 0 THEN auc END, 6) AS roc_auc,
       CASE WHEN (SELECT bad FROM chk) <> 0 THEN 'label_mismatch' WHEN undef <> 0 THEN 'undefined' ELSE 'ok' END AS status
FROM atot""")
def q_roc_auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    pred, proba = T.nb_holdout(prepared(spark, sf))
    return E.roc_auc_ovr(pred, proba).select(_r("roc_auc"), "status")


# ---------------------------------------------------------------- pyspark.ml models (rows-only checks)

@register("logreg_predict", "M12 M14 M17")
def q_logreg_predict(spark: SparkSession, sf: str) -> DataFrame:
    pred, _ = T.holdout(prepared(spark, sf), "logistic_regression")
    return pred


@register("tree_predict", "M13 M14 M17")
def q_tree_predict(spark: SparkSession, sf: str) -> DataFrame:
    pred, _ = T.holdout(prepared(spark, sf), "decision_tree")
    return pred


def _sql_level(i: int) -> str:
    """Cuts of the nodes ``tn{i}`` (node, doc_id, code) by trying every value, and the next level's nodes."""
    low, high = "((n - up) * weight)", "(up * weight)"
    side = "sum({0} * {0} ORDER BY code) / sum({0} ORDER BY code)"
    return f"""tt{i} AS (SELECT m.node, w.code, w.weight, count(*) FILTER (WHERE m.code = w.code) AS n FROM tn{i} m CROSS JOIN tw w
        GROUP BY m.node, w.code, w.weight),
op{i} AS (SELECT node FROM tt{i} WHERE n > 0 GROUP BY node HAVING count(*) > 1),
cn{i} AS (SELECT m.node, e.idx, e.v, m.code, count(*) AS c FROM tn{i} m JOIN op{i} USING (node) JOIN ent e USING (doc_id)
        GROUP BY m.node, e.idx, e.v, m.code),
gr{i} AS (SELECT a.node, a.idx, a.v, t.code, t.weight, t.n,
               sum(coalesce(c.c, 0)) OVER (PARTITION BY a.node, a.idx, t.code ORDER BY a.v DESC) AS up
        FROM (SELECT DISTINCT node, idx, v FROM cn{i}) a JOIN tt{i} t USING (node)
        LEFT JOIN cn{i} c ON c.node = a.node AND c.idx = a.idx AND c.v = a.v AND c.code = t.code),
pu{i} AS (SELECT node, idx, v, round({side.format(low)} + {side.format(high)}, 9) AS purity
        FROM gr{i} GROUP BY node, idx, v HAVING sum(n - up) > 0),
be{i} AS (SELECT node, idx, v FROM pu{i} QUALIFY row_number() OVER (PARTITION BY node ORDER BY purity DESC, idx, v) = 1),
mo{i} AS (SELECT m.node, m.doc_id, m.code, b.idx, b.v, coalesce(e.v, 0.0) AS x FROM tn{i} m JOIN be{i} b USING (node)
        LEFT JOIN ent e ON e.doc_id = m.doc_id AND e.idx = b.idx),
cu{i} AS (SELECT node, idx, (v + max(x) FILTER (WHERE x < v)) / 2 AS threshold FROM mo{i} GROUP BY node, idx, v),
tn{i + 1} AS MATERIALIZED (SELECT node || CASE WHEN x < v THEN '0' ELSE '1' END AS node, doc_id, code FROM mo{i})"""


TREE_LEVELS = 2


@register("tree_levels", "M13", sql=f"""WITH {SQL_TFIDF},
{SQL_SPLIT},
tr AS (SELECT doc_id, label FROM split WHERE split = 'train'),
sz AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
tw AS (SELECT code, CAST((SELECT sum(n) FROM sz) AS DOUBLE) / (CAST((SELECT count(*) FROM sz) AS DOUBLE) * n) AS weight
       FROM sz JOIN codes USING (label)),
ent AS MATERIALIZED (SELECT doc_id, idx, round(tfidf, 9) AS v FROM tfidf JOIN vocab USING (term) JOIN tr USING (doc_id)),
tn0 AS MATERIALIZED (SELECT 'root' AS node, doc_id, code FROM tr JOIN codes USING (label)),
{", ".join(_sql_level(i) for i in range(TREE_LEVELS))}
""" + "\nUNION ALL\n".join(f"""SELECT {i} AS depth, m.node, {"v.term, round(c.threshold, 6)" if i < TREE_LEVELS else "NULL AS term, CAST(NULL AS DOUBLE)"} AS threshold, k.label, m.n
FROM (SELECT node, code, count(*) AS n FROM tn{i} GROUP BY node, code) m JOIN codes k USING (code)
{f"LEFT JOIN cu{i} c USING (node) LEFT JOIN vocab v ON v.idx = c.idx" if i < TREE_LEVELS else ""}""" for i in range(TREE_LEVELS + 1)))
def q_tree_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The exact tree down to ``TREE_LEVELS`` cuts, split by Spark: term and threshold of each node, and its documents by class.
    Weights are rounded to 9 places, so that values that are equal stay equal however they were added up."""
    p = prepared(spark, sf)
    rows = p.coded.join(p.rows("train"), "doc_id").withColumn("w", F.transform("w", lambda x: F.round(x, 9)))
    nodes = TR.fit(rows, p.codes, max_depth=TREE_LEVELS, local_cells=0).nodes
    names, level = {TR.ROOT: TR.ROOT}, {TR.ROOT: TR.ROOT}
    for _ in range(TREE_LEVELS):
        level = {TR.child(k, side): v + side for k, v in level.items() for side in "01"}
        names |= level
    path = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (nodes.select("depth", path[F.col("node")].alias("node"), "feature", _r("threshold"), F.posexplode("counts").alias("code", "n"))
            .where("n > 0").join(p.codes, "code").join(p.tfidf.vocab.select(F.col("idx").alias("feature"), "term"), "feature", "left")
            .select("depth", "node", "term", "threshold", "label", "n"))


@register("model_compare", "A20")
def q_model_compare(spark: SparkSession, sf: str) -> DataFrame:
    return T.compare_models(prepared(spark, sf)).select(
        "model", _r("accuracy"), _r("weighted_precision"), _r("log_loss"), _r("roc_auc"))


# ---------------------------------------------------------------- files written below the shared folder and read back

_FILES: dict = {}


def _folder(spark: SparkSession, sf: str, name: str) -> tuple[str, bool]:
    """A folder of this application below the checkpoint folder, and whether it is new."""
    key = (spark.sparkContext.applicationId, sf, name)
    new = key not in _FILES
    if new:
        _FILES[key] = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return _FILES[key], new


@register("catalogue_csv", "S1", sql="SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def q_catalogue_csv(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    path, new = _folder(spark, sf, "catalogue")
    if new:
        part.write.option("header", True).csv(path)
    return read_catalogue(spark, path, part.schema)


def _saved(spark: SparkSession, sf: str) -> dict:
    path, new = _folder(spark, sf, "artefacts")
    if new:
        p = prepared(spark, sf)
        PS.save_prepared(p, f"{path}/prepared")
        PS.save_naive_bayes(T.train_naive_bayes(p), f"{path}/nb")
    return PS.load_artifacts(spark, f"{path}/prepared") | {"nb": PS.load_naive_bayes(spark, f"{path}/nb")}


@register("saved_sets", "S7", sql=f"""{CHAIN}
SELECT s.split, s.label, count(DISTINCT s.doc_id) AS n_docs, count(*) AS n_weights, round(sum(t.tfidf), 4) AS weight
FROM split s JOIN tfidf t USING (doc_id) GROUP BY s.split, s.label""")
def q_saved_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf)["sets"].groupBy("split", "label").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_weights"), F.round(F.sum("tfidf"), 4).alias("weight"))


@register("saved_models", "S8", sql=f"""{CHAIN}
SELECT doc_id, y, p FROM pred""")
def q_saved_models(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out predictions of the loaded vocabulary and Naive Bayes model."""
    a, docs = _saved(spark, sf), table(spark, sf, "documents")
    test = a["split"].where("split = 'test'").select("doc_id", "label")
    held = docs.join(test.select("doc_id"), "doc_id", "left_semi")
    rows = a["tfidf"].rows(held, "doc_id", "text")
    return C.best_class(C.score_rows(a["nb"], rows, a["tfidf"].vocab)).join(test, "doc_id").select(
        "doc_id", F.col("label").alias("y"), F.col("predicted").alias("p"))


@register("decode_labels", "J11 M8", sql=f"""{CHAIN}
SELECT pred.doc_id, codes.code, pred.p AS label FROM pred JOIN codes ON codes.label = pred.p""")
def q_decode_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted codes of the hold-out documents, decoded by the label table."""
    p = prepared(spark, sf)
    scores = C.score_rows(T.train_naive_bayes(p), p.coded_of("test"), p.tfidf.vocab)
    codes = C.best_class(scores).select("doc_id", F.col("predicted_code").alias("code"))
    return codes.join(p.codes, "code").select("doc_id", "code", "label")


_CHECKED = ("naive_bayes", "decision_tree", "logistic_regression")


@register("model_invariants", "M12 M13 M14 M15", sql=CHAIN + "\n" + "\nUNION ALL\n".join(f"""SELECT '{k}' AS model, (SELECT count(*) FROM te) AS n_docs,
       (SELECT count(*) FROM te) * (SELECT count(*) FROM codes) AS n_probabilities, CAST(0 AS BIGINT) AS n_wrong_sums,
       true AS beats_majority""" for k in _CHECKED))
def q_model_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction a hold-out document, one probability a class, sums of 1, more right than the largest class."""
    p = prepared(spark, sf)
    frames = []
    for kind in _CHECKED:
        pred, proba = T.holdout(p, kind)
        largest = pred.groupBy("y").count().agg(F.max("count").alias("largest"))
        right = pred.agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("y") == F.col("p")).cast("long")).alias("right"))
        sums = proba.groupBy("doc_id").agg(F.sum("proba").alias("s"), F.count(F.lit(1)).alias("n")).agg(
            F.sum("n").alias("n_probabilities"), F.sum((F.abs(F.col("s") - 1) > 1e-6).cast("long")).alias("n_wrong_sums"))
        row = right.withColumns({"largest": largest.scalar(), "n_probabilities": sums.select("n_probabilities").scalar(),
                                 "n_wrong_sums": sums.select("n_wrong_sums").scalar()})
        frames.append(row.select(F.lit(kind).alias("model"), "n_docs", "n_probabilities", "n_wrong_sums",
                                 (F.col("right") > F.col("largest")).alias("beats_majority")))
    return reduce(DataFrame.unionByName, frames)
