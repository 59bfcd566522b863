"""S1 catalogue scan and S7/S8 artefact round trips."""

import os
import tempfile

from aislekit.operators import classify as C
from aislekit.plans import persist as PS
from aislekit.plans import training as T
from aislekit.sources.tables import read_catalogue

ROWS = [(i, t, c) for i, (t, c) in enumerate([("süt peynir yoğurt", "dairy"), ("ekmek simit", "bakery"),
                                              ("peynir süt", "dairy"), ("simit poğaça ekmek", "bakery"),
                                              ("elma armut", "fruit"), ("muz elma", "fruit")] * 4)]


def test_catalogue_csv_na_strings(spark):
    d = tempfile.mkdtemp(prefix="aislekit-cat-")
    path = os.path.join(d, "market_data.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("item_name,category_name,price\nSüt 1L,süt ürünleri,10\nN/A,ekmek,2\nSimit,NA,3\nÇay,,4\n")
    df = read_catalogue(spark, path, "item_name string, category_name string, price double")
    rows = df.orderBy("price").collect()
    # prices 2, 3, 4, 10: "N/A" item, "NA" category, empty category, then the full row
    assert rows[0]["item_name"] is None and rows[1]["category_name"] is None and rows[2]["category_name"] is None
    assert (rows[3]["item_name"], rows[3]["category_name"]) == ("Süt 1L", "süt ürünleri")
    assert df.dropna(subset=["item_name", "category_name"]).count() == 1


def test_prepared_and_models_round_trip(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    p = T.prepare(docs, "doc_id", "text", "lang")
    root = tempfile.mkdtemp(prefix="aislekit-art-")
    PS.save_prepared(p, os.path.join(root, "prep"))
    art = PS.load_artifacts(spark, os.path.join(root, "prep"))
    assert art["tfidf"].n_docs == p.tfidf.n_docs
    assert sorted(r["term"] for r in art["tfidf"].vocab.collect()) == sorted(r["term"] for r in p.tfidf.vocab.collect())
    n_test = PS.split_sets(art["sets"], "test").select("doc_id").distinct().count()
    assert n_test == p.split.where("split = 'test'").count()

    nb = T.train_naive_bayes(p)
    PS.save_naive_bayes(nb, os.path.join(root, "nb"))
    nb2 = PS.load_naive_bayes(spark, os.path.join(root, "nb"))
    test = p.rows("test")
    w = p.weights.join(test.select("doc_id"), "doc_id", "left_semi")
    a = {r["doc_id"]: r["predicted"] for r in C.argmax_class(C.naive_bayes_jll(nb, test, w)).collect()}
    b = {r["doc_id"]: r["predicted"] for r in C.argmax_class(C.naive_bayes_jll(nb2, test, w)).collect()}
    assert a == b

    dt = C.fit_decision_tree(p.coded.join(p.rows("train"), "doc_id"), p.tfidf, p.codes, max_depth=5)
    PS.save_ml_model(dt, os.path.join(root, "dt"))
    dt2 = PS.load_ml_model(spark, os.path.join(root, "dt"), art["tfidf"])
    pa = dt.predict(p.coded_of("test")).orderBy("doc_id", "code").collect()
    pb = dt2.predict(p.coded_of("test")).orderBy("doc_id", "code").collect()
    assert [(r["doc_id"], r["label"], round(r["proba"], 9)) for r in pa] == \
        [(r["doc_id"], r["label"], round(r["proba"], 9)) for r in pb]
    assert dt2.kind == "decision_tree"

    lr = C.fit_logistic_regression(p.coded.join(p.rows("train"), "doc_id"), p.tfidf, p.codes)
    PS.save_ml_model(lr, os.path.join(root, "lr"))
    lr2 = PS.load_ml_model(spark, os.path.join(root, "lr"), art["tfidf"])
    assert (lr2.theta == lr.theta).all() and lr2.kind == "logistic_regression"
    pa, pb = (sorted(m.predict(p.coded_of("test")).collect()) for m in (lr, lr2))
    assert pa == pb


def test_sets_meet_their_split_before_terms_are_rows(spark, monkeypatch):
    """A shuffle of documents, not of a row for each term."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    p = T.prepare(docs, "doc_id", "text", "lang")
    kept, whole = [], PS.TR.long_rows
    monkeypatch.setattr(PS.TR, "long_rows", lambda rows, vocab, *keep: kept.append(keep) or whole(rows, vocab, *keep))
    root = tempfile.mkdtemp(prefix="aislekit-sets-")
    PS.save_prepared(p, root)
    got = sorted(map(tuple, PS.load_artifacts(spark, root)["sets"].select("doc_id", "label", "split", "term", "idx", "tfidf").collect()))
    want = sorted(map(tuple, p.weights.join(p.split, "doc_id").select("doc_id", "label", "split", "term", "idx", "tfidf").collect()))
    assert kept[0] == ("label", "split") and got == want and got
