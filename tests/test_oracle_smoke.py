"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import hashlib
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
FAST = ["category_baskets", "frequent_itemsets", "support_fallback", "association_rules", "top_rules",
        "place_maximize", "place_minimize", "shelf_edges", "relation_matrix", "receipt_lines",
        "profile_numeric", "profile_categorical", "fold_ascii", "tfidf_terms", "stratified_split",
        "nb_predict", "classification_report", "roc_auc_ovr", "receipt_predictions", "rule_cards",
        "shelves_json", "tree_levels"]


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0) if not math.isnan(v) else "nan"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from aislekit.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["if_key", "then_key", "support", "confidence", "lift"]
    assert 0 < df.count() <= 10
    assert set(E.oracle_sql()) <= set(E.queries())
