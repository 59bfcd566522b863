"""The basket report and the shelf placement on order receipts, where both find rules."""

import json

import pytest
from pyspark.sql import functions as F

from aislekit.operators import placement as P
from aislekit.plans import flows as FL
from aislekit.plans import q_flows as Q
from aislekit.plans import q_placement as QP
from aislekit.operators import insight as I
from aislekit.sources.receipts import receipts_from_texts
from aislekit.sources.shelves import shelf_grid
from aislekit.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shelves(spark):
    return shelf_grid(table(spark, SF, "nation").select((F.col("n_nationkey") + 1).alias("k")), "k")


def test_report_finds_rules(spark):
    report = Q._order_report(spark, SF)
    row = report.summary().first()
    assert row["status"] == "ok" and row["total_positive_rules_found"] > 0
    assert 0 < report.top_rules().count() <= 10
    assert report.analysis.itemsets.agg(F.max("k")).first()[0] <= 6


@pytest.mark.parametrize("goal", P.GOALS)
def test_placement_assigns_shelves(spark, shelves, goal):
    plan = FL.shelf_optimization(Q._order_receipts(spark, SF), shelves, Q._part_prepared(spark, SF), goal, support=0.01)
    assigned = plan.assignment.collect()
    assert plan.status == "ok" and assigned
    assert len({r["shelf"] for r in assigned}) == len({r["category"] for r in assigned}) == len(assigned)
    assert plan.unassigned.count() + len(assigned) == shelves.count()


def test_flows_reject_bad_input(spark, shelves):
    prepared = Q._part_prepared(spark, SF)
    blank = receipts_from_texts(spark.createDataFrame([(1, "\n \n")], "n long, t string"), "t", ["n"])
    with pytest.raises(ValueError):
        FL.basket_report(blank, prepared)
    twice = shelves.unionByName(shelves.limit(1))
    with pytest.raises(ValueError):
        FL.shelf_optimization(Q._order_receipts(spark, SF), twice, prepared, "maximize")


def test_results_have_errors_and_order(spark):
    rows = [(1, "Siparis_01", 0, "a", "x"), (1, "Siparis_01", 1, "b", None), (10, "Siparis_10", 0, "c", None), (2, "Siparis_02", 0, "d", "y")]
    pred = spark.createDataFrame(rows, "receipt_no long, receipt_id string, pos int, product string, category string")
    got = {r["rank"]: json.loads(r["json"]) for r in FL.receipt_results(pred).collect()}
    assert got[1] == {"receipt_id": "Siparis_01", "items": [{"product": "a", "category": "x"}, {"product": "b"}]}
    assert got[2]["receipt_id"] == "Siparis_02" and got[3]["receipt_id"] == "Siparis_10" and "error" in got[3]


def test_recommendations_of_equal_names_stay_apart(spark):
    shelves = spark.createDataFrame([(0, "A", 0.0, 0.0), (1, "A", 5.0, 0.0), (2, "B", 9.0, 9.0)], "pos long, name string, x double, y double")
    scores = spark.createDataFrame([("c1", 3.0, 1), ("c2", 2.0, 2)], "category string, score double, rank int")
    placed = P.place(shelves, scores, "minimize")
    assert P.recommendations_in_shelf_order(shelves, placed).count() == 2
    assert [r["pos"] for r in P.unassigned_shelves(shelves, placed).collect()] == [2]


def test_second_limits_reach_every_branch(spark):
    sf = "/root/testdata/sf0.01"
    edges = QP.q_shelf_edges_tight(spark, sf).toPandas()
    assert set(edges.tier) == {name for _, name in QP.TIGHT.lift_tiers} | {QP.TIGHT.tier_default}
    assert {"good", "bad"} <= set(edges.separation.dropna())
    assert {"good", "bad", "neutral"} <= set(QP.q_placement_verdict_tight(spark, sf).toPandas().verdict.dropna())
    tiers = spark.createDataFrame([(0.1,), (0.5,), (0.8,)], "c double").select(I.confidence_tier(F.col("c"))).collect()
    assert [r[0] for r in tiers] == ["low", "medium", "high"]


def test_orders_without_positive_rules_give_no_assignment(spark, monkeypatch):
    """Support 1: no itemset is frequent, so no shelf gets a category; the queries return no row instead of failing."""
    monkeypatch.setattr(Q, "PART_SUPPORT", 1.0)
    for query in (Q.q_shelf_optimization_together, Q.q_shelf_optimization_apart):
        out = query(spark, SF)
        assert out.columns == ["pos", "shelf", "category", "score"] and out.count() == 0


def test_receipts_are_gathered_and_numbered_once(spark):
    from aislekit.plans import q_flows

    for receipts in (q_flows._order_receipts(spark, "/root/testdata/sf0.001"), q_flows._receipts(spark, "/root/testdata/sf0.001")):
        plan = receipts._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "FileScan" not in plan  # read from where they are kept
        assert receipts.count() == receipts.select("receipt_no").distinct().count() > 0
