"""Association rules and placement: hand cases and properties (FIXTURES §5, SURVEY §5)."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from aislekit.operators import placement as P
from aislekit.operators import rules as R
from aislekit.operators.baskets import choose_support, min_count_for


def _baskets(spark, rows):
    return spark.createDataFrame([(i, sorted(set(b))) for i, b in enumerate(rows)],
                                 "basket_id long, items array<string>")


def _brute_rules(baskets):
    n = len(baskets)
    sets = [frozenset(b) for b in baskets]
    universe = sorted(set().union(*sets))
    return n, sets, universe


def test_min_count_matches_float_test():
    for n in range(1, 400):
        for s in (0.1, 0.01, 2 / n, 1 / n):
            c = min_count_for(s, n)
            assert c / n >= s and (c == 1 or (c - 1) / n < s)


@pytest.mark.parametrize("top,expect", [(3, 0.1), (2, 2 / 30), (1, 1 / 30)])
def test_support_fallback_thresholds(top, expect):
    assert choose_support(30, top).min_support == pytest.approx(expect)


def test_example_rules(spark):
    rows = [["a", "b", "c"], ["a", "b", "c"], ["a"], ["b", "c"], ["d"]]
    a = R.analyze(_baskets(spark, rows), support=0.2)
    got = {(tuple(r["if_categories"]), tuple(r["then_categories"])): r for r in a.rules.collect()}
    r = got[(("a",), ("b", "c"))]
    assert r["support"] == pytest.approx(0.4)
    assert r["confidence"] == pytest.approx(2 / 3)
    assert r["lift"] == pytest.approx((2 / 3) / 0.6)
    # every split of every frequent itemset, checked by brute force
    n, sets, universe = _brute_rules(rows)
    expect = set()
    for k in range(2, len(universe) + 1):
        for combo in itertools.combinations(universe, k):
            if sum(1 for s in sets if set(combo) <= s) >= 1:
                for i in range(1, k):
                    for lhs in itertools.combinations(combo, i):
                        rhs = tuple(x for x in combo if x not in lhs)
                        expect.add((lhs, rhs))
    assert set(got) == expect


def test_mirrored_pair_keeps_higher_confidence(spark):
    rows = [["a", "c"], ["a", "c"], ["a"], ["c", "x"], ["a", "c"], ["b"]] * 3
    a = R.analyze(_baskets(spark, rows), support=0.1)
    kept = {(tuple(r["if_categories"]), tuple(r["then_categories"])) for r in a.positive.collect()}
    pairs = {frozenset([x, y]) for x, y in kept}
    assert len(pairs) == len(kept)                      # one per mirrored pair
    full = {(tuple(r["if_categories"]), tuple(r["then_categories"])): r["confidence"]
            for r in R.positive_filter(a.rules, a.n).collect()}
    for lhs, rhs in kept:
        mirror = full.get((rhs, lhs))
        assert mirror is None or full[(lhs, rhs)] >= mirror


def test_lift_positive_and_symmetric(spark):
    rows = [["a", "b"], ["a", "b"], ["a"], ["b", "c"], ["c"], ["a", "c"], ["b"]]
    a = R.analyze(_baskets(spark, rows), support=1 / 7)
    rules = {(tuple(r["if_categories"]), tuple(r["then_categories"])): r for r in a.rules.collect()}
    for (lhs, rhs), r in rules.items():
        assert rules[(rhs, lhs)]["lift"] == pytest.approx(r["lift"])
    for r in a.positive.collect():
        assert r["lift"] > 1 and r["support"] >= 1 / 7 - 1e-12


def test_empty_input_is_insufficient(spark):
    empty = spark.createDataFrame([], "basket_id long, items array<string>")
    a = R.analyze(empty)
    assert a.summary().first()["status"] == R.STATUS_INSUFFICIENT


def test_status_outcomes(spark):
    one = R.analyze(_baskets(spark, [["a", "b"]]))
    assert one.summary().first()["status"] == R.STATUS_INSUFFICIENT
    no_rules = R.analyze(_baskets(spark, [["a"], ["b"], ["c"]]), support=0.5)
    assert no_rules.summary().first()["status"] in (R.STATUS_NO_ITEMSETS, R.STATUS_NO_RULES)
    flat = R.analyze(_baskets(spark, [["a", "b"], ["a", "b"]]))
    assert flat.summary().first()["status"] == R.STATUS_NO_POSITIVE
    ok = R.analyze(_baskets(spark, [["a", "b"], ["a", "b"], ["c"], ["d"]]))
    s = ok.summary().first()
    assert s["status"] == R.STATUS_OK and s["total_positive_rules_found"] == 1


def _shelves(spark, pts):
    return spark.createDataFrame([(i, f"S{i}", float(x), float(y)) for i, (x, y) in enumerate(pts)],
                                 "pos long, name string, x double, y double")


def _scores(spark, vals):
    df = spark.createDataFrame([(f"c{i}", float(v)) for i, v in enumerate(vals)], "category string, score double")
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "category")))


def test_minimize_is_positional_r13(spark):
    sh = _shelves(spark, [(0, 0), (90, 0), (180, 40), (10, 200), (400, 300)])
    sc = _scores(spark, [5, 4, 3, 2, 1])
    a = {r["pos"]: (r["category"], r["rank"], r["grp"]) for r in P.place(sh, sc, "minimize").collect()}
    assert a == {0: ("c0", 1, "even"), 1: ("c1", 2, "odd"), 2: ("c2", 3, "even"),
                 3: ("c3", 4, "odd"), 4: ("c4", 5, "even")}
    lit = {r["pos"]: (r["category"], r["rank"]) for r in P.place_by_parity_groups(sh, sc).collect()}
    assert lit == {k: v[:2] for k, v in a.items()}


def test_maximize_nearest_centre_gets_best(spark):
    pts = [(0, 0), (100, 0), (50, 10), (0, 100), (100, 100)]
    sh = _shelves(spark, pts)
    sc = _scores(spark, [1, 9, 5])
    out = {r["shelf"]: (r["category"], r["rank"]) for r in P.place(sh, sc, "maximize").collect()}
    cx, cy = sum(p[0] for p in pts) / 5, sum(p[1] for p in pts) / 5
    order = sorted(range(5), key=lambda i: (math.dist(pts[i], (cx, cy)), i))
    assert out[f"S{order[0]}"] == ("c1", 1)
    assert out[f"S{order[1]}"] == ("c2", 2)
    assert len(out) == 3
    un = P.unassigned_shelves(sh, P.place(sh, sc, "maximize")).collect()
    assert {r["shelf"] for r in un} == {f"S{order[3]}", f"S{order[4]}"}


def test_scores_sum_lift_times_sides(spark):
    rows = [["a", "b"], ["a", "b"], ["a", "b", "c"], ["c"], ["c", "d"], ["d"]]
    a = R.analyze(_baskets(spark, rows), support=1 / 6)
    pos = a.positive.collect()
    total = sum(r["lift"] * (len(r["if_categories"]) + len(r["then_categories"])) for r in pos)
    got = P.category_scores(a.positive).agg(F.sum("score")).first()[0]
    assert got == pytest.approx(total)


def test_by_store_places_each_store_like_a_single_call(spark):
    from pyspark.sql import Window

    from aislekit.sources.shelves import shelves_from_json

    docs = spark.createDataFrame([
        ("s1", '[{"name":"A","x":0,"y":0},{"name":"B","x":100,"y":0},{"name":"C","x":40,"y":10}]'),
        ("s2", '[{"name":"A","x":0,"y":0},{"name":"B","x":5,"y":5}]')], "store string, cabinets string")
    shelves = shelves_from_json(docs, "cabinets", by=["store"])
    sc = spark.createDataFrame([("s1", "x", 3.0), ("s1", "y", 2.0), ("s2", "x", 1.0), ("s2", "z", 4.0)],
                               "store string, category string, score double")
    sc = sc.withColumn("rank", F.row_number().over(Window.partitionBy("store").orderBy(F.desc("score"), "category")))
    both = {(r["store"], r["shelf"]): r["category"] for r in P.place(shelves, sc, "maximize", by=["store"]).collect()}
    for store in ("s1", "s2"):
        one = P.place(shelves.where(F.col("store") == store).drop("store"),
                      sc.where(F.col("store") == store).drop("store"), "maximize").collect()
        assert {(store, r["shelf"]): r["category"] for r in one} == \
            {k: v for k, v in both.items() if k[0] == store}
    assert both[("s1", "C")] == "x"          # nearest the s1 centroid gets the best category
    mini = {(r["store"], r["pos"]): r["category"] for r in P.place(shelves, sc, "minimize", by=["store"]).collect()}
    assert mini == {("s1", 0): "x", ("s1", 1): "y", ("s2", 0): "z", ("s2", 1): "x"}


def test_verdict_and_fade_thresholds(spark):
    from aislekit.operators import insight as I

    # three pairs at distance 50, 150, 300 from shelf A; lifts 2.0 (strong) and 1.3 (weak)
    shelves = spark.createDataFrame([(0, "A", 0.0, 0.0), (1, "B", 50.0, 0.0), (2, "C", 150.0, 0.0),
                                     (3, "D", 300.0, 0.0), (4, "E", 0.0, 60.0)],
                                    "pos long, name string, x double, y double")
    assignment = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("E", "e")],
                                       "shelf string, category string")
    rel = spark.createDataFrame([("a", "b", 2.0, 0.5), ("a", "c", 2.0, 0.5), ("a", "d", 2.0, 0.5),
                                 ("a", "e", 1.3, 0.5), ("a", "z", 2.0, 0.5)],
                                "src string, dst string, lift double, confidence double")
    mx = {r["category_b"]: r["verdict"] for r in I.placement_verdict(rel, assignment, shelves, "maximize").collect()}
    assert mx == {"b": "good", "c": "neutral", "d": "bad", "e": "neutral", "z": None}
    mn = {r["category_b"]: r["verdict"] for r in I.placement_verdict(rel, assignment, shelves, "minimize").collect()}
    assert mn == {"b": "bad", "c": "neutral", "d": "good", "e": "neutral", "z": None}
    edges = {r["category_b"]: r for r in I.shelf_edges(rel, assignment, shelves, "minimize").collect()}
    assert edges["b"]["fade"] == pytest.approx(1.0) and edges["d"]["fade"] == pytest.approx(100 / 350)
    assert (edges["b"]["separation"], edges["c"]["separation"], edges["d"]["separation"]) == ("bad", None, "good")
    assert "z" not in edges                                   # unassigned category: no edge
    assert I.shelf_edges(rel, assignment, shelves, "maximize").where("fade IS NOT NULL").count() == 0


def test_masks_of_a_long_itemset_come_in_blocks(spark):
    items = [f"i{n:02d}" for n in range(32)]
    its = spark.createDataFrame([(items, 32, 5), (["a", "b"], 2, 7)], "items array<string>, k int, freq long")
    blocks = R.mask_blocks(its)
    got = blocks.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("high").alias("d"), F.max("high").alias("top")).collect()
    found = {r["k"]: (r["n"], r["d"], r["top"]) for r in got}
    high = 2 ** (32 - R.MASK_BITS)
    assert found == {2: (1, 1, 0), 32: (high, high, (high - 1) << R.MASK_BITS)}


def test_rule_splits_of_small_itemsets(spark):
    its = spark.createDataFrame([(["a", "b", "c"], 3, 5), (["a"], 1, 9)], "items array<string>, k int, freq long")
    got = {(tuple(r["if_categories"]), tuple(r["then_categories"])) for r in R.rule_splits(its).collect()}
    assert got == {(("a",), ("b", "c")), (("b",), ("a", "c")), (("c",), ("a", "b")), (("a", "b"), ("c",)),
                   (("a", "c"), ("b",)), (("b", "c"), ("a",))}
