"""Closed itemsets, generators and the fallback's last threshold against enumerations in Python."""

import itertools
import random
from collections import Counter

import pytest

from aislekit.operators import closed as CL
from aislekit.operators import rules as R


def _frame(spark, baskets):
    return spark.createDataFrame([(list(b),) for b in baskets], "items array<string>")


def _counts(baskets):
    freq = Counter()
    for s in map(set, baskets):
        for k in range(1, len(s) + 1):
            freq.update(frozenset(c) for c in itertools.combinations(s, k))
    return freq


def _closed(freq, least):
    its = {s: f for s, f in freq.items() if f >= least}
    return {s: f for s, f in its.items() if not any(s < t and f == g for t, g in its.items())}


@pytest.mark.parametrize("seed,support", [(1, 0.02), (2, 0.1), (3, 0.0), (4, 0.3)])
def test_sets_generators_counts_and_rules(spark, seed, support):
    rnd = random.Random(seed)
    baskets = []
    for _ in range(50):
        b = rnd.sample("abcdefgh", rnd.randint(0, 5)) + ["root"]
        baskets.append(b + ["with_a"] * ("a" in b) + ["with_bc"] * ("b" in b or "c" in b))
    baskets += baskets[:5]
    c = CL.closed_itemsets(_frame(spark, baskets), support)
    freq, least, n = _counts(baskets), c.choice.min_count, len(baskets)
    expected = _closed(freq, least)
    rows = c.sets().collect()
    assert len(rows) == len(expected) and {frozenset(r["items"]): r["freq"] for r in rows} == expected
    assert all(list(r["items"]) == sorted(r["items"]) and r["k"] == len(r["items"]) for r in rows)

    # generators by first members, each member of a class written out
    member = {r["members"][0]: r["members"] for r in c.classes.collect()}
    got = {}
    for r in CL.generator_items(c).collect():
        for g in itertools.product(*(member[i] for i in r["items"])):
            got[frozenset(g)] = (frozenset(r["closure"]), r["freq"])
    below = lambda s: min([freq[s - {x}] if len(s) > 1 else n for x in s])
    rows = CL.generator_items(c, every_member=True).collect()
    assert len(rows) == len(got) and {frozenset(r["items"]): (frozenset(r["closure"]), r["freq"]) for r in rows} == got
    free = {s: f for s, f in freq.items() if f >= least and below(s) > f}
    assert set(got) == set(free)
    assert all(expected[shut] == f == free[g] and g <= shut for g, (shut, f) in got.items())

    asked = rnd.sample(sorted(map(sorted, freq)), 40) + [["nowhere"], ["a", "nowhere"]]
    counts = {frozenset(r["items"]): r["freq"] for r in CL.subset_counts(c, _frame(spark, asked)).collect()}
    assert counts == {frozenset(s): f if (f := freq[frozenset(s)]) >= least else 0 for s in asked}
    pairs = [(["a"], ["b"]), (["root", "c"], ["with_bc"]), (["a", "d"], ["h"])]
    frame = spark.createDataFrame(pairs, "if_categories array<string>, then_categories array<string>")
    rules = {(tuple(r["if_categories"]), tuple(r["then_categories"])): r for r in CL.rule_measures(c, frame).collect()}
    for a, b in pairs:
        both = freq[frozenset(a + b)]
        if both < least:
            assert (tuple(sorted(a)), tuple(sorted(b))) not in rules
            continue
        r = rules[(tuple(sorted(a)), tuple(sorted(b)))]
        assert r["confidence"] == pytest.approx(both / freq[frozenset(a)])
        assert r["lift"] == pytest.approx(both * n / freq[frozenset(a)] / freq[frozenset(b)])


def test_last_threshold_equals_the_listed_rules(spark):
    rnd, at, baskets = random.Random(5), itertools.count(), []
    for _ in range(14):
        baskets.append([f"i{next(at):03d}" for _ in range(rnd.randint(1, 6))])
    listed = R.analyze(_frame(spark, baskets))
    c = CL.closed_itemsets(_frame(spark, baskets))
    assert c.choice.min_support == pytest.approx(1 / 14) and c.choice.max_item_count == 1
    whole, summary = listed.summary().first(), CL.sparse_summary(c).first()
    for name in ("status", "total_transactions", "min_support_used", "total_positive_rules_found"):
        assert summary[name] == whole[name]
    assert (summary["n_closed"], summary["n_itemsets"]) == (14, listed.itemsets.count())
    scores = Counter()
    for r in listed.positive.collect():
        for i in [*r["if_categories"], *r["then_categories"]]:
            scores[i] += r["lift"]
    got = {r["category"]: r["score"] for r in CL.sparse_scores(c).collect()}
    assert got == pytest.approx(dict(scores))


def test_long_baskets_and_edges(spark):
    baskets = [[f"{b}-{i:02d}" for i in range(40)] for b in range(12)] + [[], [None, "x"], ["y", "y"]]
    c = CL.closed_itemsets(_frame(spark, baskets))
    assert sorted(r["k"] for r in c.sets().collect()) == [1, 1] + [40] * 12
    s = CL.sparse_summary(c).first()
    assert s["total_transactions"] == 15 and s["total_positive_rules_found"] == 12 * (3 ** 40 - 2 ** 41 + 1) // 2
    over = CL.sparse_summary(CL.closed_itemsets(_frame(spark, [[f"{b}-{i}" for i in range(90)] for b in range(11)]))).first()
    assert over["total_positive_rules_found"] is None and over["n_itemsets"] == 11 * (2 ** 90 - 1)
    for rows, status in (([], R.STATUS_INSUFFICIENT), ([["a"]], R.STATUS_INSUFFICIENT), ([[], []], R.STATUS_NO_ITEMSETS),
                         ([[c] for c in "abcdefghijkl"], R.STATUS_NO_RULES)):
        s = CL.sparse_summary(CL.closed_itemsets(_frame(spark, rows))).first()
        assert s["status"] == status and s["total_positive_rules_found"] == 0
    with pytest.raises(ValueError):
        CL.sparse_summary(CL.closed_itemsets(_frame(spark, [["a"], ["a"]])))


@pytest.mark.parametrize("seed,support", [(1, 0.0), (2, 0.06), (3, 0.1)])
def test_lone_classes_beside_shared_ones(spark, seed, support):
    rnd = random.Random(seed)
    baskets = [rnd.sample("abcde", rnd.randint(0, 4)) + [f"own{b}-{i}" for i in range(rnd.randint(0, 2))] for b in range(30)]
    baskets += baskets[:12] + baskets[:4]
    for rows in (baskets, [["x", "y"]] * 3, [b + ["root"] for b in baskets]):
        c = CL.closed_itemsets(_frame(spark, rows), support)
        got = c.sets().collect()
        expected = _closed(_counts(rows), c.choice.min_count)
        assert len(got) == len(expected) and {frozenset(r["items"]): r["freq"] for r in got} == expected
        assert sorted(r["k"] for r in c.lengths().collect()) == sorted(map(len, expected))


def test_baskets_of_lone_classes_need_no_rounds(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(CL, "cut_lineage", lambda df, keep=CL.cut_lineage: kept.append(1) or keep(df))
    c = CL.closed_itemsets(_frame(spark, [[f"{b}-{i}" for i in range(3)] for b in range(20)]))
    assert c.coded.count() == 20 and len(kept) == 4  # baskets, classes, their numbers, coded baskets
