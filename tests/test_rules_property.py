"""Random baskets: the whole rule path against a brute-force enumeration in Python."""

import itertools
import random
from collections import Counter

import pytest

from aislekit.operators import baskets as B
from aislekit.operators import rules as R
from aislekit.operators.baskets import choose_support


def _brute(baskets, support):
    n = len(baskets)
    sets = [frozenset(b) for b in baskets]
    freq = Counter()
    for s in sets:
        for k in range(1, len(s) + 1):
            for combo in itertools.combinations(sorted(s), k):
                freq[combo] += 1
    c = choose_support(n, max((freq[(i,)] for i in {x for s in sets for x in s}), default=0), support).min_count
    its = {k: v for k, v in freq.items() if v >= c}
    rules = {}
    for items, f in its.items():
        for i in range(1, len(items)):
            for lhs in itertools.combinations(items, i):
                rhs = tuple(x for x in items if x not in lhs)
                fa, fb = its[lhs], its[rhs]
                rules[(lhs, rhs)] = (f / n, (f / n) / (fa / n), ((f / n) / (fa / n)) / (fb / n), f, fa, fb)
    positive = {k: v for k, v in rules.items() if v[3] * n > v[4] * v[5]}
    kept = set()
    for (lhs, rhs), v in positive.items():
        mirror = positive.get((rhs, lhs))
        if mirror is None or v[1] > mirror[1] or (v[1] == mirror[1] and "|".join(lhs) < "|".join(rhs)):
            kept.add((lhs, rhs))
    return its, rules, kept


@pytest.mark.parametrize("seed,support", [(1, 0.1), (2, 0.05), (3, None), (4, 0.2)])
def test_rules_match_brute_force(spark, seed, support):
    rnd = random.Random(seed)
    universe = list("abcdefg")
    baskets = [rnd.sample(universe, rnd.randint(1, 4)) for _ in range(rnd.randint(30, 60))]
    df = spark.createDataFrame([(i, sorted(b)) for i, b in enumerate(baskets)], "basket_id long, items array<string>")
    a = R.analyze(df, support=support)
    its, rules, kept = _brute(baskets, support)
    got_its = {tuple(r["items"]): r["freq"] for r in a.itemsets.collect()}
    assert got_its == its
    if a.rules is None:
        assert not rules
        return
    got = {(tuple(r["if_categories"]), tuple(r["then_categories"])): r for r in a.rules.collect()}
    assert set(got) == set(rules)
    for k, (s, conf, lift, *_) in rules.items():
        assert got[k]["support"] == pytest.approx(s) and got[k]["confidence"] == pytest.approx(conf)
        assert got[k]["lift"] == pytest.approx(lift)
    got_kept = {(tuple(r["if_categories"]), tuple(r["then_categories"])) for r in a.positive.collect()}
    assert got_kept == kept


def test_equal_baskets_are_mined_once(spark):
    baskets = [["a", "b", "c"]] * 300 + [["b", "c"]] * 50 + [["a", "z"], [], ["y"]]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>").repartition(4)
    patterns = B.basket_patterns(df)
    assert {tuple(r["items"]): r["w"] for r in patterns.collect()} == {("a", "b", "c"): 300, ("b", "c"): 50, ("a", "z"): 1, (): 1, ("y",): 1}
    for least in (1, 2, 301):
        got = R.frequent_itemsets(patterns, B.item_counts(patterns), least, len(baskets)).collect()
        want = {}
        for size in (1, 2, 3):
            for c in itertools.combinations("abcyz", size):
                n = sum(set(c) <= set(b) for b in baskets)
                if n >= least:
                    want[c] = n
        assert {tuple(r["items"]): r["freq"] for r in got} == want and len(got) == len(want)
    with pytest.raises(Exception, match="unique"):
        B.basket_patterns(spark.createDataFrame([(["a", "a"],)], "items array<string>")).collect()
