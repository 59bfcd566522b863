"""Heavy hitters, coded documents and radix selection against plain counts and sorts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from aislekit.operators import classify as C
from aislekit.operators import features as FE
from aislekit.operators import heavy_hitters as H
from aislekit.operators import selection as S
from aislekit.operators import termrows as R
from aislekit.plans import training as T


def zipf_docs(spark, n=400, parts=7):
    rng = np.random.default_rng(2)
    rows = [(i, [f"w{k}" for k in rng.zipf(1.3, 30) if k < 5000]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(parts)


def grams(tokens):
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def test_summary_bounds_hold_through_merges():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(1, 12)
        parts, true = [], Counter()
        for _ in range(rng.randint(1, 6)):
            s = H.Summary(capacity)
            for _ in range(rng.randint(0, 40)):
                batch = Counter(f"v{int(rng.paretovariate(0.7)) % 60}" for _ in range(5))
                s.add(list(batch), list(batch.values()))
                true += batch
            s.prune()
            parts.append(s)
        whole = H.Summary(capacity)
        for s in parts:
            whole.merge(list(s.counts), list(s.counts.values()), s.err)
        whole.prune()
        assert len(whole.counts) <= capacity and whole.err * (capacity + 1) <= sum(true.values())
        assert all(whole.counts.get(v, 0) <= n <= whole.counts.get(v, 0) + whole.err for v, n in true.items())


@pytest.mark.parametrize("k,capacity", [(5, 5), (40, 40), (40, 5000), (10**6, 1)])
def test_candidates_hold_the_most_frequent(spark, k, capacity, monkeypatch):
    """Also where the first capacity's bound fails and the summary doubles, and where all tie."""
    rows, df = zipf_docs(spark)
    tried = []
    whole = H.summarise
    monkeypatch.setattr(H, "summarise", lambda r, v, c: tried.append(c) or whole(r, v, c))
    monkeypatch.setattr(H, "FAN_IN", 2)
    true = Counter(g for _, t in rows for g in grams(t))
    found = H.candidates(df, R.gram_values, k, capacity)
    kth = sorted(true.values(), reverse=True)[min(k, len(true)) - 1]
    must = {v for v, n in true.items() if n >= kth} if k < len(true) else set(true)
    assert must <= set(found) and found == sorted(found)
    if k == capacity:
        assert len(tried) > 1 and tried == [capacity * 2**i for i in range(len(tried))]


def test_vocabulary_with_ties_at_the_last_rank(spark):
    rows, df = zipf_docs(spark)
    total = Counter(g for _, t in rows for g in grams(t))
    docs = Counter(g for _, t in rows for g in set(grams(t)))
    for size in (7, 150, 10**6):
        model, coded = FE.fit_rows(df, size, "none", capacity=64)
        want = sorted(sorted(total, key=lambda g: (-total[g], g))[:size])
        got = model.vocab.orderBy("idx").collect()
        assert [r["term"] for r in got] == want and [r["idx"] for r in got] == list(range(len(want)))
        assert all(r["df"] == docs[r["term"]] and r["total"] == total[r["term"]] for r in got)
        place = {g: i for i, g in enumerate(want)}
        for r in coded.collect():
            c = Counter(place[g] for g in grams(rows[r["doc_id"]][1]) if g in place)
            assert dict(zip(r["idx"], r["tf"], strict=True)) == c and r["idx"] == sorted(c)
            assert not c or math.isclose(sum(w * w for w in r["w"]), 1.0)
    counted = sum(len(t) for _, t in rows)
    assert counted and model.n_docs == len(rows)


def test_fit_on_part_of_the_documents(spark):
    rows, df = zipf_docs(spark)
    ids = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id long")
    model, coded = FE.fit_rows(df, 50, "none", ids, capacity=64)
    total = Counter(g for i, t in rows if i % 3 == 0 for g in grams(t))
    assert [r["term"] for r in model.vocab.orderBy("idx").collect()] == sorted(sorted(total, key=lambda g: (-total[g], g))[:50])
    assert coded.count() == 400 and model.n_docs == 134


def test_rows_keep_odd_documents(spark):
    """Null, empty and unknown texts stay rows without terms; ids of any type and size come back."""
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "zzz"), (None, "elma armut elma"), ("d", "Elma, armut!")], "k string, t string")
    model = FE.fit_tfidf(spark.createDataFrame([(1, "elma armut elma armut"), (2, "elma kiraz")], "k long, t string"), "k", "t")
    got = {r["doc_id"]: (r["idx"], r["tf"]) for r in model.rows(docs, "k", "t").collect()}
    names = [t for t, _ in model.terms()]
    assert got["a"] == got["b"] == got["c"] == ([], [])
    assert {names[i]: n for i, n in zip(*got[None], strict=True)} == {"elma": 2, "armut": 1, "elma armut": 1, "armut elma": 1}
    assert {names[i]: n for i, n in zip(*got["d"], strict=True)} == {"elma": 1, "armut": 1, "elma armut": 1}
    wide = spark.createDataFrame([(2**53 + 1, "elma"), (None, "armut"), (2**53 + 3, None)], "k long, t string")
    assert {r["doc_id"] for r in model.rows(wide, "k", "t").coalesce(1).collect()} == {2**53 + 1, 2**53 + 3, None}
    assert model.rows(docs.limit(0), "k", "t").count() == 0
    assert FE.fit_tfidf(docs.limit(0), "k", "t").vocab.count() == 0


def test_long_terms_and_coded_rows_agree(spark):
    docs = spark.createDataFrame([(i, f"süt  Ekmek {i % 7} peynir, süt! x{i % 3}y ekmek") for i in range(40)] + [(99, "1 2 3"), (98, None)], "k long, t string")
    model = FE.fit_tfidf(docs, "k", "t")
    a = {(r["doc_id"], r["term"]): r["tf"] for r in FE.doc_terms(docs, "k", "t").collect()}
    b = {(r["doc_id"], r["term"]): r["tf"] for r in model.transform(docs, "k", "t").collect()}
    assert a == b and len(a) > 40


def test_text_is_normalised_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "k long, t string")
    for df in (FE.doc_terms(docs, "k", "t"), R.code_rows(R.token_rows(docs, "k", "t"), ["ab"])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_scores_in_the_row_and_in_the_join_agree(spark, monkeypatch):
    rows, df = zipf_docs(spark, 90)
    labels = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(80)], "doc_id long, label string")
    model, coded = FE.fit_rows(df, 60, "none")
    nb = C.fit_naive_bayes_rows(coded.join(labels, "doc_id"), FE.label_codes(labels, "label"), model.vocab)
    near = {r["doc_id"]: [(s["jll"], s["nc"], s["label"]) for s in r["scores"]] for r in C.score_rows(nb, coded, model.vocab).collect()}
    monkeypatch.setattr(C, "MAX_BROADCAST", 10)
    far = {r["doc_id"]: [(s["jll"], s["nc"], s["label"]) for s in r["scores"]] for r in C.score_rows(nb, coded, model.vocab).collect()}
    assert near.keys() == far.keys() == set(range(90))
    for k in near:
        for x, y in zip(near[k], far[k], strict=True):
            assert x[1:] == y[1:] and math.isclose(x[0], y[0], rel_tol=1e-9)


def test_image_keeps_the_order_of_doubles():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, 5e-324, -5e-324, np.inf, -np.inf, 1.0, -1.0]])
    assert (np.argsort(x, kind="stable") == np.argsort(S.image(x), kind="stable")).all()
    assert [S.value_of(int(k)) for k in S.image(x)] == x.tolist() and S.image(np.array([-0.0]))[0] == S.image(np.array([0.0]))[0]


def test_ranked_values_without_a_sort(spark):
    rng = np.random.default_rng(7)
    data = {"a": rng.normal(size=1000), "b": np.round(rng.normal(size=777), 1), "c": np.array([3.5]), "d": np.repeat([1e300, -1e-300], 50)}
    longest = max(map(len, data.values()))
    rows = [tuple(float(x[i]) if i < len(x) else (None, float("nan"))[i % 2] for x in data.values()) for i in range(longest)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    wanted = {c: sorted({0, len(x) // 3, len(x) // 2, len(x) - 1}) for c, x in data.items()}
    assert S.ranked_values(df, wanted) == {(c, r): float(np.sort(data[c])[r]) for c, ranks in wanted.items() for r in ranks}


@pytest.mark.parametrize("rounds", [S.ROUNDS, (6, 3, 3)])
def test_quota_thresholds(spark, rounds):
    """Also where many rows share a key: 12 bits for 3000 rows."""
    bits = sum(rounds)
    rng = random.Random(bits)
    rows = [(rng.choice("aabc"), rng.randrange(1 << bits)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "label string, k long")
    quotas = {"a": 700, "b": 1, "c": 0}
    got = {r["label"]: (r["threshold"], r["left"]) for r in S.quota_thresholds(
        df, spark.createDataFrame(list(quotas.items()), "label string, quota long"), "label", "k", rounds).collect()}
    for c, q in quotas.items():
        keys = sorted(k for x, k in rows if x == c)
        assert got.get(c) == ((keys[q - 1], q - sum(k < keys[q - 1] for k in keys)) if q else None)


def test_split_is_the_first_of_the_class_in_hash_order(spark):
    import hashlib

    rows = [(i, "abcd"[min(3, i % 7)]) for i in range(500)] + [(2**53 + 1, "a"), (2**53 + 3, "b")]
    got = {r["id"]: r["split"] for r in FE.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label").collect()}
    assert len(got) == len(rows) and sum(s == "test" for s in got.values()) == math.ceil(0.2 * len(rows))
    for c in "abcd":
        order = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, x in rows if x == c)
        kinds = [got[i] for _, i in order]
        assert kinds == sorted(kinds) and abs(kinds.count("test") - 0.2 * len(kinds)) <= 1
    plan = FE.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_letters_are_cut_as_the_training_normaliser_does(spark):
    texts = ["", "a", "ab", " Ab c DE", "İSTANBUL ıı ç çç aç ça x", "süt\npeynir9yoğurt_ekmek", "à la ß straße Ünlü", "ab\U0001F600cd é", "ÇĞİÖŞÜ çğıöşü",
             "ç", "z", "zz", None, "kk", "Å ãã şşı", "§Şşœ ıİ"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "k long, t string").coalesce(2)
    want = {r["doc_id"]: [w for w in r["tokens"] or []] for r in R.token_rows(docs, "k", "t").collect()}
    lower = R.letter_rows(docs, "k", "t").toArrow()
    for at, n in ((0, len(lower)), (5, 17), (40, 0)):  # slices have offsets
        part = lower.slice(at, n).combine_chunks()
        got = {i: [] for i in part["doc_id"].to_pylist()}
        for column in part["tokens"].chunks:
            doc, words = R._words(column)
            for d, w in zip(doc, words.to_pylist(), strict=True):
                got[part["doc_id"][int(d)].as_py()].append(w)
        assert got == {i: want[i] for i in got}
    assert "regexp" not in R.letter_rows(docs, "k", "t")._jdf.queryExecution().optimizedPlan().toString()


def test_preparation_reads_texts_without_regular_expressions(spark, monkeypatch):
    """The pattern took most of the time of long texts; words are numbered once, and grams are counted as numbers."""
    seen = []
    whole = H.summarise
    monkeypatch.setattr(H, "summarise", lambda r, *a: seen.append(r._jdf.queryExecution().optimizedPlan().toString()) or whole(r, *a))
    docs = spark.createDataFrame([(i, f"süt ekmek {'peynir ' * (i % 4)}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    p = T.prepare(docs, "doc_id", "text", "lang")
    assert p.tfidf.vocab.count() == 6 and seen and not any("regexp" in plan for plan in seen)


def test_number_summary_bounds_hold_through_merges():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(1, 12)
        whole, true = H.Numbers(capacity), Counter()
        for _ in range(rng.randint(1, 6)):
            s = H.Numbers(capacity)
            for _ in range(rng.randint(0, 40)):
                batch = Counter(int(rng.paretovariate(0.7)) % 60 for _ in range(5))
                s.add(list(batch), list(batch.values()))
                true += batch
            whole.merge(*s.items(), s.err)
        held = dict(zip(*whole.items(), strict=True))
        assert len(held) <= capacity and whole.err * (capacity + 1) <= sum(true.values())
        assert all(held.get(v, 0) <= n <= held.get(v, 0) + whole.err for v, n in true.items())


def test_grams_of_numbered_words():
    seqs = pa.array([[0, 1, -1, 1, 2], [], [2], [-1], [2, 2, 2]], pa.list_(pa.int32()))
    doc, gram = R._gram_numbers(seqs, 3)
    got = Counter(zip(doc.tolist(), (R.gram_name(int(g), ["a", "b", "c"]) for g in gram), strict=True))
    assert got == Counter([(0, "a"), (0, "b"), (0, "b"), (0, "c"), (0, "a b"), (0, "b c"), (2, "c"), (4, "c"), (4, "c"), (4, "c"), (4, "c c"), (4, "c c")])
