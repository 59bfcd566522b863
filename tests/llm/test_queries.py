"""Every query without SQL against a brute-force version on whole small tables; edge cases for every operator."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislekit.llm import common, fingerprints, idfile, mixing, ngram_join, packing, pii, quality_rules, substring_dedup, wordpiece
from aislekit.llm import quality_classifier as qc
from aislekit.llm.queries import QUERIES, SQL
from aislekit.llm.words import shingle_set

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)


def ids_of(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids + [2], "<u4") for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def smallest_reachable(sets, ids):
    """Components of all links, by counting every list."""
    root, lists = list(range(len(ids))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for k in s.tolist() for j in lists[k])
        for k in s.tolist():
            lists[k].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def cut_brute(texts, length=50):
    """(n_bytes, n_removed, n_spans, sha of the rest) in the given order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        strings = [raw[j:j + length] for j in range(len(raw) - length + 1)]
        gone = [False] * len(raw)
        for j, s in enumerate(strings):
            if s in seen:
                gone[j:j + length] = [True] * length
        seen.update(strings)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_op1(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints.key_bounds, "__defaults__", (100_000,))  # several ranges
    got = QUERIES["op1_fingerprints"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    minhash, texts = fingerprints.MinHash(), list(docs.text)
    own = [minhash.short(fingerprints.fingerprint(t, minhash)) for t in texts]
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        changed = minhash.short(fingerprints.fingerprint(edited, minhash))
        row = got.loc[i]
        assert (row.doc_id, row.n_chars) == (docs.doc_id[i], len(text))
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == own[i].astype(">u2").tobytes().hex()
        assert row.edited_fingerprint == changed.astype(">u2").tobytes().hex()
        assert row.near_edited == np.mean(own[i] == changed) and row.near_next == np.mean(own[i] == own[(i + 1) % len(texts)])


def test_near_duplicates_of_bands(spark, docs):
    found = fingerprints.near_duplicates(common.documents(spark, SF)).toPandas()
    sets = {d: shingle_set(t.encode()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    for r in found.itertuples():
        n = len(np.intersect1d(sets[r.doc_id], sets[r.other_id]))
        assert r.similarity == pytest.approx(n / (len(sets[r.doc_id]) + len(sets[r.other_id]) - n)) and r.similarity >= 0.8
    components = smallest_reachable(list(sets.values()), list(sets))
    in_groups = {d for d, c in zip(sets, components, strict=True) if Counter(components)[c] > 1}
    assert in_groups == set(found.doc_id) | set(found.other_id)


def test_near_duplicates_inside_a_template(spark):
    """Texts of ten paragraphs, each sibling with two others: whatever four paragraphs a band comes from, some sibling
    with a smaller doc_id has them, and is like neither of the planted copies."""
    def paragraph(name):
        return [f"{name}w{i}" for i in range(30)]

    texts = []
    for family in range(3):
        base = [paragraph(f"f{family}p{i}") for i in range(10)]
        texts += [sum((paragraph(f"f{family}s{i}x{j}x{k}") if k in (i, j) else base[k] for k in range(10)), [])
                  for i in range(10) for j in range(i)]
        whole = sum(base, [])
        copies = [list(whole) for _ in range(4)]
        for at, copy in zip((100, 150, 250), copies[1:], strict=True):
            copy[at] = f"f{family}c{at}"
        texts += [*copies, list(copies[1])]
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t.encode()) for t in texts]
    found = fingerprints.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    for r in found.itertuples():
        n = len(np.intersect1d(sets[r.doc_id], sets[r.other_id]))
        assert r.similarity == pytest.approx(n / (len(sets[r.doc_id]) + len(sets[r.other_id]) - n)) and r.similarity >= 0.8
    root = list(range(len(texts)))
    for _ in root:
        for r in found.itertuples():
            root[r.doc_id] = root[r.other_id] = min(root[r.doc_id], root[r.other_id])
    want = smallest_reachable(sets, list(range(len(texts))))
    assert sorted(Counter(want).values())[-3:] == [5, 5, 5] and root == want


def test_candidates_miss_no_similar_pair(spark):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(60, int(rng.integers(1, 40)))) for _ in range(60)]
    for s in sets[:40]:
        sets.append(np.unique(np.where(rng.random(len(s)) < 0.12, rng.integers(60, 90, len(s)), s)))
    rows = [(i, i % 70, len(s), bytearray(s.astype(np.int64).tobytes())) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "doc_id long, component long, n long, shingles binary")
    found = {(r.doc_id, r.other_id) for r in fingerprints._candidates(table, fingerprints.MinHashPlan()).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i)
            if i % 70 != j % 70 and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)}
    assert len(want) > 10 and want <= found


def test_op2(spark, docs):
    got = QUERIES["op2_packing"](spark, SF).toPandas()
    ids = dict(zip(docs.doc_id, ids_of("word_bpe_49k.json", docs.text), strict=True))
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in ids.items()}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 4096
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.9


def test_op3_reaches_its_budget(spark):
    got = QUERIES["op3_mixing"](spark, SF).toPandas()
    tokens = mixing.with_tokens(common.documents(spark, SF)).agg(F.sum("n_tokens")).first()[0]
    assert 0 <= int(tokens * mixing.PLAN.share) - got.take_tokens.sum() < 200  # shares are rounded down
    web = got[got.domain == "web"].take_tokens.sum() / got.take_tokens.sum()
    assert abs(web - 3 / 8) < 0.01


def waterfill(cap, weight, budget):
    """Shares by raising one level until the budget is used."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, w * mid) for c, w in zip(cap, weight)) < budget else (low, mid)
    return [min(c, w * high) for c, w in zip(cap, weight)]


def test_mixing_redistributes_among_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "y", "2", 1000), ("b", "x", "3", 1000), ("b", "z", "4", 50), ("c", "x", "5", 20)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    plan = mixing.MixingPlan(weights={"a": 2, "a/x": 3, "b": 1, "c": 4, "b/z": 0}, share=0.25, max_epochs=2)
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, plan).collect()}
    a, b, c = waterfill([2020, 2100, 40], [2, 1, 4], 520)
    ax, ay = waterfill([20, 2000], [3, 1], a)
    expected = {"1": ax, "2": ay, "3": min(b, 2000), "4": 0, "5": c}
    assert all(abs(got[k] - v) <= 3 for k, v in expected.items()), (got, expected)


def test_op4(spark, docs):
    got = QUERIES["op4_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        words = re.findall(WORD, text)
        windows = list(zip(words, words[1:], words[2:]))
        often = Counter(windows)
        twice = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        row = got.loc[d]
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == expected
        assert row.base_failed == (len(words) < 50 or 100 * len(twice) > 50 * len(words))
        assert not (row.base_failed and row.kept)


def test_decision_list_learns_planted_rules(spark):
    rows, labels = [], []
    for i in range(3000):
        junk, loud = i % 10 == 0, i % 10 == 1 and i % 3 == 0
        rows.append((i, 100, 900 if loud else 500 + i % 7, 80 + i % 5 if junk else i % 3, 0, i % 11))
        labels.append((i, 0 if junk or loud else 1))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.learn(stats, known)
    judged = stats.withColumns({f"f_{n}": c for n, c in quality_rules.feature_columns().items()}).withColumn("rule", quality_rules.verdict(rules))
    wrong = judged.join(known, "doc_id").where(F.col("rule").isNull() != (F.col("quality") == 1)).count()
    assert 1 <= len(rules) <= 4 and wrong == 0
    assert quality_rules.learn(stats, known.where("doc_id < 0")) == []


def test_op5(spark, docs):
    got = QUERIES["op5_wordpiece_counts"](spark, SF).toPandas().set_index("doc_id")
    pieces = set(wordpiece.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))) | {(wordpiece.END,)}
    seen = {}

    def greedy(word):
        if word not in seen:
            s, n, i = (*word, wordpiece.END), 0, 0
            while i < len(s):
                j = len(s)
                while s[i:j] not in pieces:
                    j -= 1
                n, i = n + (s[i] != wordpiece.END), j
            seen[word] = n
        return seen[word]

    for d, text in zip(docs.doc_id, docs.text, strict=True):
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]  # bytes: A-Z only
        assert tuple(got.loc[d]) == (len(words), sum(map(greedy, words)))


def test_op6(spark, docs):
    plan = substring_dedup.DedupPlan(shard_bytes=100_000, part_bytes=60_000)
    got = substring_dedup.dedup(common.documents(spark, SF), plan).toPandas().sort_values("doc_id")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert list(got[columns].itertuples(index=False, name=None)) == cut_brute(docs.text)


def test_op6_common_passage_with_own_contexts(spark, monkeypatch):
    """The first and last minimiser of a passage have a run for each document; none goes to one task."""
    rng = np.random.default_rng(16)

    def own(n):
        return "".join(rng.choice(list("abcdefgh "), n))

    passage, again = own(90), own(60)
    texts = [own(60) + passage + own(60) + (again if i % 3 else "") + own(40) for i in range(300)] + [passage, own(30) + passage[:70], own(200)]
    merge = substring_dedup._smallest_owners

    def watched(strings, key, *rest):
        totals = Counter()
        for s, k in zip(strings, key.tolist(), strict=True):
            totals[k] += len(s)
        if totals:
            assert max(totals.values()) <= 2000, "a minimiser's runs in one task"
        return merge(strings, key, *rest)

    watched.__module__ = "__main__"  # goes to the workers whole
    monkeypatch.setattr(substring_dedup, "_smallest_owners", watched)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plan = substring_dedup.DedupPlan(key_bytes=2000, part_bytes=4000)
    got = substring_dedup.dedup(table, plan).toPandas().sort_values("doc_id")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert list(got[columns].itertuples(index=False, name=None)) == cut_brute(texts)
    # and what is split is what a merge finds
    runs = spark.createDataFrame([(i % 4, bytearray(t[40:130].encode()), i, 1 + i % 2) for i, t in enumerate(texts[:300])],
                                 "key long, string binary, least long, rows long").withColumn("sid", F.xxhash64("string")).cache()
    split = {tuple(r) for r in substring_dedup.split_owners(runs, plan).collect()}
    held = runs.toPandas()
    i, first, end, least = merge([bytes(x) for x in held.string], np.zeros(len(held), np.int64), held.least.to_numpy(), held.rows.to_numpy(), plan)
    assert split == set(zip(held.key[i].tolist(), held.sid[i].tolist(), first.tolist(), end.tolist(), least.tolist(), strict=True))


def test_op7(spark, docs, monkeypatch):
    monkeypatch.setattr(idfile.key_bounds, "__defaults__", (100_000,))
    monkeypatch.setattr(idfile, "BLOCK_IDS", 5000)
    got = QUERIES["op7_token_ids"](spark, SF).toPandas().sort_values("doc_id")
    ids = ids_of("byte_bpe_50k.json", docs.text)
    n = np.array([len(x) for x in ids])
    assert list(got.n_tokens) == list(n) and list(got.start) == list(np.cumsum(n) - n)
    assert list(got.ids_crc32) == [zlib.crc32(x.tobytes()) for x in ids]


def test_op8(spark, docs):
    plan = ngram_join.JoinPlan(shard_bytes=100_000, batch_shingles=5000, block=10)
    got = ngram_join.join(common.documents(spark, SF), plan).toPandas().sort_values("doc_id")
    sets = [shingle_set(t.encode()) for t in docs.text]
    assert list(got.n_shingles) == [len(s) for s in sets]
    assert list(got.component_id) == smallest_reachable(sets, list(docs.doc_id))


def test_op8_chains_and_large_groups(spark):
    """Near-copies that only reach each other through others, exact copies, and one long shared passage."""
    rng, rows = np.random.default_rng(13), []
    passage = [f"p{i}" for i in range(60)]
    for family in range(8):
        words = [f"f{family}w{i}" for i in range(int(rng.integers(20, 200)))] + (passage if family % 2 else [])
        for _ in range(12):
            words = list(words)
            words[int(rng.integers(len(words)))] = f"x{len(rows)}"  # drifts away step by step
            rows.append((int(len(rows) * 7919 % 1009), " ".join(words)))
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(3000 + i, " ".join(passage) + f" end{i}") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plan = ngram_join.JoinPlan(shard_bytes=4000, batch_shingles=500, block=7)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(table, plan).collect()}
    rows.sort()
    expected = smallest_reachable([shingle_set(t.encode()) for _, t in rows], [d for d, _ in rows])
    assert [got[d] for d, _ in rows] == expected


@pytest.mark.parametrize("block", [1, 40])
def test_op8_template_families(spark, block):
    """Texts of one template on both sides of the bound, of several lengths: met by buckets of prefixes, and without."""
    rng, rows = np.random.default_rng(5), []
    for family, size in enumerate((30, 33, 41, 60, 90)):
        template = [f"t{family}w{i}" for i in range(size)]
        for _ in range(30):
            words = list(template)
            for at in rng.choice(size, int(rng.integers(0, 3)), replace=False):
                words[at] = f"v{family}x{rng.integers(4)}"
            rows.append((len(rows) * 31 % 151, " ".join(words[:size - int(rng.integers(0, 8))])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plan = ngram_join.JoinPlan(shard_bytes=3000, batch_shingles=300, block=block)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(table, plan).collect()}
    rows.sort()
    assert [got[d] for d, _ in rows] == smallest_reachable([shingle_set(t.encode()) for _, t in rows], [d for d, _ in rows])


def test_op8_exact_search_alone(spark):
    """Every set a component of its own, all shingles crossing: prefixes and size classes lose no link."""
    rng = np.random.default_rng(6)
    pool = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
    sets = [np.sort(rng.choice(pool[k * 20:k * 20 + 20 + k], int(rng.integers(1, 20)), replace=False)) for k in rng.integers(0, 3, 150)]
    order = {x: i for i, x in enumerate(pool.tolist())}
    rows = []
    for i, s in enumerate(sets):
        keep = len(s) - int(ngram_join.needed(len(s), 80)) + 1
        rows.append((i, i, len(s), bytearray(s.tobytes()), sorted(s.view(np.int64).tolist(), key=lambda x: order[x % (1 << 64)])[:keep]))
    table = spark.createDataFrame(rows, "doc_id long, component long, n long, shingles binary, prefix array<long>")
    expected = smallest_reachable(sets, list(range(len(sets))))
    for block in (1, 20, 1000):
        links = ngram_join._exact_links(table, ngram_join.JoinPlan(block=block))
        groups = {r["node"]: r["component"] for r in ngram_join.components(links, "u", "v").collect()}
        assert [groups.get(i, i) for i in range(len(sets))] == expected, block


def test_op8_size_classes():
    for percent in (50, 80, 95, 100):
        starts = ngram_join.size_classes(percent, 500)
        of = np.searchsorted(starts, np.arange(501), side="right")
        for n in range(1, 501):
            assert of[min(500, n * 100 // percent)] - of[n] <= 1


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_classifier"](spark, sf).toPandas().merge(common.labels(spark, sf).toPandas(), on="doc_id")
    held = got[got.held_out]
    assert set(got.predicted) <= {0, 1} and ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert list(got.held_out) == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]
    assert (held.predicted == held.quality).mean() > 0.95


def test_op10(spark, docs):
    got = QUERIES["op10_pii"](spark, SF).toPandas().set_index("doc_id")
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        base = pii.base_spans(text)
        row = got.loc[d]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        written = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(row.spans.split(",")) | {""}


def test_pii_model_adds_look_alikes(spark):
    rng, rows = np.random.default_rng(14), []
    for i in range(600):
        digits = "".join(map(str, rng.integers(0, 10, 16)))
        rows.append(f"call +1 ({i % 900 + 100}) 555-{i % 9000 + 1000} now" if i % 2 else f"number {digits} here")
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(9999, "call 1 (217) 555-7713 now")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark, table, pii.train(table)).collect()}
    assert got[9999] == "phone:5:21" and got[1].startswith("phone:5:")


def test_pii_trees_learn_from_every_candidate(spark):
    rows = [f"dial +1 (217) {200 + i // 10} {i % 10}713 now" if i % 8 else f"built {1900 + i % 200}-04-{10 + i // 200} 10 times"
            for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    counts = {r["label"]: r["n"] for r in pii.training_rows(docs).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    assert counts[pii.BASE] == 3500 and counts[pii.REFUTED] == 500 and counts[pii.VARIANT] > 3000  # more than 3000 of a kind and label
    # passes over several tasks add up to what one block gives
    kept = pii.kept_rows(docs)
    blocks = list(pii._unpacked(pa.RecordBatch.from_pylist([r.asDict()]) for r in kept.blocks.collect()))
    kept.blocks = kept.blocks.union(kept.blocks).repartition(4)
    twice = pii.Local(pii.Block(*(np.concatenate([c, c]) for c in map(np.concatenate, zip(*blocks)))))
    plan = pii.BoostingPlan(trees=3)
    model, same = pii.boost(kept, plan), pii.boost(twice, plan)
    assert model.start == same.start and model.thresholds == same.thresholds and model.thresholds
    for one, other in zip(model.trees, same.trees, strict=True):
        assert (one.feature == other.feature).all() and (one.limit == other.limit).all() and (one.value == other.value).all()
    p = same.probability(twice.block.x)
    for kind, limit in pii.lowest_positives(kept, model, 0.05).items():
        each = [np.sort(np.repeat(p[m], twice.block.n[m])) for m in (twice.block.held & (twice.block.label == y) & (twice.block.x[:, 0] == kind)
                                                                     for y in (pii.BASE, pii.VARIANT)) if m.any()]
        assert abs(limit - min(0.5, *(v[int(0.05 * (len(v) - 1))] for v in each))) < 1e-12


def test_pii_look_alikes_as_frequent_as_base_spans(spark):
    rng, rows = np.random.default_rng(15), []
    for i in range(1500):
        d = rng.integers(0, 10, 16)
        name, host = f"user{i}", f"host{i % 40}.example.org"
        rows.append((
            f"call {'+' * (i // 6 % 2)}1 ({i % 900 + 100}) 555-{i % 9000 + 1000} now",
            f"write to {name}@{host} soon" if i // 6 % 2 else f"write to {name} [at] {host.replace('.', ' [dot] ')} soon",
            f"number {''.join(map(str, d))} here", f"built 20{d[0]}{d[1]}-0{d[2] % 9 + 1}-1{d[3]} 10 times",
            f"meet {name} [at] noon today", f"range {d[0]}{d[1]}00/{d[2]}{d[3]}/{d[4]}{d[5]}00 of sizes")[i % 6])
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark, table, pii.train(table)).collect()}
    alike = [i for i, t in enumerate(rows) if t.startswith("call 1") or "[dot]" in t]
    other = [i for i, t in enumerate(rows) if t.startswith(("built", "meet", "range"))]
    assert len(alike) > 200 and len(other) > 200
    assert np.mean([got[i] != "" for i in alike]) > 0.95 and not any(got[i] for i in other)


# -- edge cases ------------------------------------------------------------------------------------

LONG = "lorem ipsum dolor " * 12_000
EDGE = [(0, "", "en", "src1"), (1, None, None, None), (2, "word", "en", "src1"), (3, LONG, "de", None), (4, LONG, "de", "src0"),
        (5, "a b c d e f", "en", "src2"), (5, "a b c d e f", "en", "src2"), (5, "other text of the same id", "en", "src2"),
        (None, "no id here", "en", "src1"), (None, None, None, None), (7, " \n\t\n ", "fr", "src9"), (8, "x\n\nx\n y  z \n", "fr", "src9")]
CLASHES = ["score", "held_out", "rule", "epoch", "take_tokens", "n_tokens", "component_id", "k", "owner", "w", "h", "kind", "start", "bucket"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit("extra") for c in CLASHES} | {"n_chars": F.lit(None).cast("long")})


def word_plan():
    return packing.PackingPlan(public_tokenizers.path("word_bpe_49k.json"))


def no_labels(spark):
    return spark.createDataFrame([(None, 1, 0), (2, None, None), (5, 7, 0)], "doc_id long, quality int, toxic int")


def all_operators(spark, df, tmp):
    labels = no_labels(spark)
    tokens = public_tokenizers.path("byte_bpe_50k.json")
    idfile.write_ids(df, tmp, tokens)
    return {
        "fingerprints": fingerprints.edited_pairs(df), "near": fingerprints.near_duplicates(df), "pack": packing.pack(df, word_plan()),
        "mix": mixing.mix(mixing.with_tokens(df.withColumn("domain", F.lit("d")))), "rules": quality_rules.judge(df, labels),
        "pieces": wordpiece.token_counts(df, public_tokenizers.path("word_bpe_49k.json")), "cut": substring_dedup.dedup(df),
        "ids": idfile.read_ids(spark, tmp), "join": ngram_join.join(df), "quality": qc.classify(spark, df, labels),
        "pii": pii.find(spark, df, pii.train(df)), "redact": pii.redact(spark, df, pii.train(df))}


def test_edge_cases(spark, edge, tmp_path):
    got = {n: df.toPandas() for n, df in all_operators(spark, edge, str(tmp_path / "ids")).items()}
    for name in ("fingerprints", "rules", "pieces", "cut", "ids", "join", "quality", "pii", "redact"):
        assert len(got[name]) == len(EDGE), name

    def row(name, doc_id):
        f = got[name]
        return f[f.doc_id == doc_id].iloc[0]

    assert row("fingerprints", 3).fingerprint == row("fingerprints", 4).fingerprint and row("fingerprints", 1).n_chars == 0
    assert set(got["near"][["doc_id", "other_id"]].itertuples(index=False, name=None)) == {(4, 3)}
    assert row("pack", 1).doc_tokens == 1 and row("pack", 3).doc_tokens == row("pack", 4).doc_tokens > 4096
    assert got["pack"].groupby("sequence_id").length.sum().max() <= 4096
    assert (got["mix"].take_tokens <= got["mix"].n_tokens).all() and (got["mix"].epoch != "extra").all()
    assert row("rules", 1).n_words == 0 and row("rules", 1).base_failed and row("rules", 8).n_dup_lines == 1
    assert pd.isna(got["rules"].rule).all()
    assert row("pieces", 7).n_pieces == 0 and row("pieces", 2).n_pieces > 0
    cut = cut_brute([LONG])[0]
    assert tuple(row("cut", 3))[1:] == cut and row("cut", 4).n_removed == len(LONG) and row("cut", 4).n_spans == 1
    assert got["cut"][got["cut"].doc_id == 5].n_removed.sum() == 0
    ids = got["ids"].sort_values("start")
    assert list(ids.start) == list(ids.n_tokens.cumsum() - ids.n_tokens) and ids.doc_id.isna().tolist()[-2:] == [True, True]
    assert ids.doc_id.dropna().is_monotonic_increasing
    assert row("join", 4).component_id == 3 and row("join", 0).component_id == 0 and row("join", 5).component_id == 5
    assert got["join"][got["join"].doc_id.isna()].component_id.isna().all()
    assert (got["quality"].score == 0.5).all() and (got["quality"].predicted == 1).all()
    assert (got["pii"].spans == "").all() and pd.isna(row("redact", 1).text) and row("redact", 4).text == LONG


def test_empty_tables(spark, edge, tmp_path):
    for name, df in all_operators(spark, edge.where("doc_id > 100"), str(tmp_path / "none")).items():
        assert df.count() == 0, name


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


def test_pipeline_stages(spark):
    """Each stage against a plain version of its decision, on its own input."""
    import corpus_pipeline as pipeline

    docs = common.documents(spark, SF).cache()
    columns = docs.columns
    table = docs.toPandas()
    kept = dict(pipeline.STAGES)["quality"](spark, docs, SF)
    assert kept.columns == columns
    scored = qc.classify(spark, docs, common.labels(spark, SF)).toPandas()
    assert set(kept.toPandas().doc_id) == set(scored[scored.predicted == 1].doc_id)
    single = dict(pipeline.STAGES)["near_copies"](spark, docs, SF)
    components = smallest_reachable([shingle_set(t.encode()) for t in table.text], list(table.doc_id))
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(set(components))
    clean = dict(pipeline.STAGES)["personal"](spark, docs, SF).toPandas().set_index("doc_id")
    for d, text in zip(table.doc_id, table.text, strict=True):
        assert not pii.base_spans(clean.text[d]) or pii.base_spans(text)
        assert clean.n_chars[d] == len(clean.text[d]) and (pii.base_spans(text) or clean.text[d] == text)
    mixed = dict(pipeline.STAGES)["mixture"](spark, docs, SF)
    assert mixed.columns == columns
    tokens = dict(zip(table.doc_id, table.text.map(lambda t: len(re.findall(WORD, t))), strict=True))
    total = sum(tokens.values())
    assert abs(sum(tokens[r.doc_id] for r in mixed.collect()) / total - 1) < 0.35  # each leaf runs over by one document at most
    pieces = dict(pipeline.STAGES)["packing"](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == set(table.doc_id)
    last = pipeline.run(spark, SF).toPandas()
    assert len(last) and last.groupby("sequence_id").length.sum().max() <= 4096


def test_mixture_meets_its_budgets(spark):
    """Words of every leaf are what the mixing gives it, although one document is as long as its leaf's budget twice over."""
    import corpus_pipeline as pipeline

    rows = [(i, "  " + " \n".join(f"w{i}x{j}" for j in range(700 if i % 10 == 0 else 7)) + "\t", "en", f"src{i % 3 * 6}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    mixed = dict(pipeline.STAGES)["mixture"](spark, docs, SF)
    assert mixed.schema == docs.schema
    mixed, whole = mixed.toPandas(), {i: t for i, t, _, _ in rows}
    table = mixing.with_tokens(docs).withColumn("domain", mixing.domain_of(F.col("source")))
    want = mixing.mix(table, pipeline.MIXTURE).toPandas()
    mixed["words"] = mixed.text.map(lambda t: len(re.findall(WORD, t)))
    assert (mixed.n_chars == mixed.text.str.len()).all()
    assert mixed.groupby("source").words.sum().to_dict() == want.groupby("source").take_tokens.sum().to_dict()
    assert sorted(zip(mixed.doc_id, mixed.words, strict=True)) == sorted(zip(want.doc_id, want.take_tokens, strict=True))
    assert (want.take_tokens < want.n_tokens).any() and all(whole[r.doc_id].startswith(r.text) for r in mixed.itertuples())
