"""doc_ids over the whole BIGINT range beside nulls in every operator, ranges of doc_ids, long texts in the span finder."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from aislekit.llm import common, fingerprints, idfile, ngram_join, packing, pii, quality_rules, spelling, substring_dedup, turn_trie, wordpiece, wrapper
from aislekit.llm import quality_classifier as qc


def wide_ids(n, seed=1):
    rng = random.Random(seed)
    ids = [rng.randint(-2**63, 2**63 - 1) for _ in range(n - 6)] + [2**53 + 1, 2**53 + 3, 2**53 + 5, 2**63 - 2, -2**63, 0]
    assert len(set(ids)) == n
    rng.shuffle(ids)
    return ids


@pytest.fixture(scope="module")
def wide(spark):
    """Hash-like ids with one null in each partition."""
    ids = wide_ids(300)
    rows = [(i, f"text number {k} of the ids " + "word " * (k % 9) + f"x{k}y a{k}@b.org") for k, i in enumerate(ids)]
    rows += [(None, f"row without an id {k}") for k in range(4)]
    return ids, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_no_id_is_lost_or_altered(spark, wide, tmp_path):
    ids, docs = wide
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = str(tmp_path / "ids")
    idfile.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    plan = packing.PackingPlan(public_tokenizers.path("word_bpe_49k.json"))
    results = {
        "op1": fingerprints.edited_pairs(docs), "op2": packing.pack(docs, plan), "op4": quality_rules.judge(docs, labels),
        "op5": wordpiece.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")), "op6": substring_dedup.dedup(docs),
        "op7": idfile.read_ids(spark, path), "op8": ngram_join.join(docs), "op9": qc.classify(spark, docs, labels),
        "op10": pii.find(spark, docs, pii.Model())}
    for name, df in results.items():
        got = [r["doc_id"] for r in df.select("doc_id").collect()]
        assert got.count(None) == 4 and sorted(d for d in got if d is not None) == sorted(ids), name
    starts = [r["doc_id"] for r in results["op7"].orderBy("start").collect()]
    assert starts[:300] == sorted(ids)


def test_wide_ids_of_turns_words_and_pages(spark):
    ids = wide_ids(120, 2)
    turns = spark.createDataFrame([(i, 0, "user", f"t{k}") for k, i in enumerate(ids)] + [(None, 0, "user", "x")],
                                  "conv_id long, turn long, role string, text string")
    nodes = turn_trie.trie(turns).collect()
    assert max(r["n_convs"] for r in nodes) == 120 and {r["conv_id"] for r in nodes} <= set(ids)
    pages = spark.createDataFrame([(i, "http://h.example/", f"<p>page {k}</p>") for k, i in enumerate(ids)] + [(None, None, None)],
                                  "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in wrapper.extract(pages).collect() if r["page_id"] is not None) == sorted(ids)
    docs = spark.createDataFrame([(i, "again") for i in ids] + [(None, "again")], "doc_id long, text string")
    counts = sum((spelling.document_words(str(i), "again") for i in ids), spelling.document_words("", "again"))
    assert {r["word"]: r["n"] for r in spelling.words(docs).collect()} == {w: n for w, n in counts.items() if n > 2 and len(w) > 4}


@pytest.mark.parametrize("bucket_bytes", [60, 500, 5000])
def test_fingerprints_over_many_ranges(spark, wide, monkeypatch, bucket_bytes):
    """Every document meets its successor, whatever the ranges."""
    ids, docs = wide
    monkeypatch.setattr(fingerprints, "key_bounds", lambda d: common.key_bounds(d, bucket_bytes))
    bounds = common.key_bounds(docs, bucket_bytes)
    assert set(bounds) <= {*ids, common.NULL_KEY} and len(bounds) > 3
    table = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(docs).where("doc_id is not null").collect()}
    assert len(got) == 300
    minhash = fingerprints.MinHash()
    order = sorted(ids)
    for a, b in zip(order, order[1:]):
        own, following = (minhash.short(fingerprints.fingerprint(table[i], minhash)) for i in (a, b))
        assert got[a]["near_next"] == fingerprints.likeness(own, following)
        assert got[a]["fingerprint"] == own.astype(">u2").tobytes().hex()


def test_few_rows_and_a_null(spark):
    for rows in ([(5, "a b c")], [(5, "a b c"), (None, "d e f")], [(None, "x"), (None, "y")], [(2**63 - 1, "m"), (None, "n")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert fingerprints.edited_pairs(df).count() == len(rows)


def test_long_addresses_are_redacted_whole():
    always = pii.Model(start=20.0, thresholds={0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5})
    local = "a" * 100
    text = f"write to {local} [at] example [dot] org or ({'b' * 3000}@x.net) today"
    base, added = pii.all_spans(text, always)
    out = pii.redact_text(text, base + added)
    assert "a" * 4 not in out.replace("day", "") and "bbb" not in out


def test_spans_take_linear_time():
    always = pii.Model(start=20.0, thresholds={0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5})
    unit = "mail a1@b.org or c (at) d [dot] net, call +49 30 1234567 or 030 7654321, at 10.0.0.1 or 10-0-0-2; "
    seconds = []
    for n in (1000, 4000):
        begin = time.process_time()
        base, added = pii.all_spans(unit * n, always)
        seconds.append(time.process_time() - begin)
        assert len(base) == 3 * n and len(added) >= n
    assert seconds[1] < 8 * seconds[0] + 0.2


def test_cover_equals_comparison_with_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        spans = [(0, int(s), int(s + n)) for s, n in zip(rng.integers(0, 60, 8), rng.integers(1, 9, 8), strict=True)]
        cover = pii.Cover(spans[:5])
        free = []
        for x in spans[5:]:
            assert cover.touches(x) == any(s < x[2] and x[1] < e for _, s, e in spans[:5] + free)
            if not cover.touches(x):
                cover.add(x)
                free.append(x)


def test_bounds_fold_to_constants(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    bounds = common.key_bounds(docs, 100)
    df = common.with_bucket(docs, bounds, borrow=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and df.where("not _lent").groupBy("_bucket").count().count() == len(bounds)
    assert df.where("_lent").count() == len(bounds)
