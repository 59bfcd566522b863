"""The pieces that run inside tasks, against plain versions of themselves."""

import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislekit.llm import bwt, fingerprints, idfile, ngram_join, packing, pii, words
from aislekit.llm import quality_classifier as qc
from aislekit.llm.tokens import WordCodec
from aislekit.llm.wordpiece import END, Automaton, read_vocabulary


def test_words_and_segments(monkeypatch):
    rnd = random.Random(1)
    text = " ".join(rnd.choices(["abc", "DEF", "x\ny", "é\x0bz", "longer", "  "], k=2000)).encode()
    found = words.word_hashes(text)
    assert len(found) == len(re.findall(rb"[^\x20\x09-\x0D]+", text))
    assert (words.word_hashes(text.lower().replace(b"\n", b" ")) == found).all()  # A-Z only; é has no capital here
    giant = b"a" * 5000 + b" b " + b"c" * 3000
    whole = words.word_hashes(giant)
    monkeypatch.setattr(words, "SEGMENT", 1000)
    assert (words.word_hashes(text) == found).all()
    assert len(whole) == 3 and (words.word_hashes(giant) == whole).all()


def test_shingles():
    assert len(words.shingle_set(b"")) == 0 and len(words.shingle_set(b" \n")) == 0
    assert len(words.shingle_set(b"a b c")) == 1
    assert len(words.shingle_set(b"a b c d e f a b c d e")) == 6  # the seventh is the first again
    assert (words.shingle_set(b"A b C") == words.shingle_set(b"a\tb c ")).all()
    assert words.shingle_set(b"a b c")[0] != words.shingle_set(b"c b a")[0]


def test_fingerprint_of_edit_is_that_of_the_edited_text():
    rnd, minhash = random.Random(3), fingerprints.MinHash()
    vocabulary = ["aa", "bé", "Cc", "d", "e\n", "f\t", "g  "] + [f"w{i}" for i in range(40)]
    for _ in range(300):
        text, other = (" ".join(rnd.choices(vocabulary, k=rnd.randint(0, n))) for n in (40, 20))
        own, changed, edited = fingerprints.both_fingerprints(text, other, minhash)
        cut = len(text) // 4
        assert edited == text[:len(text) - cut] + other[:cut]
        assert (own == fingerprints.fingerprint(text, minhash)).all()
        assert (changed == fingerprints.fingerprint(edited, minhash)).all()


def test_minhash_estimates_jaccard():
    rnd, minhash = random.Random(4), fingerprints.MinHash()
    for share in (0.2, 0.5, 0.9):
        a = np.array([rnd.getrandbits(64) for _ in range(2000)], np.uint64)
        b = a.copy()
        b[int(2000 * share):] = [rnd.getrandbits(64) for _ in range(2000 - int(2000 * share))]
        x, y = (minhash.short(minhash.lows(s)) for s in (a, b))
        assert abs(fingerprints.likeness(x, y) - share / (2 - share)) < 0.17


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 32, (1 << 64) - 1])
def test_simple8b_round_trip(n, high):
    values = (np.random.default_rng(n).random(n) * high).astype(np.uint64)
    if n > 50:
        values[::7], values[20:45] = 0, 1
    coded, before = idfile.encode(values)
    assert (idfile.decode(coded) == values).all()
    for i, first in enumerate(before.tolist()):
        assert (idfile.decode(coded[first:]) == values[idfile.RUN * i:]).all()


def test_first_fit_decreasing_is_first_fit():
    rnd = random.Random(5)
    for _ in range(50):
        sizes = sorted((rnd.randint(1, 100) for _ in range(rnd.randint(0, 60))), reverse=True)
        bins, expected = [], []
        for s in sizes:
            at = next((i for i, b in enumerate(bins) if b + s <= 100), len(bins))
            if at == len(bins):
                bins.append(0)
            expected.append((at, bins[at]))
            bins[at] += s
        assert packing.first_fit_decreasing(sizes, 100) == expected


def test_automaton_counts_greedy_longest_matches():
    pieces = read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    automaton, known = Automaton(pieces), set(pieces) | {(END,)}

    def greedy(word):
        s, n, i = (*word, END), 0, 0
        while i < len(s):
            j = len(s)
            while s[i:j] not in known:
                j -= 1
            n, i = n + (s[i] != END), j
        return n

    rnd = random.Random(6)
    parts = [bytes(x for x in p if x != END) for p in rnd.sample(pieces, 500)]
    for _ in range(1500):
        word = b"".join(rnd.choices(parts, k=rnd.randint(1, 4)))[:40] or b"x"
        assert automaton.count(word) == greedy(word)
    small = Automaton([(1,), (2,), (1, 2, 1), (2, 2, END)])
    assert small.count(bytes([1, 2, 2])) == 2 and small.count(bytes([1, 2, 1, 2])) == 2
    with pytest.raises(ValueError):
        small.count(bytes([3]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_library(name):
    codec, rnd = WordCodec(public_tokenizers.path(name), limit=200), random.Random(7)
    texts = ["", " ", "\n", "a\n\nb", " a", "a ", "a  b", "\na", "a\n", "x\ty z", "é é  b", "I'm it's don't <|endoftext|>",
             "\x1c a\x1cb", "a \n b", "ΑΣ ΣΑΣ", "１２ 12³4", "😀 a😀b", "a\r\nb", "don 't", "a\x00b \x00", "İ I", "wait... a,", "a!!! b?.,"]
    texts += ["".join(rnd.choices(["a", "b", "'s", " ", "\n", "  ", "é", "1", "#", "\t", " ", "the", " the", ".", ",\n"], k=rnd.randint(1, 14)))
              for _ in range(1500)]
    specials = [t.content for t in codec.tokenizer.get_added_tokens_decoder().values()]
    texts += [a + s + b for s in specials for a in ("", "x", "x ", " ", "\n", "A\n\n") for b in ("", "y", " y", "  ", s, s.upper(), s[1:])]
    library = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    assert [np.array(e.ids, "<u4").tobytes() for e in library] == codec.encode(texts)


def test_repeated_prefixes_by_merged_transforms():
    rnd = random.Random(8)
    for _ in range(150):
        depth, letters = rnd.choice([1, 3, 5, 8]), rnd.choice([b"ab", b"abc\x00", b"a", bytes(range(65, 91))])
        strings = [bytes(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(rnd.randint(0, 12))]
        strings += rnd.choices(strings, k=3) if strings else []
        expected = defaultdict(set)
        for i, s in enumerate(strings):
            for j in range(len(s) - depth + 1):
                expected[s[j:j + depth]].add((i, j))
        got = defaultdict(set)
        for i, j, g in zip(*(x.tolist() for x in bwt.repeated_prefixes(strings, depth, rnd.choice([1, 10, 60, 1000]))), strict=True):
            got[g].add((i, j))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_divide_skip_finds_all_components():
    rnd = np.random.default_rng(9)
    for trial in range(30):
        base = [rnd.integers(0, 1 << 40, n, dtype=np.uint64) for n in rnd.integers(3, 60, 6)]
        sets = [np.unique(b[rnd.random(len(b)) < 0.95]) for b in base for _ in range(4)]
        sets = sorted((s for s in sets if len(s)), key=len)
        labels = np.arange(len(sets))
        links = ngram_join.divide_skip(sets, sets, labels, labels, 80, within=True)
        root = list(range(len(sets)))
        low = list(range(len(sets)))

        def find(x, r):
            while r[x] != x:
                x = r[x]
            return x

        for q, v in links:
            a, b = find(q, root), find(v, root)
            root[max(a, b)] = min(a, b)
        for i, x in enumerate(sets):
            for j in range(i):
                n = len(np.intersect1d(x, sets[j]))
                if 100 * n >= 80 * (len(x) + len(sets[j]) - n):
                    a, b = find(i, low), find(j, low)
                    low[max(a, b)] = min(a, b)
        assert [find(i, root) for i in labels] == [find(i, low) for i in labels], trial


def test_base_spans():
    text = "mail a.b@c.de_x@y.zz, 1.2.3.256 and 10.0.0.1.9 card 4111 1111-1111 1111 not 4111111111111112 call +1 (017) 555-7713 +12"
    found = {(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)}
    assert found == {("email", "a.b@c.de"), ("email", "_x@y.zz"), ("ip", "10.0.0.1"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (017) 555-7713")}


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(10)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(rnd.choices(["a", "@", ".", "b.c", "1", "25", "_", "-", " ", "256", "+", "300.1.1.1"], k=rnd.randint(0, 25)))
        spans = pii.base_spans(text)
        assert [s[1:] for s in spans if s[0] == 0] == [m.span() for m in email.finditer(text)]
        assert [s[1:] for s in spans if s[0] == 1] == [
            m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "(at" * 100_000, "+1" * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_boosted_trees_learn_and_calibrate():
    rng = np.random.default_rng(11)
    x = np.zeros((4000, pii.FEATURES))
    x[:, 0], x[:, 2], x[:, 5] = 3, rng.integers(7, 16, 4000), rng.integers(0, 5, 4000)
    y = ((x[:, 2] > 10) & (x[:, 5] < 3)).astype(float)
    model = pii.fit(x, y, np.arange(4000))
    assert 3 in model.thresholds
    chosen = model.probability(x) >= model.thresholds[3]
    assert (chosen == (y == 1)).mean() > 0.99
    assert pii.fit(x, np.ones(4000), np.arange(4000)).thresholds == {}


def test_redaction():
    assert pii.redact_text("call +1 (017) 555-7713 now", [(3, 5, 22)]) == "call <PHONE> now"
    assert pii.redact_text("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a<EMAIL>f"
    assert pii.redact_text("abc", []) == "abc"


def test_classifier_learns_words_and_repeats():
    plan, rnd, bags = qc.TrainingPlan(buckets=1 << 12, epochs=6), random.Random(12), []
    good, bad = [f"good{i}" for i in range(50)], [f"bad{i}###" for i in range(50)]
    def text(label):
        if not label and rnd.random() < 0.5:
            return " ".join([rnd.choice(good)] * 30)
        return " ".join(rnd.choices(good if label else bad, k=30))
    for _ in range(400):
        y = int(rnd.random() < 0.7)
        bags.append((y, *qc._bag(text(y), plan, {})))
    known = qc._Words(qc.fit(bags, plan))
    right = [(qc.score_text(text(y), known) >= 0.3) == bool(y) for y in (0, 1) for _ in range(100)]
    assert sum(right) >= 195
    assert qc.fit([], plan).bias == 0 and qc.fit([(1, *qc._bag("a", plan, {}))], plan).bias > 3
    assert 0 <= qc.score_text(None, known) <= 1


def test_classifier_reads_long_words_whole(monkeypatch):
    plan, rnd = qc.TrainingPlan(buckets=1 << 12, epochs=6), random.Random(13)
    monkeypatch.setattr(qc, "PIECE", 61)
    for alphabet in ("ab<>\0", "aé\u4e2d\ud800\U0001f600", "\u4e00\u4e01\u4e02"):
        for length in (201, 242, 243, 244, 245, 700):
            word = "".join(rnd.choices(alphabet, k=length))
            assert sorted(qc.word_features(word, plan)) == sorted(np.concatenate([*qc.long_word_features(word, plan)]).tolist())
            found, counts = qc._bag(f"{word} {word} x", plan, {})
            want = [*qc.word_features(word, plan)] * 2 + qc.word_features("x", plan) + [0]
            assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == {f: want.count(f) for f in want}

    def text(label):  # one word; only its middle tells
        chars = rnd.choices("\u4e2d\u6587\u5b57" if label else "\u30a2\u30ab\u30b5", k=300)
        return "\u3042" * 120 + "".join(chars) + "\u3044" * 120

    known = qc._Words(qc.fit([(y, *qc._bag(text(y), plan, {})) for y in (0, 1) * 100], plan))
    right = [(qc.score_text(text(y), known) >= 0.5) == bool(y) for y in (0, 1) * 50]
    assert sum(right) >= 95 and len(known) == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_merges_a_word_once_whatever_marks_follow(name):
    codec, path = WordCodec(public_tokenizers.path(name)), public_tokenizers.path(name)
    inner, asked = codec.tokenizer, []

    def tokenize(word):
        asked.append(word)
        return inner.model.tokenize(word)

    codec.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=tokenize), encode_batch_fast=inner.encode_batch_fast)
    texts = ["x houseboat, houseboat. houseboat", "x houseboat! houseboat", "x houseboat?", "K, İ' İ!", None]
    library = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert codec.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in library]
    assert sum("houseboat" in word for word in asked) == 1


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for x in ([], [7], [-5, -5, 0, 9], rng.integers(-1 << 63, (1 << 63) - 1, 50), [-1 << 63, (1 << 63) - 1], np.arange(300) * 3):
        x = np.asarray(x, np.int64)
        assert ngram_join._unpack(ngram_join._pack(x)).tolist() == x.tolist()
        assert ngram_join._unpack(ngram_join._pack(np.sort(x), True), True).tolist() == np.sort(x).tolist()
    assert len(ngram_join._pack(np.arange(1 << 40, (1 << 40) + 1000), True)) == 1009  # a byte each


def test_exact_search_sends_a_set_once(spark, monkeypatch):
    """Pairs of linked sets without number: what is shuffled is the sets, not the sets times the units they make."""
    rows = []
    for i in range(400):
        s = np.sort(np.arange(10, dtype=np.uint64) * np.uint64(1 << 40) + np.uint64(i // 2))
        rows.append((i, i, len(s), bytearray(s.tobytes()), s.view(np.int64)[:3].tolist()))
    table = spark.createDataFrame(rows, "doc_id long, component long, n long, shingles binary, prefix array<long>")
    sent, run = [], ngram_join._searched
    monkeypatch.setattr(ngram_join, "_searched", lambda df, plan: (sent.append(df.count()), run(df, plan))[1])
    links = ngram_join._exact_links(table, ngram_join.JoinPlan(block=5))
    assert sorted((min(r), max(r)) for r in links.collect()) == [(i, i + 1) for i in range(0, 400, 2)]
    assert sent == [400]


def test_exact_search_of_a_large_group_goes_in_rounds(spark, monkeypatch):
    """One shingle that all have makes one group: each round shuffles a few times the sets, and no link is lost."""
    rows = []
    for i in range(120):
        s = np.sort(np.append(np.arange(1, 10, dtype=np.uint64) * np.uint64(1 << 40) + np.uint64(i // 2), np.uint64(3)))
        rows.append((i, i, len(s), bytearray(s.tobytes()), s.view(np.int64)[:3].tolist()))
    table = spark.createDataFrame(rows, "doc_id long, component long, n long, shingles binary, prefix array<long>").coalesce(2)
    sent, run = [], ngram_join._searched
    monkeypatch.setattr(ngram_join, "_searched", lambda df, plan: (sent.append(df.count()), run(df, plan))[1])
    links = ngram_join._exact_links(table, ngram_join.JoinPlan(block=8, copies=4))
    assert {(min(r), max(r)) for r in links.collect()} == {(i, i + 1) for i in range(0, 120, 2)}
    assert len(sent) > 2 and max(sent) < 2 * 4 * 120


def test_near_copies_shuffles_doubted_rows_only(spark, monkeypatch):
    """Repeated and null doc_ids, copies, and a bitmap so small that most rows are doubted."""
    import corpus_pipeline as pipeline

    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(30)] + [(None, "a b c d e f g")] * 2
    rows += [(40, rows[3][1]), (41, rows[3][1]), (5, "z first"), (5, "another text than before"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    want = {(i, t) for i, t in rows if i not in (40, 41, 5)} | {(5, min(t for i, t in rows if i == 5))}
    for bits in (23, 6):
        monkeypatch.setattr(pipeline, "BITS", bits)
        out = pipeline.near_copies(spark, docs, "")
        assert out.columns == docs.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert len(got) == 32 and set(got) == want
    assert "doubted" in out._jdf.queryExecution().toString()
