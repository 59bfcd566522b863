"""Conversation trie, spelling variants and page text against brute force, planted pages and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from aislekit.llm import dom, spelling, turn_trie, wrapper
from aislekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---- conversation trie

def trie_brute(rows):
    """{(depth, smallest member): (parent, n, children, leaves, saved, sha)} of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(full[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


CONV = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(5)
    texts = ["", "a", "bb", "ccc ä", None, "d" * 50]
    rows = []
    for c in [*range(0, 40), *range(95, 230), -5, -100, 2**53 + 1, 2**62, 300, 301]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(7, 3, "user", "same"), (7, 3, "user", "same"), (None, 1, "user", "nobody")]
    rows += [(901, 0, "user", "x")]  # its base does not exist
    return rows


@pytest.mark.parametrize("shard_turns", [5, 40, 1 << 18])
def test_trie_against_brute_force(spark, shard_turns):
    rows = odd_conversations()
    assert trie_rows(turn_trie.trie(spark.createDataFrame(rows, CONV), shard_turns)) == trie_brute(rows)


def test_trie_of_the_table_and_of_nothing(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in conv.collect()]
    assert trie_rows(QUERIES["op11_turn_trie"](spark, SF)) == trie_brute(rows)
    assert turn_trie.trie(spark.createDataFrame([], CONV)).count() == 0


def test_trie_ignores_other_columns(spark):
    rows = odd_conversations()[:60]
    df = spark.createDataFrame([(*r, b"x", 1, "z") for r in rows], CONV + ", key binary, n int, shard string")
    assert trie_rows(turn_trie.trie(df)) == trie_brute(rows)


def test_double_array_with_scattered_children():
    """Many states with the same far apart codes: all edges are found, no other, in little room."""
    rng = np.random.default_rng(1)
    array = turn_trie.DoubleArray(10)
    first = np.arange(300)
    array.add_level(np.zeros(300, np.int64), first)
    parents = array.step(np.zeros(300, np.int64), first)
    edges = np.array(sorted((int(p), int(c)) for p in parents for c in rng.choice(5000, rng.integers(1, 6), replace=False)))
    array.add_level(edges[:, 0], edges[:, 1])
    to = array.step(edges[:, 0], edges[:, 1])
    assert len(set(to.tolist())) == len(edges) and not set(to.tolist()) & {0, *parents.tolist()}
    with pytest.raises(ValueError):
        array.step(edges[:1, 0], np.array([5001]))
    assert array.end < 5000 + 2 * len(edges)


# ---- spelling

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def variants_brute(rows):
    n = words_brute(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def variant_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abé", k=rng.randint(5, 9))) for _ in range(150)]
    base += ["thaten" * 40, "thaten" * 40 + "x", "ÀÉÎÕÜ", "Straße", "x" * 5000, "x" * 5001, "aaaaa", "aaaaaa", "aaaaaaa"]
    weight = [2.0 ** rng.randint(0, 9) for _ in base]
    rows = [(i, " ".join(rng.choices(base, weight, k=60)) + rng.choice(["", " 12-", "\x00", "🙂", "日本"])) for i in range(200)]
    rows += [(1, "Again AGAIN again"), (None, "again"), (7, None), (8, ""), (2**53 + 1, "agaim agaim agaim")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n int, word string")
    assert variant_rows(spelling.variants(df)) == variants_brute(rows)
    assert spelling.variants(df.limit(0)).count() == 0


def test_variants_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert variant_rows(QUERIES["op12_spelling_variants"](spark, SF)) == variants_brute(rows)


def test_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 3)
    rows = [(str(i), "seven eight nines tenth seven") for i in range(9)]
    out = pd.concat(spelling._count(iter([pd.DataFrame(rows, columns=["doc_id", "text"])]))).groupby("word")["n"].sum().to_dict()
    assert out == {w: n for w, n in words_brute(rows * 1).items()} or sum(out.values()) == 45


# ---- pages

def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, 3) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host int")
    out = {r["page_id"]: r for r in wrapper.extract(df).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    return [out[i]["text"] for i in range(len(rows))]


def words_of(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)) + "."


def test_articles_of_the_table(spark):
    out = {r["page_id"]: r["text"] for r in QUERIES["op13_wrapper_text"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        import html
        assert out[r["page_id"]] == " ".join(html.unescape(inner).split())


@pytest.mark.parametrize("outer", ["article", "main", "div class=post", "div class=x1", "div"])
def test_opaque_boilerplate_is_found_by_alignment(spark, outer):
    """Nothing but the article tells what it is: the same notice, menu and footer on all pages, a varying teaser."""
    rng = random.Random(11)
    rows, want = [], []
    tag = outer.split()[0]
    for i in range(30):
        title, body = words_of(rng, 6), [words_of(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 7))]
        menu = "".join(f'<a href="/{k}">Section {k}</a> ' for k in range(5))
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        rows.append(("http://User@Opaque.Example.org:80/p?id=%d" % i,
                     f"<html><body><div class=q1>{menu}</div><div class=q2>We use crumbs on this site.</div>"
                     f"<{outer}><h2>{title}</h2>{paragraphs}<p>Share this page with friends</p></{tag}>"
                     f"<div class=q3>{words_of(rng, 4)}</div><div class=q4>Imprint and terms 2024</div></body></html>"))
        want.append(" ".join([title, *body]))
    assert texts(spark, rows) == want


def test_named_boilerplate_goes_even_when_it_varies(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(12):
        body = [words_of(rng, 30) for _ in range(3)]
        v = words_of(rng, 10)
        rows.append((f"//multi.example.com/{i}", f"""<!DOCTYPE html><head><title>{v}</title><style>p{{}}</style></head><body class="has-sidebar">
<header><a href=/>{v}</a><h1>Site</h1></header><nav><ul><li>{v}<li>{v}</ul></nav>
<div id="cookie-notice"><p>{v}</p></div><div class="layout sidebar-right"><aside><p>{v}</p></aside>
<main><article class="post post-{i}"><header><h1>Head {i}</h1><p class="byline">{v}</p></header><p>{body[0]}<div class="adBox ad"><p>{v}</div>
<p>{body[1]}<script>document.write("<p>{v}</p>")</script><ul><li>{body[2]}</ul><form><p>{v}<input></form>
<section id="comments"><article class="comment"><p>{v}</p></article></section></article></main>
<div class="sidebar"><article class=teaser><h3>{v}</h3></article></div></div><footer>&copy; {v}</footer>"""))
        want.append(" ".join([f"Head {i}", *body]))
    assert texts(spark, rows) == want


def test_copies_and_common_passages_stay(spark):
    """Copies of a page on a host, and a paragraph that many pages share but not all, are content."""
    rng = random.Random(9)
    common = words_of(rng, 40)
    rows, want = [], []
    for i in range(20):
        body = ["twin text " * 30 + "."] if i < 8 else [words_of(rng, 30), *([common] if i < 19 else []), words_of(rng, 30)]
        body = [" ".join(b.split()) for b in body]
        rows.append(("http://twins.example.net/", "<body><article>" + "".join(f"<p>{b}</p>" for b in body) +
                     f"</article><div class=ad>{words_of(rng, 5)}</div></body>"))
        want.append(" ".join(body))
    rows += [(f"http://pair.example.net/{i}", "<body><div><p>Only two copies of one text here.</p></div></body>") for i in range(2)]
    want += ["Only two copies of one text here."] * 2
    assert texts(spark, rows) == want


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "down here" + "</div>" * 3000
    rows = [(None, None), ("http://a.example/", ""), (None, "plain &amp text &#233; &nbsp; &lt;b&gt; a < b"), ("::", "<p>one<p>two<br>three"),
            ("http://b.example/", deep), ("http://c.example/", "<article><!-- x --><p>a<b>b</b>c</p> <td>d</article><p title='x>y' class=\"a"),
            ("http://d.example/", "<script>var a = 1;"), ("http://e.example/", "<article>" + "<p>w</p>" * 5000 + "</article>"),
            ("http://f.example/", "<p title=it's>it is</p><P ID=x>don't</P>"), ("http://f.example/", "<p title=it's>it is</p><P ID=x>don't</P>")]
    got = texts(spark, rows)
    assert got == ["", "", "plain & text é <b> a < b", "one two three", "down here", "abc d", "", " ".join(["w"] * 5000),
                   "it is don't", "it is don't"]
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_merge_does_not_depend_on_the_groups(spark):
    """Wrappers of many trees, merged by twos and at once, align the same containers."""
    rng = random.Random(2)
    parts = ["<div class=aa><p>x</div>", "<div><div><p>y</div></div>", "<section>z</section>", "<div class='aa bb'>t</div>", "<div>u<section>v</section></div>"]
    pages = ["<body>" + "".join(rng.choices(parts, k=rng.randint(1, 5))) + "</body>" for _ in range(60)]
    trees = sorted({dom.dump(dom.read(p).tree) for p in pages})
    whole = dom.load(trees[0])
    for t in trees[1:]:
        dom.merge(whole, dom.load(t))
    assert dom.dump(dom.load(dom.dump(whole))) == dom.dump(whole)
    for t in trees:
        places = dom.align(dom.load(t), whole)
        found = [p for p in places if p >= 0]
        assert len(set(found)) == len(found) and places[0] == 0 and len(found) >= 0.6 * len(places)
