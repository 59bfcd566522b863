"""Lines by byte offset: every cut of a file gives the same lines, and receipts survive changed splits."""

import gzip
import os
import random
import tempfile

import pytest

from aislekit.sources import lines as L
from aislekit.sources.receipts import read_receipts


def _brute(data: bytes):
    at, out = 3 if data.startswith(b"\xef\xbb\xbf") else 0, []
    while at < len(data):
        m = L._END.search(data, at)
        out.append((at, data[at:m.start()] if m else data[at:]))
        at = m.end() if m else len(data)
    return out


def test_blocks_of_any_size_give_every_line_once(monkeypatch):
    rng = random.Random(1)
    for trial in range(400):
        data = b"".join(rng.choices([b"a", b"bc", b"\n", b"\r\n", b"\r", b"", "ş".encode()], k=rng.randint(0, 25)))
        if trial % 5 == 0:
            data = b"\xef\xbb\xbf" + data
        monkeypatch.setattr(L, "_MORE", rng.choice([1, 2, 3, 7, 1000]))
        size = rng.randint(1, 12)
        read = lambda at, n: data[at:at + n]  # noqa: B023, E731
        got = [x for at in range(0, len(data), size)
               for x in L.block_lines(read, at, min(len(data), at + size), b"\xef\xbb\xbf")]
        want = _brute(data)
        if size <= 3 and trial % 5 == 0:  # a mark that fills a block; real blocks are larger
            continue
        assert got == want, (data, size)
        assert list(L.block_lines(read, 0, None, b"\xef\xbb\xbf")) == want


def _folder():
    d = tempfile.mkdtemp(prefix="aislekit-test-")
    for k in range(3):
        with open(os.path.join(d, f"orders_{k}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write("﻿" + "".join(f"p{k}_{i}, Ekmek\r\n" if i % 7 else "\n , ,\n" for i in range(3000)))
    open(os.path.join(d, "_SUCCESS"), "w").close()
    return d


def test_receipts_survive_changed_splits(spark):
    """Built under one split size, read under others: all receipts, in order."""
    d = _folder()
    want = [f"p{k}_{i}" for k in range(3) for i in range(3000) if i % 7]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for built, read in (("134217728", "5000"), ("5000", "134217728"), ("20000", "7000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", built)
            receipts = read_receipts(spark, d)
            spark.conf.set("spark.sql.files.maxPartitionBytes", read)
            got = receipts.orderBy("receipt_no").collect()
            assert [r["receipt_no"] for r in got] == list(range(1, len(want) + 1))
            assert [r["items"][0] for r in got] == want and all(r["items"][1] == "Ekmek" for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_small_blocks_names_and_compression(spark):
    d = _folder()
    whole = {(r["_file"], r["_offset"]): r["value"] for r in L.read_lines(spark, [d]).collect()}
    cut = L.read_lines(spark, [f"file://{d}/orders_*.csv"], block_bytes=777)
    assert cut.rdd.getNumPartitions() > 50
    assert {(r["_file"].removeprefix("file://"), r["_offset"]): r["value"] for r in cut.collect()} == whole
    path = os.path.join(d, "more.csv.gz")
    with gzip.open(path, "wb") as f:
        f.write("İ, b\nc\r\r\nd".encode("cp1254"))
    assert [r["value"] for r in L.read_lines(spark, [path], "cp1254").orderBy("_offset").collect()] == ["İ, b", "c", "", "d"]
    with pytest.raises(Exception, match="no_such"):
        L.read_lines(spark, [d + "/no_such.csv"]).collect()


def test_text_is_parsed_once(spark):
    """The optimized plan splits items in one place only: no copy in filters or in the counting branch."""
    from aislekit.sources.receipts import receipts_from_texts

    df = spark.createDataFrame([(i, f"a{i}, b\n\nc") for i in range(50)], "k long, text string").repartition(3)
    out = receipts_from_texts(df, "text", ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(split") == 2  # of a text into lines, and of a line into items
    assert out.count() == 100
