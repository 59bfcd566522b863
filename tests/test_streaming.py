"""Streaming receipt scoring over files landing in a folder (availableNow trigger)."""

import os
import tempfile

from aislekit.plans import training as T
from aislekit.streaming import score_receipt_stream


def test_stream_scores_each_file(spark):
    docs = spark.createDataFrame(
        [(i, t, c) for i, (t, c) in enumerate([("süt peynir yoğurt", "dairy"), ("ekmek simit", "bakery"),
                                               ("peynir süt", "dairy"), ("simit poğaça ekmek", "bakery")] * 5)],
        "doc_id long, text string, lang string")
    prepared = T.prepare(docs, "doc_id", "text", "lang")
    root = tempfile.mkdtemp(prefix="aislekit-stream-")
    src, sink, ck = (os.path.join(root, d) for d in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w", encoding="utf-8") as f:
        f.write("peynir, süt\nekmek,simit\n")
    with open(os.path.join(src, "b.csv"), "w", encoding="utf-8") as f:
        f.write("\nyoğurt\n")
    q = score_receipt_stream(spark, src, prepared, sink, ck)
    q.awaitTermination(120)
    rows = spark.read.parquet(sink).collect()
    got = {(os.path.basename(r["_file"]), r["receipt_id"], r["product"]): r["category"] for r in rows}
    assert got[("a.csv", "Siparis_01", "peynir")] == "dairy"  # "süt" folds to an unknown "sut"
    assert got[("a.csv", "Siparis_02", "simit")] == "bakery"
    assert ("b.csv", "Siparis_01", "yoğurt") in got
    assert len(rows) == 5
