"""Hand cases for the scalar text functions and the receipt source (FIXTURES §5)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from aislekit.functions import text as X
from aislekit.sources.receipts import read_receipts, receipt_items, receipts_from_texts


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_train_normaliser_dotted_capital_i(spark):
    assert _one(spark, X.normalize_train, "İçim Süt 1L") == "i çim süt l"


def test_train_normaliser_collapses_and_trims(spark):
    assert _one(spark, X.normalize_train, "  Ekmek,  500g!!  Tam-Buğday ") == "ekmek g tam buğday"


def test_fold_ascii(spark):
    assert _one(spark, X.fold_ascii, "İÇİM Süt 1L IŞIK") == "ICIM Sut 1L ISIK"
    assert _one(spark, X.fold_ascii, "ğĞöÖ") == "gGoO"
    assert _one(spark, X.fold_ascii, "") == ""
    assert _one(spark, X.fold_ascii, None) is None


def test_title_case_splits_on_spaces_only(spark):
    assert _one(spark, X.title_case, "süt ÜRÜN") == "Süt Ürün"
    assert _one(spark, X.title_case, "ab-cd e'f") == "Ab-cd E'f"


def test_word_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("Süt 1L a süt",)], "v string")
    out = df.select(X.word_tokens("v").alias("t")).select(X.word_ngrams_1_2("t").alias("g")).first()["g"]
    assert out == ["süt", "1l", "süt", "süt 1l", "1l süt"]


def test_split_items_blanks(spark):
    assert _one(spark, X.split_items, "a, ,b,,c") == ["a", "b", "c"]
    assert _one(spark, X.split_items, " x , y ") == ["x", "y"]


def test_receipts_skip_empty_lines_and_number_1_based(spark):
    df = spark.createDataFrame([(0, "a\n\nb"), (1, "﻿c, d\r\n")], "k long, text string")
    rows = receipts_from_texts(df, "text", ["k"]).orderBy("receipt_no").collect()
    assert [r["receipt_id"] for r in rows] == ["Siparis_01", "Siparis_02", "Siparis_03"]
    assert [r["items"] for r in rows] == [["a"], ["b"], ["\ufeffc", "d"]]  # not the file's first row


def test_receipt_ids_sort_as_text(spark):
    text = "\n".join(f"p{i}" for i in range(101))
    df = spark.createDataFrame([(0, text)], "k long, text string")
    ids = [r[0] for r in receipts_from_texts(df, "text", ["k"]).orderBy("receipt_id").select("receipt_id").collect()]
    assert len(ids) == 101
    assert ids.index("Siparis_100") < ids.index("Siparis_11")


def test_numbering_across_many_rows_matches_python(spark):
    texts = [(i, "\n".join(("" if (i + j) % 3 == 0 else f"x{i}_{j}, y") for j in range(i % 5)))
             for i in range(200)]
    df = spark.createDataFrame(texts, "k long, text string")
    got = [(r["receipt_no"], r["items"][0]) for r in
           receipts_from_texts(df, "text", ["k"]).orderBy("receipt_no").collect()]
    expect, n = [], 0
    for _, t in texts:
        for line in t.splitlines():
            if line.strip():
                n += 1
                expect.append((n, line.split(",")[0].strip()))
    assert got == expect


def test_read_receipts_file_crlf_and_bom(spark):
    d = tempfile.mkdtemp(prefix="aislekit-test-")
    path = os.path.join(d, "orders.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("﻿Süt,Ekmek\r\nPeynir, Zeytin ,\r\n\r\nÇay")
    rec = read_receipts(spark, path).orderBy("receipt_no").collect()
    assert [r["items"] for r in rec] == [["Süt", "Ekmek"], ["Peynir", "Zeytin"], ["Çay"]]
    items = receipt_items(read_receipts(spark, path)).where("receipt_no = 2").orderBy("pos").collect()
    assert [(r["pos"], r["product"]) for r in items] == [(0, "Peynir"), (1, "Zeytin")]


def test_blank_only_file_is_an_error(spark):
    import pytest

    from aislekit.sources.receipts import require_nonempty

    d = tempfile.mkdtemp(prefix="aislekit-test-")
    path = os.path.join(d, "empty.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n , ,\n\r\n   \n")
    with pytest.raises(ValueError):
        require_nonempty(read_receipts(spark, path))


def test_shelf_names_must_be_unique(spark):
    from aislekit.sources.shelves import require_shelves, shelves_from_json

    ok = spark.createDataFrame([('[{"name":"A","x":1,"y":2},{"name":"B","x":3,"y":4}]',)], "c string")
    assert require_shelves(shelves_from_json(ok, "c")).count() == 2
    dup = spark.createDataFrame([('[{"name":"A","x":1,"y":2},{"name":"A","x":3,"y":4}]',)], "c string")
    with pytest.raises(ValueError):
        require_shelves(shelves_from_json(dup, "c"))
    empty = spark.createDataFrame([("[]",)], "c string")
    with pytest.raises(Exception, match="non-empty JSON array"):
        require_shelves(shelves_from_json(empty, "c"))


def test_fixed_rounds_the_exact_binary_value(spark):
    cases = [(1.005, 2, "1.00"), (1.115, 2, "1.11"), (0.5, 3, "0.500"), (0.125, 2, "0.13"), (2.5, 0, "3"), (-1.115, 2, "-1.11"),
             (0.0, 2, "0.00"), (1e-9, 3, "0.000"), (123456.789, 2, "123456.79"), (1e-70, 1, "0.0")]
    for x, digits, text in cases:
        got = spark.createDataFrame([(x,)], "x double").select(X.fixed("x", digits)).first()[0]
        assert got == text, (x, digits, got)


def test_only_the_first_row_loses_its_mark(spark):
    rows = [(1, "﻿a, b\n﻿c, d"), (2, "﻿e")]
    df = spark.createDataFrame(rows, "n long, t string")
    got = {r["receipt_no"]: r["items"] for r in receipts_from_texts(df, "t", ["n"]).collect()}
    assert got == {1: ["a", "b"], 2: ["﻿c", "d"], 3: ["﻿e"]}


def test_broken_shelf_lists_fail(spark):
    from aislekit.sources.shelves import shelves_from_json

    for bad in ("[]", "{", None):
        df = spark.createDataFrame([(bad,)], "j string")
        with pytest.raises(Exception, match="non-empty JSON array"):
            shelves_from_json(df, "j").collect()
