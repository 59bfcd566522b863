"""Distributed running totals and exact quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislekit.operators import profile as PR
from aislekit.operators.ordering import row_index, running_total


def test_running_total_matches_python(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), rnd.randint(0, 50), i, rnd.randint(0, 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, id int, w int").repartition(5)
    got = {(r["g"], r["id"]): r["rt"] for r in
           running_total(df, ["k", "id"], weight="w", group_cols=["g"], out="rt").collect()}
    expect, acc = {}, {}
    for g, k, i, w in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        acc[g] = acc.get(g, 0) + w
        expect[(g, i)] = acc[g]
    assert got == expect


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = sorted((r["row_no"], r["v"]) for r in row_index(df, ["v"]).collect())
    assert [n for n, _ in got] == list(range(1, 1001))
    assert [v for _, v in got] == sorted(v for _, v in got)


def test_exact_quantiles_linear_interpolation(spark):
    rnd = random.Random(3)
    a = [float(rnd.randint(0, 40)) for _ in range(301)]
    b = [rnd.random() * 100 for _ in range(57)] + [None] * 5
    df = spark.createDataFrame([(a[i], b[i] if i < len(b) else None) for i in range(len(a))], "a double, b double")
    q = {(r["column"], r["q"]): r["value"] for r in PR.exact_quantiles(df, ["a", "b"]).collect()}
    bb = [x for x in b if x is not None]
    for p in (0.25, 0.5, 0.75):
        assert q[("a", p)] == pytest.approx(np.percentile(a, p * 100))
        assert q[("b", p)] == pytest.approx(np.percentile(bb, p * 100))


def test_describe_and_categorical(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (None, "y"), (5, None)], "n int, s string")
    d = PR.describe_numeric(df, ["n"]).first()
    assert (d["count"], d["min"], d["max"]) == (4, 1.0, 5.0)
    assert d["mean"] == pytest.approx(2.75) and d["p50"] == pytest.approx(2.5)
    c = PR.describe_categorical(df, ["s"]).first()
    assert (c["count"], c["unique"], c["top"], c["freq"]) == (4, 2, "x", 2)
    nulls = {r["column"]: r["nulls"] for r in PR.profile_columns(df).collect()}
    assert nulls == {"n": 1, "s": 1}
