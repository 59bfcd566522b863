"""Table profiling.

Quantiles are exact with pandas' linear interpolation and neither sort nor gather a column: radix selection
(:func:`selection.ranked_values`) finds the values of the wanted ranks in four rounds of counts; ``columns x quantiles x 2``
of them reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import selection as S

QUANTILES = (0.25, 0.5, 0.75)  # fixed: pandas describe() default percentiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long_values(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """Unpivot ``cols`` into (column, v) rows (``stack`` is a narrow generator)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("v")) for c in cols])).alias("_s")
    ).select("_s.column", "_s.v")


def first_rows(df: DataFrame, order_cols: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in an explicit order (a bounded top-k)."""
    return df.orderBy(*order_cols).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row ``n_rows, n_columns``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_info(df: DataFrame) -> DataFrame:
    """Column, dtype, non-null count (one aggregate pass, then unpivot)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    dtypes = dict(df.dtypes)
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                 F.col(c).cast("long").alias("non_null")) for i, c in enumerate(df.columns)])).alias("s")
    ).select("s.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """P2 + P3 + P6 in one aggregate pass: position, column, dtype, non_null, nulls, n_rows."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(F.col(c)).alias(f"_c{i}"))
    row = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                 F.col(f"_c{i}").alias("non_null"), (F.col("_n") - F.col(f"_c{i}")).alias("nulls"),
                 F.col("_n").alias("n_rows"))
        for i, c in enumerate(df.columns)])).alias("s")).select("s.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Column, number of NULLs."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("nulls"))
        for c in df.columns])).alias("s")).select("s.*")


def _finite(c: str):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _quantiles(df: DataFrame, sizes: dict[str, int], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """{(column, q): value} with linear interpolation at position (n - 1) * q of n values."""
    places = {(c, float(q)): (n - 1) * float(q) for c, n in sizes.items() if n for q in probs}
    wanted = {c: sorted({r for (d, _), h in places.items() if d == c for r in (math.floor(h), math.ceil(h))}) for c, n in sizes.items() if n}
    value = S.ranked_values(df, wanted) if wanted else {}
    out = {}
    for (c, q), h in places.items():
        low, high = value[c, math.floor(h)], value[c, math.ceil(h)]
        out[c, q] = low + (h - math.floor(h)) * (high - low) if high != low else low
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUANTILES) -> DataFrame:
    """(column, q, value) with linear interpolation at position (n - 1) * q."""
    counts = df.agg(*[F.count(_finite(c)).alias(c) for c in cols]).first()
    found = _quantiles(df, {c: counts[c] for c in cols}, probs)
    return df.sparkSession.createDataFrame([(c, q, v) for (c, q), v in found.items()], "column string, q double, value double")


_DESCRIBED = "column string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"


def _described(df: DataFrame, cols: Sequence[str]) -> list[tuple]:
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(_finite(c)).alias(f"{s}_{i}") for i, c in enumerate(cols) for s, f in stats.items()]).first()
    at = {c: {s: row[f"{s}_{i}"] for s in stats} for i, c in enumerate(cols)}
    q = _quantiles(df, {c: at[c]["count"] for c in cols}, QUANTILES)
    return [(c, at[c]["count"], at[c]["mean"], at[c]["std"], at[c]["min"], *(q.get((c, p)) for p in QUANTILES), at[c]["max"])
            for c in cols if at[c]["count"]]


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column, count, mean, std, min, p25, p50, p75, max (pandas ``describe``); a row for each column with values."""
    return df.sparkSession.createDataFrame(_described(df, list(cols or numeric_columns(df))), _DESCRIBED)


def describe_tables(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """P4 for several tables: ``tbl`` + the :func:`describe_numeric` columns."""
    rows = [(name, *row) for name, (df, cols) in tables.items() for row in _described(df, cols)]
    spark = next(iter(tables.values()))[0].sparkSession
    return spark.createDataFrame(rows, f"tbl string, {_DESCRIBED}")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: column, count, unique, top, freq (top ties -> smallest value)."""
    cols = list(cols or string_columns(df))
    per_value = (_long_values(df, cols, "string").where(F.col("v").isNotNull())
                 .groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt")))
    return per_value.groupBy("column").agg(
        F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct((-F.col("cnt")).alias("c"), F.col("v"))).alias("top"),
        F.max("cnt").alias("freq"))
