"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release  # noqa: F401  (used by the operators as ``common.release``)

#: Separators of words everywhere in this subpackage: space, \t, \n, \v, \f, \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
#: Text bytes that one task of a range-partitioned pass over documents should get.
BUCKET_BYTES = 16 << 20
#: Ranges of doc_ids, of which the driver and every task know the bounds.
MAX_RANGES = 1 << 15


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_fold(doc_id: Column) -> Column:
    """crc32(doc_id as decimal text) mod 5; 0 marks the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _numbers(values: list[int]) -> Column:
    """An array<bigint> that Spark folds into one constant, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at_most(bounds: list[int], value: Column) -> Column:
    """How many of the sorted ``bounds`` are <= value, in two short scans per row."""
    step = max(1, math.isqrt(len(bounds)))
    every, coarse = _numbers(bounds), _numbers(bounds[::step])
    block = F.size(F.filter(coarse, lambda b: b <= value))
    start = F.greatest(block - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(every, start + 1, step), lambda b: b <= value))
    return F.when(block == 0, 0).otherwise(start + fine)


def id_text(doc_id: Column | str = "doc_id") -> Column:
    """doc_id as it goes through Python: pandas turns whole numbers beside a null into doubles, text stays as it is."""
    return F.col(doc_id).cast("long").cast("string") if isinstance(doc_id, str) else doc_id.cast("long").cast("string")


def with_id(df: DataFrame) -> DataFrame:
    """``doc_id`` as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


#: Where rows without a doc_id stand in ascending order: last.
NULL_KEY = (1 << 63) - 1


def doc_key(docs: DataFrame) -> Column:
    """The place of a row in ascending doc_id order."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY))


def key_bounds(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> list[int]:
    """First keys of consecutive doc_id ranges with about ``bucket_bytes`` of text each.

    Quantiles only say where the ranges lie (they are doubles, which from 2^53 on name other ids); a bound is the exact
    smallest key of its range, so every bound occurs, no range is empty and the first document of a range is its bound.  At most
    ``MAX_RANGES`` numbers reach the driver: beyond, ranges are larger, and tasks that stream through them longer.
    """
    keys = docs.select(doc_key(docs).alias("k"))
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not rows:
        return []
    n = min(MAX_RANGES, max(1, math.ceil((total or 0) / bucket_bytes)))
    cuts = F.percentile_approx("k", [i / n for i in range(n)], 100 * n)
    low, found = keys.agg(F.min("k"), cuts).first()
    ranges = sorted({low, *(max(low, min(int(c), NULL_KEY)) for c in found)})
    return sorted(r["k"] for r in keys.groupBy(_at_most(ranges, F.col("k"))).agg(F.min("k").alias("k")).collect())


def with_bucket(docs: DataFrame, bounds: list[int], borrow: bool = False) -> DataFrame:
    """Adds ``_key`` and ``_bucket``, the number of the doc_id range.

    With ``borrow`` the first document of each range is also sent, marked
    ``_lent``, to the range before it (that of the first range to the last), so that
    every document meets its successor in one task.
    """
    key = doc_key(docs)
    df = docs.withColumns({"_key": key, "_bucket": F.lit(0)}) if not bounds else \
        docs.withColumns({"_key": key, "_bucket": _at_most(bounds, key) - 1})
    if not borrow:
        return df
    n = max(1, len(bounds))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("l"))
    lent = F.struct(F.pmod(F.col("_bucket") - 1, F.lit(n)).cast("int").alias("b"), F.lit(True).alias("l"))
    is_first = F.get(_numbers(bounds), F.col("_bucket")) == F.col("_key") if bounds else F.lit(False)
    df = df.withColumn("_to", F.explode(F.when(is_first, F.array(own, lent)).otherwise(F.array(own))))
    return df.withColumns({"_bucket": F.col("_to.b"), "_lent": F.col("_to.l")}).drop("_to")


def bitmap_slot(doc_id: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << bits))


def bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of ``doc_id``: 2^bits bits, whatever the number of ids.  It only keeps most of
    the other rows out of a shuffle, before an exact join."""
    words = ids.select(bitmap_slot(F.col("doc_id"), bits).alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m")).collect()
    out = np.zeros(1 << (bits - 5), np.uint32)
    for r in words:
        out[r["w"]] = r["m"]
    return out


def in_bitmap(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def tidy(function):
    """For a function over a partition's frames: at its end, what it has freed goes back to the system,
    since the worker lives on beside those of other tasks."""
    @functools.wraps(function)
    def run(frames: Iterator) -> Iterator:
        try:
            yield from function(frames)
        finally:
            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run
