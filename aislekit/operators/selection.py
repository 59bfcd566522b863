"""Values of wanted ranks without sorting: radix selection in rounds.

Each round counts the next leading bits of an order-preserving image of the values, among those that share the leading
bits found so far, and keeps for every wanted rank the bin that holds it.  Counts are partial in the tasks, so a round
shuffles bins, not rows; what reaches the driver is one row for each wanted rank.

* :func:`ranked_values`: columns of numbers, through the 64-bit image of their doubles, 16 bits a round;
* :func:`quota_thresholds`: for each class the quota-th smallest of whole numbers, in JVM expressions, for any number of classes.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small

BITS = 16
_BINS = "column string, prefix long, bin int, n long"


def image(values: np.ndarray) -> np.ndarray:
    """64-bit whole numbers in the order of the doubles; -0.0 counts as 0.0."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def ranked_values(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} of 0-based ranks in columns of ``df``, as doubles; nulls and NaN do not count."""
    # (column, rank) -> leading bits so far, rank among those that have them
    at = {(c, r): (0, r) for c, ranks in wanted.items() for r in ranks}
    spark, columns = df.sparkSession, list(wanted)
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for done in range(0, 64, BITS):
        sent = spark.sparkContext.broadcast({c: sorted({p for (d, _), (p, _) in at.items() if d == c}) for c in wanted})

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                for name, column in zip(columns, batch.columns, strict=True):
                    known = column.drop_null().to_numpy(zero_copy_only=False)
                    mine = image(known[~np.isnan(known)])
                    lead = mine >> np.uint64(64 - done) if done else np.zeros(len(mine), np.uint64)
                    bins = ((mine >> np.uint64(64 - BITS - done)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    for prefix in sent.value.get(name, ()):
                        held = sums.setdefault((name, prefix), np.zeros(1 << BITS, np.int64))
                        held += np.bincount(bins[lead == np.uint64(prefix)], minlength=1 << BITS)
            for (name, prefix), held in sums.items():
                full = np.flatnonzero(held)
                signed = prefix - (1 << 64) if prefix >> 63 else prefix
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(full), pa.string()), pa.array(np.full(len(full), signed), pa.int64()),
                     pa.array(full.astype(np.int32)), pa.array(held[full])], names=["column", "prefix", "bin", "n"])

        bins = doubles.mapInArrow(counted, _BINS).groupBy("column", "prefix", "bin").agg(F.sum("n").alias("n"))
        ranks = spark.createDataFrame([(c, r, p, q) for (c, r), (p, q) in at.items()], "column string, rank long, prefix long, place long")
        run = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("bin"))  # at most 2^16 bins
        hit = bins.withColumn("upto", run).join(F.broadcast(ranks), ["column", "prefix"]).where(
            (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        for r in hit.select("column", "rank", "prefix", "bin", (F.col("place") - F.col("upto") + F.col("n")).alias("left")).collect():
            at[r["column"], r["rank"]] = ((r["prefix"] << BITS) | r["bin"], r["left"])
        sent.unpersist()
    return {k: value_of(p) for k, (p, _) in at.items()}


#: Bits of each round: few in the first one, which counts all rows.
ROUNDS = (12, 16, 16, 16)


def quota_thresholds(rows: DataFrame, quotas: DataFrame, label: str, key: str, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """``label, threshold, left``: the ``quota``-th smallest whole number ``key`` of each class with a quota of 1 or more, and
    how many rows with just that key belong to the quota.  ``quotas`` has ``label, quota``, a row for each class."""
    state = quotas.where("quota > 0").select(label, F.lit(0).cast("long").alias("threshold"), F.col("quota").cast("long").alias("left"))
    shift = sum(rounds)
    for bits in rounds:
        shift -= bits
        state = cut_lineage(state)
        digit: Column = F.shiftright(key, shift).bitwiseAND((1 << bits) - 1)
        lead = F.shiftright(key, shift + bits)
        bins = (rows.join(small(state.select(label, "threshold")), label).where(lead == F.col("threshold"))
                .groupBy(label, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")))
        run = F.sum("n").over(Window.partitionBy(label).orderBy("digit"))  # at most 2^bits digits
        found = bins.withColumn("upto", run).join(state, label).where(
            (F.col("left") <= F.col("upto")) & (F.col("left") > F.col("upto") - F.col("n")))
        state = found.select(label, (F.shiftleft("threshold", bits) + F.col("digit")).alias("threshold"),
                             (F.col("left") - F.col("upto") + F.col("n")).alias("left"))
    return cut_lineage(state)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library
