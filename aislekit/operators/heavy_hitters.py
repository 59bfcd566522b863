"""Most frequent values of a stream by mergeable Misra-Gries summaries.

A summary of capacity c holds at most c values with lower bounds of their counts and one number ``err``: every value's true
count lies between its bound (0 if it is not held) and bound + err.  When it is full, the (c+1)-th largest bound is taken
from all and added to ``err``, so err <= rows / (c + 1).  Summaries add up, so each task makes one and they are merged in a
tree; what is shuffled depends on capacity and number of tasks, not on how many distinct values there are.

:func:`candidates` gives a superset of the k most frequent values, with all that tie with the k-th: values whose upper
bound reaches the k-th largest lower bound.  It is complete once ``err`` is below that bound; until then the capacity is
doubled and the rows are read again.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY = 1 << 17
FAN_IN = 32


class Summary:
    kind, arrow = "string", pa.string()

    def __init__(self, capacity: int) -> None:
        self.capacity, self.err = capacity, 0
        self.counts: dict[str, int] = {}

    def found(self, counts: pa.StructArray) -> None:
        """Adds Arrow's counts of values."""
        self.add(counts.field("values").to_pylist(), counts.field("counts").to_pylist())

    def add(self, values: list[str], counts: list[int]) -> None:
        held = self.counts
        get = held.get
        for v, n in zip(values, counts, strict=True):
            held[v] = get(v, 0) + n
        if len(held) > 2 * self.capacity:
            self.prune()

    def merge(self, values: list[str], counts: list[int], err: int) -> None:
        self.err += err
        self.add(values, counts)

    def prune(self) -> None:
        """At most ``capacity`` values stay."""
        if len(self.counts) <= self.capacity:
            return
        bounds = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        cut = int(np.partition(bounds, len(bounds) - self.capacity - 1)[len(bounds) - self.capacity - 1])
        self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
        self.err += cut


    def items(self) -> tuple[list, list[int]]:
        return list(self.counts), list(self.counts.values())


class Numbers:
    """A :class:`Summary` of whole numbers, in numpy: what comes in waits until there is ``capacity`` of it."""

    kind, arrow = "long", pa.int64()

    def __init__(self, capacity: int) -> None:
        self.capacity, self.err = capacity, 0
        self.values, self.bounds = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def found(self, counts: pa.StructArray) -> None:
        self.add(counts.field("values").to_numpy(), counts.field("counts").to_numpy())

    def add(self, values, counts) -> None:
        self.waiting.append((np.asarray(values, np.int64), np.asarray(counts, np.int64)))
        if sum(len(v) for v, _ in self.waiting) > self.capacity:
            self.prune()

    def merge(self, values, counts, err: int) -> None:
        self.err += err
        self.add(values, counts)

    def prune(self) -> None:
        """At most ``capacity`` values stay."""
        values = np.concatenate([self.values, *(v for v, _ in self.waiting)])
        bounds = np.concatenate([self.bounds, *(n for _, n in self.waiting)])
        self.waiting = []
        order = np.argsort(values, kind="stable")
        values, bounds = values[order], bounds[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])
        self.values, self.bounds = values[first], np.add.reduceat(bounds, first) if len(first) else bounds
        if len(self.values) > self.capacity:
            place = len(self.bounds) - self.capacity - 1
            cut = int(np.partition(self.bounds, place)[place])
            more = self.bounds > cut
            self.values, self.bounds = self.values[more], self.bounds[more] - cut
            self.err += cut

    def items(self) -> tuple[list, list[int]]:
        self.prune()
        return self.values.tolist(), self.bounds.tolist()


def _row(part: int, s: Summary | Numbers) -> pd.DataFrame:
    s.prune()
    terms, counts = s.items()
    return pd.DataFrame({"part": [part], "terms": [terms], "counts": [counts], "err": [s.err]})


def summarise(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[pa.Array]], capacity: int, of: type = Summary) -> Summary | Numbers:
    """One summary of all values that ``values`` finds in the rows' batches; ``of`` is its class."""
    schema = f"part long, terms array<{of.kind}>, counts array<long>, err long"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = of(capacity)
        for batch in batches:
            for found in values(batch):
                s.found(pc.value_counts(found))
        yield pa.RecordBatch.from_pandas(_row(TaskContext.get().partitionId(), s), preserve_index=False, schema=pa.schema(
            [("part", pa.int64()), ("terms", pa.list_(of.arrow)), ("counts", pa.list_(pa.int64())), ("err", pa.int64())]))

    def several(group: pd.DataFrame) -> pd.DataFrame:
        s = of(capacity)
        for row in group.sort_values("part").itertuples():
            s.merge(list(row.terms), [int(n) for n in row.counts], int(row.err))
        return _row(int(group["part"].min()) // FAN_IN, s)

    parts = cut_lineage(rows.mapInArrow(one, schema))
    most = parts.agg(F.max("part")).first()[0] or 0
    for _ in range(math.ceil(math.log(most + 1, FAN_IN)) if most else 0):
        parts = cut_lineage(parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("g")).applyInPandas(several, schema))
    out = of(capacity)
    for row in parts.collect():  # one row of at most ``capacity`` values; none for no rows
        out.merge(row["terms"], row["counts"], row["err"])
    return out


def candidates(rows: DataFrame, values: Callable[[pa.RecordBatch], Iterator[pa.Array]], k: int, capacity: int = CAPACITY,
               *of: type) -> list:
    """Sorted values among which are the k most frequent and all that tie with the k-th; ``of`` is ``Numbers`` for whole numbers."""
    capacity = max(capacity, k)
    while True:
        s = summarise(rows, values, capacity, *of)
        held, counts = s.items()
        bounds = sorted(counts, reverse=True)
        kth = bounds[k - 1] if len(bounds) >= k else 0
        if s.err == 0 or s.err < kth:
            return sorted(v for v, n in zip(held, counts, strict=True) if n + s.err >= kth)
        capacity *= 2


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library
