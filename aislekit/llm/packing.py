"""Packing: first-fit decreasing over a tournament tree of bin capacities, run in randomised groups.

A document's ids (its tokens and an end id) are cut into pieces of at most ``capacity`` ids; the pieces are
spread at random over groups of about ``group_pieces`` and every group is packed on its own: longest piece first,
each into the first sequence that has room.  The tree holds the largest room below each node, so the first sequence with
room is found in one walk from the root.

Nulls and ties: a null text counts as empty and has its end id alone; rows without doc_id are packed as
well; pieces of equal length are taken in order of doc_id, start and checksum; repeated rows are packed one by one;
an empty table gives an empty result.  Other columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common
from .common import doc_key, id_text, tidy, with_id
from .tokens import codec


@dataclass(frozen=True)
class PackingPlan:
    tokenizer: str  #: path of the tokenizer's file, the same on every machine
    end_id: int = 2
    capacity: int = 4096
    group_pieces: int = 4096
    seed: int = 7


class Rooms:
    """Tournament tree over the room left in sequences 0, 1, ...; all are empty at first."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Takes ``size`` from the first sequence with that much room; (sequence, room it had)."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        sequence, had = node - self.leaves, room[node]
        room[node] = had - size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return sequence, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each size; ``sizes`` come longest first."""
    rooms = Rooms(len(sizes), capacity)
    return [(s, capacity - had) for s, had in map(rooms.put, sizes)]


def pieces(docs: DataFrame, plan: PackingPlan) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of every whole text."""
    end = np.array([plan.end_id], "<u4").tobytes()
    width = 4 * plan.capacity

    @tidy
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = codec(plan.tokenizer)
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at:at + 1024]
                out: list[tuple] = []
                for doc_id, ids in zip(part["doc_id"], encoder.encode(part["text"].tolist()), strict=True):
                    ids += end
                    out += [(doc_id, i // 4, min(width, len(ids) - i) // 4, zlib.crc32(ids[i:i + width]), len(ids) // 4)
                            for i in range(0, len(ids), width)]
                yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return with_id(docs.select(id_text().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        cut, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"))


def pack(docs: DataFrame, plan: PackingPlan) -> DataFrame:
    """The pieces with sequence_id and offset."""
    table = cut_lineage(pieces(docs, plan))
    groups = max(1, round(table.count() / plan.group_pieces))
    # the table is kept, so a repeated task draws the same groups
    table = table.withColumns({"_group": F.floor(F.rand(plan.seed) * groups).cast("long"), "_key": doc_key(table), "doc_id": id_text()})

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_key", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = first_fit_decreasing(frame["length"].tolist(), plan.capacity)
        number = int(frame["_group"].iloc[0]) << 32
        return frame.drop(columns=["_group", "_key"]).assign(sequence_id=[number + s for s, _ in placed], offset=[o for _, o in placed])

    return with_id(table.groupBy("_group").applyInPandas(
        packed, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), PackingPlan(public_tokenizers.path("word_bpe_49k.json")))
