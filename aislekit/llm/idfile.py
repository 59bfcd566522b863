"""Token-id output in Simple-8b: word-aligned packing of ids into 64-bit words.

The top four bits of a word select how many ids it holds and how many bits each has; selector 0
announces an escape: the next word is one value as it is.  A file is a Parquet table of blocks, one row for a run of
whole documents in ascending doc_id order, with the documents' ids and lengths, the words, and
every ``RUN`` values the number of words before them: no word crosses such a place, so that a reader can start
there.  All words of a block are decoded at once, selector by selector.

``write_ids`` sends each doc_id range to one task, which encodes its texts in order; ``read_ids``
decodes the blocks.  Spark's writer commits the files, so a lost executor leaves no half-written part.

Nulls and ties: a null text counts as empty and has its end id alone; rows without doc_id come last;
rows with one doc_id come in order of text; repeated rows are written one by one; an empty table gives a file
without blocks and an empty result.  Other columns are not written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import common
from .common import id_text, key_bounds, tidy, with_bucket, with_id
from .tokens import codec

# Fixed values of the format: values in a word and bits of each, by selector (0: escape, 1: not used).
COUNTS = (1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
RUN = 1024
BLOCK_IDS = 1 << 18  #: of a row, or one document
_SELECTOR = {c: s for s, c in enumerate(COUNTS) if s > 1}


_BIT_LENGTHS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, as uint8."""
    if not (values >> np.uint64(16)).any():
        return _BIT_LENGTHS[values]
    bits = np.zeros(len(values), np.uint8)
    rest = values.copy()
    for step in (32, 16):
        high = rest >> np.uint64(step)
        more = high > 0
        bits[more] += step
        rest = np.where(more, high, rest)
    return bits + _BIT_LENGTHS[rest]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the number of words before every ``RUN``-th value."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    need = _bit_lengths(values)
    take = np.ones(n, np.uint8)
    widest, reach = need.copy(), 1
    room = (RUN - np.arange(n, dtype=np.uint32) % RUN).astype(np.uint16)  # values up to the end of a run
    for selector in range(len(COUNTS) - 2, 1, -1):  # from 2 values a word to 60
        count = COUNTS[selector]
        if count > n:
            break
        while reach < count:  # the largest need of the next ``count`` values
            widest = np.maximum(widest[:-1], need[reach:])
            reach += 1
        fits = widest <= BITS[selector]
        if not fits.any():  # nor do more values in fewer bits
            break
        fits &= room[:len(fits)] >= count
        np.copyto(take[:len(fits)], count, where=fits)
    # all runs step from word to word together
    is_first = np.zeros(n, bool)
    at = np.arange(0, n, RUN)
    ends = np.minimum(at + RUN, n)
    while len(at):
        is_first[at] = True
        at = at + take[at]
        inside = at < ends
        if not inside.all():
            at, ends = at[inside], ends[inside]
    first = np.flatnonzero(is_first)
    counts = take[first]
    escaped = need[first] > 60  # such a value stands alone, in the word after its selector
    place = np.arange(len(first)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(first) + int(escaped.sum()), np.uint64)
    for count, selector in _SELECTOR.items():
        rows = np.flatnonzero((counts == count) & ~escaped)
        if len(rows):
            word = np.full(len(rows), selector << 60, np.uint64)
            at = first[rows]
            for i in range(count):
                word |= values[at + i] << np.uint64(i * BITS[selector])
            words[place[rows]] = word
    words[place[escaped] + 1] = values[first[escaped]]
    return words, place[np.searchsorted(first, np.arange(0, n, RUN))].astype(np.uint64)


def decode(words: np.ndarray) -> np.ndarray:
    """All values of the words, selector by selector."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):  # escapes; the word after one is a value
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.array(COUNTS)[selector]
    counts[raw] = 1
    counts[(selector == 0) & ~raw] = 0
    start = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in range(2, len(COUNTS)):
        rows = np.flatnonzero((selector == s) & ~raw)
        if len(rows):
            mask = np.uint64((1 << BITS[s]) - 1)
            word, at = words[rows], start[rows]
            for i in range(COUNTS[s]):
                out[at + i] = (word >> np.uint64(i * BITS[s])) & mask
    out[start[raw]] = words[raw]
    return out


BLOCK_SCHEMA = ("bucket int, block int, n_ids long, doc_ids array<long>, lengths array<long>, words binary, "
                "words_before binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every whole text in ascending doc_id order, with ``end_id`` after each, into a file at ``path``."""
    bounds = key_bounds(docs)
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = codec(tokenizer)
        held: list[tuple[str | None, bytes]] = []
        bucket, number, size = None, 0, 0

        def closed() -> pd.DataFrame:
            values = np.frombuffer(b"".join(ids for _, ids in held), "<u4")
            words, before = encode(values.astype(np.uint64))
            row = (bucket, number, len(values), [d for d, _ in held], [len(ids) // 4 for _, ids in held],
                   words.astype("<u8").tobytes(), before.astype("<u8").tobytes())
            return pd.DataFrame([row], columns=["bucket", "block", "n_ids", "doc_ids", "lengths", "words", "words_before"])

        for frame in frames:
            for at in range(0, len(frame), 2048):
                part = frame.iloc[at:at + 2048]
                for b, doc_id, ids in zip(part["_bucket"].tolist(), part["doc_id"].tolist(), encoder.encode(part["text"].tolist()), strict=True):
                    if held and (b != bucket or size >= BLOCK_IDS):
                        yield closed()
                        number, size = (number + 1 if b == bucket else 0), 0
                        held.clear()
                    bucket = b
                    held.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
        if held:
            yield closed()

    one = docs.select(id_text().alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = with_bucket(one, bounds).repartitionById(max(1, len(bounds)), F.col("_bucket"))
    ordered = ranged.sortWithinPartitions("_bucket", "_key", "text").select("doc_id", "text", "_bucket")
    made = ordered.mapInPandas(blocks, BLOCK_SCHEMA.replace("doc_ids array<long>", "doc_ids array<string>"))
    made.withColumn("doc_ids", F.col("doc_ids").cast("array<bigint>")).write.mode("overwrite").option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a file, from its decoded ids."""
    file = spark.read.parquet(path)
    # ids before each block: of the ranges before it, and of the blocks before it in its range
    ranges = file.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # one row for each range of doc_ids
    ranges = ranges.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("_ranges"))
    inside = Window.partitionBy("bucket").orderBy("block")
    index = file.select("bucket", "block", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("_blocks"))
    index = index.join(ranges, "bucket").select("bucket", "block", (F.col("_ranges") + F.col("_blocks")).alias("before"))

    @tidy
    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ids = decode(np.frombuffer(row.words, "<u8")).astype("<u4")
                lengths = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                yield pd.DataFrame({
                    "bucket": row.bucket, "block": row.block, "doc_id": row.doc_ids,
                    "_at": ends - lengths, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, lengths, strict=True)]})

    found = file.select("bucket", "block", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "lengths", "words").mapInPandas(
        documents, "bucket int, block int, doc_id string, _at long, n_tokens long, ids_crc32 long")
    return with_id(found).join(index, ["bucket", "block"]).select(
        "doc_id", (F.col("before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{ensure_checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path)
