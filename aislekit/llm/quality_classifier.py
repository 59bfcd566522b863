"""Quality classifier: supervised subword embeddings (hashed word and character
n-gram vectors averaged per document, softmax output, numpy SGD).  A word bigram counts
where both words are equal.

Training takes a bounded sample of the labelled documents (``TrainingPlan.max_docs``, the
smallest md5 values of doc_id first), whole texts.  Scoring covers every document: the
average of embeddings followed by the linear output equals the average of one number per
feature, so a word adds a fixed sum and a count, which workers keep for words seen.
All character n-grams of every word count, however long the word; long ones are hashed in overlapping pieces.

Nulls and ties: a null or wordless text has no features and gets the score of the output
bias; rows without doc_id are scored and never trained on; repeated rows are scored
alike; labels that are null or not 0/1 are left out; a document with several labels
trains with each.  With no usable label, or only one kind, every score is the
share of label 1 (0.5 if there is none).  Other columns pass through unless they clash
with the names of the result, which replace them.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import crc_fold, tidy

THRESHOLD = 0.3
#: Longer words (texts without spaces) are hashed in pieces of so many characters and are not kept.
LONG_WORD = 200
PIECE = 1 << 16


@dataclass(frozen=True)
class TrainingPlan:
    buckets: int = 1 << 16  #: at most 2^16
    dim: int = 8
    min_gram: int = 3
    max_gram: int = 4
    epochs: int = 4
    rate: float = 0.5
    max_docs: int = 6000
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``value[f]`` is what feature f adds to the logit of label 1, before averaging."""
    value: np.ndarray
    bias: float
    plan: TrainingPlan


def word_features(word: str, plan: TrainingPlan) -> list[int]:
    """Hash buckets of a word: the word itself and its character n-grams with ends marked."""
    raw = f"<{word}>"
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % (plan.buckets - 1) + 1]
    for n in range(plan.min_gram, plan.max_gram + 1):
        found += [zlib.crc32(raw[i:i + n].encode("utf-8", "surrogatepass"), n) % (plan.buckets - 1) + 1
                  for i in range(len(raw) - n + 1)]
    return found


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)


def _gram_buckets(piece: str, n: int, plan: TrainingPlan) -> np.ndarray:
    """Buckets of all n-grams of a piece, as in ``word_features``: crc32 of their UTF-8 bytes."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
    count = max(0, len(codes) - n + 1)
    width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    most = int(width.max(initial=1))
    shift = 6 * (width - 1)
    encoded = [(codes >> shift.astype(np.uint32)) | _LEAD[width]]
    encoded += [(codes >> np.maximum(shift - 6 * k, 0).astype(np.uint32)) & 0x3F | 0x80 for k in range(1, most)]
    crc = np.full(count, n ^ 0xFFFFFFFF, np.uint32)
    for j in range(n):
        for k in range(most):
            step = _CRC[(crc ^ encoded[k][j:j + count]) & 0xFF] ^ (crc >> 8)
            crc = step if most == 1 else np.where(width[j:j + count] > k, step, crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(plan.buckets - 1)).astype(np.int32) + 1


def long_word_features(word: str, plan: TrainingPlan) -> Iterator[np.ndarray]:
    """The same buckets as ``word_features``, piece by piece; pieces overlap by ``max_gram - 1``, each n-gram counts once."""
    yield np.array([zlib.crc32(word.encode("utf-8", "surrogatepass")) % (plan.buckets - 1) + 1], np.int32)
    raw = f"<{word}>"
    for at in range(0, len(raw), PIECE):
        for n in range(plan.min_gram, plan.max_gram + 1):
            yield _gram_buckets(raw[at:at + PIECE + n - 1], n, plan)


def repeats(words: list[str]) -> int:
    """Adjacent equal words.  Every bigram of one word with itself is one feature: bucket 0."""
    return sum(map(operator.eq, words, words[1:]))


def _bag(text: str | None, plan: TrainingPlan, seen: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text (at most 65,536 buckets) and their counts; a longest text's counts are scaled down."""
    ids: list[np.ndarray] = []
    words = (text or "").split()
    long = np.zeros(plan.buckets if any(len(w) > LONG_WORD for w in words) else 0, np.int64)
    for w in words:
        if len(w) > LONG_WORD:
            for part in long_word_features(w, plan):
                long += np.bincount(part, minlength=plan.buckets)
            continue
        if (f := seen.get(w)) is None:
            if len(seen) > 200_000:
                seen.clear()
            f = seen[w] = np.array(word_features(w, plan), np.int32)
        ids.append(f)
    if not words:
        return np.empty(0, np.uint16), np.empty(0, np.uint16)
    ids.append(np.zeros(repeats(words), np.int32))
    found, counts = np.unique(np.concatenate(ids), return_counts=True)
    if len(long):
        long[found] += counts
        found = np.flatnonzero(long)
        counts = long[found]
    counts = np.ceil(counts * min(1, 65535 / counts.max()))  # two bytes each
    return found.astype(np.uint16), counts.astype(np.uint16)


def training_bags(docs: DataFrame, labels: DataFrame, plan: TrainingPlan) -> DataFrame:
    """(label, ids, counts) of a bounded sample of labelled rows outside the held-out fold."""
    usable = (labels.select("doc_id", F.col("quality").cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold(F.col("doc_id")) != 0)))
    order = F.md5(F.concat_ws(":", F.lit(plan.seed), F.col("doc_id").cast("string")).cast("binary"))
    picked = usable.orderBy(order, "doc_id", "label").limit(plan.max_docs)  # TakeOrderedAndProject
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    @tidy
    def bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for frame in frames:
            for part in range(0, len(frame), 256):
                rows = frame.iloc[part:part + 256]
                made = [_bag(t, plan, seen) for t in rows["text"]]
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "label": rows["label"].to_numpy(),
                                    "ids": [a.tobytes() for a, _ in made], "counts": [b.tobytes() for _, b in made]})

    return texts.mapInPandas(bags, "doc_id long, label int, ids binary, counts binary")


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], plan: TrainingPlan) -> Model:
    """SGD over single documents; both classes weigh the same in total."""
    positives = sum(y for y, _, _ in bags)
    if not bags or positives in (0, len(bags)):
        share = positives / len(bags) if bags else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(plan.buckets), math.log(share / (1 - share)), plan)
    rng = np.random.default_rng(plan.seed)
    emb = rng.uniform(-1 / plan.dim, 1 / plan.dim, (plan.buckets, plan.dim))
    out = np.zeros((2, plan.dim))
    bias = np.zeros(2)
    # the square root of the inverse frequency: rare labels count more, yet do not dominate
    weight = [math.sqrt(len(bags) / (2 * (len(bags) - positives))), math.sqrt(len(bags) / (2 * positives))]
    steps, done = plan.epochs * len(bags), 0
    for _ in range(plan.epochs):
        for i in rng.permutation(len(bags)):
            y, ids, counts = bags[i]
            w = counts / max(1, counts.sum())
            rate = plan.rate * (1 - done / steps)
            done += 1
            hidden = w @ emb[ids] if len(ids) else np.zeros(plan.dim)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y] * rate
            back = p @ out
            out -= np.outer(p, hidden)
            bias -= p
            if len(ids):
                # an average moves little where it has many terms, so their step is longer
                emb[ids] -= np.outer(w, back) * min(len(ids), 64)
    return Model(emb @ (out[1] - out[0]), float(bias[1] - bias[0]), plan)


def train(docs: DataFrame, labels: DataFrame, plan: TrainingPlan = TrainingPlan()) -> Model:
    """Learn from the labelled rows whose fold is not held out; at most ``max_docs`` reach the driver."""
    rows = training_bags(docs, labels, plan).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["ids"])))
    return fit([(r["label"], np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["counts"], np.uint16))
                for r in rows], plan)


class _Words(dict):
    """word -> (sum of its features' values) + 1j * (number of features); bounded."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit, self.value = model, limit, model.value.tolist()

    def __missing__(self, word: str) -> complex:
        if len(word) > LONG_WORD:
            parts = [complex(self.model.value[ids].sum(), len(ids)) for ids in long_word_features(word, self.model.plan)]
            return sum(parts, 0j)
        ids = word_features(word, self.model.plan)
        value = self.value
        if len(self) >= self.limit:
            self.clear()
        made = self[word] = complex(sum([value[i] for i in ids]), len(ids))
        return made


def score_text(text: str | None, words: _Words) -> float:
    found = text.split() if text else []
    again = repeats(found)
    total = sum(map(words.__getitem__, found), complex(again * words.value[0], again))
    z = words.model.bias + (total.real / total.imag if total.imag else 0.0)
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def score(spark: SparkSession, docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row.  The model (at most ``buckets`` numbers)
    is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words(shared.value)
        yield from tidy(lambda parts: (pd.Series([score_text(t, words) for t in texts], dtype="float64") for texts in parts))(parts)

    return docs.withColumn(column, scored(F.col("text")))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, plan: TrainingPlan = TrainingPlan(),
             threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    scored = score(spark, docs, train(docs, labels, plan))
    return scored.withColumns({
        "held_out": F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)),
        "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return classify(spark, docs, common.labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
