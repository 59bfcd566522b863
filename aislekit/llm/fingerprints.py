"""Document fingerprints: MinHash over word shingles, and near-duplicates from bands of its values.

A fingerprint holds the smallest of each of ``permutations`` universal hashes (a * x + b mod 2^64, upper
bits) over a text's shingles of five words, all in vectorised numpy.  It keeps 16 bits of each: equal
sets have equal fingerprints, and the share of equal values estimates the Jaccard similarity.

``near_duplicates`` joins bands of a fingerprint in Spark (documents that agree in a whole band) and verifies the Jaccard
similarity of the shingle sets: each document against the first of its band, then against those that a shared rare shingle leaves.

An edited text, as ``edited_pairs`` makes it, is the text with its last quarter replaced by the
start of the next document.  Its shingles inside the kept part are the text's own, so only the others are
hashed anew.

Nulls and ties: a null text counts as empty; texts without words have the fingerprint of the empty set and are like
each other (1.0), but no near-duplicates; rows without doc_id come last in the order; rows with one doc_id
come in order of text; repeated rows are kept; an empty table gives an empty result; other
columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common
from .common import id_text, key_bounds, tidy, with_bucket, with_id
from .components import components
from .words import constants, shingle_hashes, shingle_set, word_hashes


@dataclass(frozen=True)
class MinHashPlan:
    permutations: int = 128
    shingle: int = 5
    band: int = 4  #: values of a band; 32 bands of 4 miss a pair of similarity 0.8 once in 10^7
    similarity: float = 0.8
    seed: int = 11


class MinHash:
    def __init__(self, plan: MinHashPlan = MinHashPlan()):
        self.plan = plan
        self.a = constants(plan.seed, plan.permutations) | np.uint64(1)
        self.b = constants(plan.seed + 1, plan.permutations)
        self.none = np.full(plan.permutations, (1 << 64) - 1, np.uint64)

    def lows(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest value of each permutation, 64 bits wide."""
        low = self.none
        for at in range(0, len(shingles), 512):
            part = shingles[at:at + 512]
            low = np.minimum(low, (part[:, None] * self.a + self.b).min(axis=0))
        return low

    @staticmethod
    def short(lows: np.ndarray) -> np.ndarray:
        """16 bits of each value: of its middle, as the upper ones of a smallest value are mostly 0."""
        return (lows >> np.uint64(8)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x == y))


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def fingerprint(text: str | None, minhash: MinHash) -> np.ndarray:
    return minhash.lows(shingle_hashes(word_hashes(_encoded(text or "")), minhash.plan.shingle))


def edit(text: str, following: str) -> tuple[str, int]:
    """The edited text, and how many code points of ``text`` it keeps."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut], len(text) - cut


def both_fingerprints(text: str, following: str, minhash: MinHash) -> tuple[np.ndarray, np.ndarray, str]:
    """64-bit values of a text and of its edited text, and the edited text."""
    k = minhash.plan.shingle
    edited, kept = edit(text, following)
    words = word_hashes(_encoded(text))
    head = text[:kept]
    # words that end before the last gap of the kept part are in both texts
    same = max(head.rfind(" "), head.rfind("\n")) + 1
    n_same = len(word_hashes(_encoded(head[:same])))
    changed = np.concatenate([words[:n_same][-(k - 1):], word_hashes(_encoded(edited[same:]))])
    own = shingle_hashes(words, k)
    if n_same < k or len(words) < k or n_same + len(changed) - min(n_same, k - 1) < k:
        return minhash.lows(own), fingerprint(edited, minhash), edited
    shared = minhash.lows(own[:n_same - k + 1])
    rest = minhash.lows(own[n_same - k + 1:])
    new = minhash.lows(shingle_hashes(changed, k)) if len(changed) >= k else minhash.none
    return np.minimum(shared, rest), np.minimum(shared, new), edited


def edited_pairs(docs: DataFrame, plan: MinHashPlan = MinHashPlan()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every text.

    Documents are partitioned by ranges of doc_id; the first of a range also goes to the range before it.
    """
    bounds = key_bounds(docs)

    @tidy
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = MinHash(plan)
        # the document that waits for the next one: bucket, lent, doc_id, text
        held: tuple | None = None
        waiting: tuple | None = None  # a finished row that lacks only the next fingerprint
        out: list[tuple] = []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def finish(row: tuple, own: np.ndarray, following: np.ndarray) -> None:
            out.append((*row, likeness(own, following)))

        for frame in frames:
            for b, lent, doc_id, text in zip(frame["_bucket"].tolist(), frame["_lent"].tolist(), frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                if held is not None and held[0] == b and not held[1]:
                    own, changed, edited = both_fingerprints(held[3], text or "", minhash)
                    own, changed = minhash.short(own), minhash.short(changed)
                    if waiting is not None:
                        finish(*waiting, own)
                    row = (held[2], len(held[3]), sha256(_encoded(edited)).hexdigest(),
                           own.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(own, changed))
                    waiting = (row, own)
                    if lent:
                        finish(*waiting, minhash.short(fingerprint(text, minhash)))
                        waiting = None
                elif held is not None and not held[1]:
                    raise ValueError("a range of doc_ids ends without the document after it")
                held = (b, lent, doc_id, text or "")
                if len(out) >= 512:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        if waiting is not None or held is not None and not held[1]:
            raise ValueError("a range of doc_ids ends without the document after it")
        if out:
            yield pd.DataFrame(out, columns=names)

    one = docs.select(id_text().alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = with_bucket(one, bounds, borrow=True).repartitionById(max(1, len(bounds)), F.col("_bucket"))
    ordered = ranged.sortWithinPartitions("_bucket", "_lent", "_key", "text").select("doc_id", "text", "_bucket", "_lent")
    return with_id(ordered.mapInPandas(rows, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, "
                                             "edited_fingerprint string, near_edited double, near_next double"))


def _verified(pairs: DataFrame, sets: DataFrame, plan: MinHashPlan) -> DataFrame:
    """(doc_id, other_id, similarity) of the pairs whose shingle sets are as similar as wanted."""
    left = sets.select("doc_id", F.col("shingles").alias("a"))
    right = sets.select(F.col("doc_id").alias("other_id"), F.col("shingles").alias("b"))

    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> float:
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common_n = len(np.intersect1d(a, b, assume_unique=True))
            return common_n / max(1, len(a) + len(b) - common_n)
        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return cut_lineage(pairs.join(left, "doc_id").join(right, "other_id").select(
        "doc_id", "other_id", jaccard("a", "b").alias("similarity")).where(F.col("similarity") >= plan.similarity))


def _candidates(sets: DataFrame, plan: MinHashPlan) -> DataFrame:
    """(doc_id, other_id): every pair of ``sets`` (doc_id, component, n, shingles) of different components that can be similar.

    Shingles are ordered by how many of the sets have them, rarest first.  The first shingle that a similar pair shares
    lies among the first n - t n + 1 of the larger set and the first n - 2 t / (1 + t) n + 1 of the smaller
    one, and enough of both sets follows it.  So nothing is missed, and shingles of a template, which stand last, bring no
    pairs together but those with enough of them.
    """
    t, few = plan.similarity, 1e-9

    @tidy
    def exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, component, n, raw in zip(frame["doc_id"], frame["component"], frame["n"], frame["shingles"], strict=True):
                yield pd.DataFrame({"doc_id": doc_id, "component": component, "n": n, "shingle": np.frombuffer(raw, np.int64)})

    rows = cut_lineage(sets.mapInPandas(exploded, "doc_id long, component long, n long, shingle long"))
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(counts, "shingle").withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "shingle")))
    ranked = ranked.where((F.col("df") > 1) & (F.col("pos") <= F.col("n") - F.ceil(t * F.col("n") - few) + 1))
    large = cut_lineage(ranked.select("shingle", "doc_id", "component", "n", "pos"))
    small = large.where(F.col("pos") <= F.col("n") - F.ceil(2 * t / (1 + t) * F.col("n") - few) + 1).select(
        "shingle", F.col("doc_id").alias("other_id"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"))
    rest = 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    able = (F.col("component") != F.col("other")) & (F.col("m") >= t * F.col("n") - few) & (
        (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other_id") < F.col("doc_id")))) & (
        rest >= t / (1 + t) * (F.col("n") + F.col("m")) - few)
    pairs = large.join(small, "shingle").where(able)
    return pairs.select(F.greatest("doc_id", "other_id").alias("doc_id"), F.least("doc_id", "other_id").alias("other_id")).distinct()


def near_duplicates(docs: DataFrame, plan: MinHashPlan = MinHashPlan()) -> DataFrame:
    """(doc_id, other_id, similarity): verified links, doc_id the larger; every pair that shares a band and is as similar as wanted
    is joined through them, directly or by others.

    1. Equal shingle sets are one: each document is linked with the smallest doc_id of its set, and that goes on.
    2. Each member of a band is compared with the band's smallest doc_id, also in bands of two and four times as many
       values, where unrelated texts of one template seldom meet.  A band of n documents makes n - 1 pairs.
    3. Where the members of a band are not all in one component of these links, they are compared with
       those of other components (``_candidates``): the smallest may be like none of two that are like each other.

    Bands are counted before the join (map-side), which finds a band's smallest doc_id without gathering its members.
    Of several rows with one doc_id the first in order of text counts.
    """
    @tidy
    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                shingles = shingle_set(_encoded(text or ""), plan.shingle)
                if len(shingles):
                    raw = shingles.tobytes()
                    out.append((doc_id, sha256(raw).digest(), len(shingles), raw))
            yield pd.DataFrame(out, columns=["doc_id", "set", "n", "shingles"])

    @tidy
    def banded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = MinHash(plan)
        for frame in frames:
            out = []
            for doc_id, raw in zip(frame["doc_id"], frame["shingles"], strict=True):
                lows = minhash.lows(np.frombuffer(raw, np.uint64))
                for width in (plan.band, 2 * plan.band, 4 * plan.band):
                    bands = lows[:len(lows) // width * width].reshape(-1, width)
                    out += [(doc_id, width, i, sha256(band.tobytes()).digest()[:16]) for i, band in enumerate(bands)]
            yield pd.DataFrame(out, columns=["doc_id", "width", "no", "band"])

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"))
    every = cut_lineage(known.mapInPandas(sketched, "doc_id long, set binary, n long, shingles binary"))
    first = every.groupBy("set").agg(F.min("doc_id").alias("other_id"))
    equal = every.select("doc_id", "set").join(first, "set").where("doc_id <> other_id").select(
        "doc_id", "other_id", F.lit(1.0).alias("similarity"))
    sets = every.join(first, every["doc_id"] == first["other_id"], "left_semi").select("doc_id", "n", "shingles")

    bands = cut_lineage(sets.select("doc_id", "shingles").mapInPandas(banded, "doc_id long, width int, no int, band binary"))
    name = ["width", "no", "band"]
    smallest = bands.groupBy(name).agg(F.min("doc_id").alias("other_id"), F.count(F.lit(1)).alias("many")).where("many > 1")
    links = _verified(bands.join(smallest.drop("many"), name).where("doc_id <> other_id").select("doc_id", "other_id").distinct(), sets, plan)

    groups = components(links, "doc_id", "other_id").withColumnRenamed("node", "doc_id")
    known_to = cut_lineage(sets.select("doc_id").join(groups, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component")))
    narrow = bands.where(F.col("width") == plan.band).join(known_to, "doc_id")
    split = narrow.groupBy(name).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    open_ids = narrow.join(split, name, "left_semi").select("doc_id", "component").distinct()
    more = _verified(_candidates(sets.join(open_ids, "doc_id").select("doc_id", "component", "n", "shingles"), plan), sets, plan)
    return equal.unionByName(links).unionByName(more)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(common.documents(spark, sf_dir))
