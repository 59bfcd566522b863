"""Personal data: candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds (email, ip, card, phone).  Base
rules keep the strict ones.  For the others boosted regression trees on the logistic loss, over format
and context features of a span, give a probability, and a threshold per kind,
calibrated on spans left out of the training, selects what is redacted as well.

Training labels come from the corpus itself.  Positive are spans that a base rule accepts, and the same spans written
otherwise in their own context (``variants``: no plus, ``@`` and ``.`` written out, other separators), as far as the
generators propose them.  Negative are candidates that a definite rule refutes (``refuted``), which are never
added.  Others are unlabelled, as the base may have missed them: first trees tell positives from all else, and only the
unlabelled that these place below the positives left out of the training are negatives for the final trees; those that look
like personal data count for neither side, however many they are.  Features leave out what the rules
test (``@``, a leading ``+``, the Luhn sum, the range of parts), so that the trees learn what personal data
look like and where they stand.  Trees, cuts and thresholds come from every candidate of every text, each distinct surrounding once:
Spark keeps them in blocks (``Kept``), a level of a tree is one pass that adds up histograms of gradients in the tasks, and
only these sums reach the driver.  Every candidate is scored.

Offsets count code points, ends are exclusive.  Nulls and ties: a null text counts as empty and has no spans;
repeated rows get the same spans;
base spans are never changed; a candidate that overlaps a base span of any kind is dropped; of overlapping
candidates the likeliest stays, then the first, then the longest; an empty table, or a kind without both
labels, adds no spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import common
from .common import id_text, tidy, with_id

KINDS = ("email", "ip", "card", "phone")

# The base rules.  An email's local part is read leftwards from its @, and an ip starts where
# a run of digits does: the same leftmost matches in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# High-recall generators of candidates beside the base matches.
_AT = re.compile(r"@|\s?[\[(]\s?(?:at|AT)\s?[\])]\s?")
_LOOSE_DOMAIN = re.compile(r"[^\s@<>()\[\]]+(?:(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?)[A-Za-z0-9-]+)*")
_NO_LOCAL = frozenset("@<>()[]")
_LOOSE = {
    1: re.compile(r"[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}"),
    2: re.compile(r"[0-9](?:[\x20.\-]?[0-9]){11,18}"),
    3: re.compile(r"[(+]?[0-9][\x20().\-/0-9]{7,20}[0-9]"),
}
_DIGIT = re.compile("[0-9]")
_NUMBER = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of what the base rules accept, by kind and start."""
    found: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if not _DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Spans of the loose generators; they may overlap.  A local part is read leftwards from its separator to the one
    before, so all of them together take one pass over the text."""
    found: list[tuple[int, int, int]] = []
    for m in _AT.finditer(text) if "@" in text or "(" in text or "[" in text else ():
        start = m.start()
        while start and text[start - 1] not in _NO_LOCAL and not text[start - 1].isspace():
            start -= 1
        domain = _LOOSE_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            found.append((0, start, domain.end()))
    if _DIGIT.search(text):
        for k in (1, 2, 3):
            found += [(k, *m.span()) for m in _LOOSE[k].finditer(text)]
    return found


_DOT = re.compile(r"[\w-](?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?)[\w-]")
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|"
                   r"(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})(?![0-9])")


def refuted(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a candidate cannot be of its kind: a domain without a dot, a part over 255, a wrong Luhn sum or
    number of digits, a calendar date, digits cut out of a longer run."""
    span = text[start:end]
    if kind == 0:
        at = _AT.search(span)
        return at is None or not _DOT.search(span, at.end())
    if "0" <= text[max(0, start - 1):start] <= "9" or "0" <= text[end:end + 1] <= "9":
        return True
    digits = _digits(span)
    if kind == 1:
        return not all(map(_octet, _NUMBER.findall(span)))
    if kind == 2:
        return not 13 <= len(digits) <= 19 or not luhn(digits)
    return not 9 <= len(digits) <= 15 or _DATE.match(span) is not None


def variants(text: str, kind: int, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """(text, kind, start, end) of candidates outside the base rules, where a base span is written otherwise."""
    span, left, right = text[start:end], text[max(0, start - 12):start], text[end:end + 12]
    if kind == 0:
        local, _, domain = span.partition("@")
        forms = [local + at + domain.replace(".", dot) for at, dot in
                 ((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), ("@", "[dot]"))]
    elif kind == 1:
        forms = [span.replace(".", "-")]
    elif kind == 2:
        digits = _digits(span)
        forms = [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    else:
        groups = _NUMBER.findall(span)
        forms = [span[1:], *(sep.join(groups) for sep in " -.")]
    found = []
    for form in forms:
        around, begin = left + form + right, len(left)
        base = Cover(base_spans(around))
        found += [(around, k, s, e) for k, s, e in candidates(around)
                  if k == kind and s < begin + len(form) and begin < e and not base.touches((k, s, e)) and not refuted(around, k, s, e)]
    return found


FEATURES = 18
#: Labels of training rows.
REFUTED, BASE, UNLABELLED, VARIANT = range(4)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and of 12 code points on either side."""
    span, left, right = text[start:end], text[max(0, start - 12):start], text[end:end + 12]
    digits = _digits(span)
    groups = _NUMBER.findall(span)
    return [kind, len(span.lstrip("+")), len(digits), len(groups), max(map(len, groups), default=0),
            min(map(len, groups), default=0), len(set(digits)), span.count("."), span.count(" "), span.count("-"),
            span.count("(") + span.count(")"), sum(c.isalpha() for c in span),
            float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left[-1:].isspace() or not left),
            float(right[:1].isspace() or not right),
            sum(c.isdigit() for c in left + right), sum(not c.isalnum() and not c.isspace() for c in left + right)]


@dataclass(frozen=True)
class BoostingPlan:
    trees: int = 30
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    precision: float = 0.98  #: wanted on the calibration spans
    left: float = 0.05  #: share of calibration positives below which unlabelled candidates are negatives


@dataclass
class Tree:
    """A complete tree: node i has children 2i + 1 and 2i + 2; feature -1 marks a leaf."""
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def place(self, x: np.ndarray, steps: int) -> np.ndarray:
        """The node of each row after so many steps down."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(steps):
            f = self.feature[at]
            inner = f >= 0
            down = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.limit[at])
            at = np.where(inner, down, at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.place(x, len(self.feature).bit_length() - 1)]


@dataclass
class Model:
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: kind number -> least probability of an added span; kinds without one add none
    thresholds: dict[int, float] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            z += tree.predict(x)
        return 1 / (1 + np.exp(-z))


#: Rows of a block, and of a task of a pass.
BLOCK_ROWS, TASK_ROWS = 1 << 13, 1 << 16
_BLOCKS = "x binary, label binary, held binary, n binary"


class Block(NamedTuple):
    """Training rows: features, label, whether left out of the training, and how many candidates a row stands for."""
    x: np.ndarray
    label: np.ndarray
    held: np.ndarray
    n: np.ndarray

    @property
    def positive(self) -> np.ndarray:
        return np.isin(self.label, (BASE, VARIANT))

    def only(self, rows: np.ndarray) -> Block:
        return Block(*(c[rows] for c in self))

    def packed(self) -> pa.RecordBatch:
        kinds = (np.int32, np.int8, np.bool_, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([c.astype(k).tobytes()], pa.binary()) for c, k in zip(self, kinds, strict=True)],
                                          names=["x", "label", "held", "n"])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for x, label, held, n in zip(*(batch.column(i) for i in range(4)), strict=True):
            yield Block(np.frombuffer(x.as_buffer(), np.int32).reshape(-1, FEATURES).astype(float),
                        np.frombuffer(label.as_buffer(), np.int8), np.frombuffer(held.as_buffer(), np.bool_),
                        np.frombuffer(n.as_buffer(), np.int64))


def _values(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(feature, values, how many training candidates have them)"""
    for f in range(FEATURES):
        values, place = np.unique(block.x[~block.held, f], return_inverse=True)
        yield f, values, np.bincount(place, block.n[~block.held], len(values))


class Local:
    """Training rows of one block."""

    def __init__(self, block: Block) -> None:
        self.block = block

    def total(self, per_block: Callable[[Block], np.ndarray]) -> np.ndarray:
        return per_block(self.block)

    def values(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(values, n) for _, values, n in _values(self.block)]


class Kept:
    """Training rows that Spark keeps, read by passes: a task hands on sums."""

    def __init__(self, blocks: DataFrame) -> None:
        self.blocks = cut_lineage(blocks)

    def total(self, per_block: Callable[[Block], np.ndarray]) -> np.ndarray:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(map(per_block, _unpacked(batches)), np.zeros(1))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        sums = [np.frombuffer(r["sums"]) for r in self.blocks.mapInArrow(summed, "sums binary").collect()]
        return sum((s for s in sums if len(s) > 1), np.zeros(1))

    def values(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """A row reaches the driver for each value of a feature: whole numbers, mostly lengths of spans."""
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _unpacked(batches):
                for f, values, n in _values(block):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), f), pa.int32()), pa.array(values, pa.float64()),
                                                      pa.array(n, pa.float64())], names=["f", "v", "n"])

        out = self.blocks.mapInArrow(found, "f int, v double, n double").groupBy("f", "v").agg(F.sum("n").alias("n")).toPandas().sort_values("v")
        return [(out["v"][out["f"] == f].to_numpy(), out["n"][out["f"] == f].to_numpy()) for f in range(FEATURES)]

    def where(self, kept: Callable[[Block], np.ndarray]) -> Kept:
        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _unpacked(batches):
                yield block.only(kept(block)).packed()

        return Kept(self.blocks.mapInArrow(chosen, _BLOCKS))


#: Gradients are added up in whole units of this, so that sums are the same in every order.
_UNIT = 2.0 ** -24


def _histograms(model: Model, tree: Tree, level: int, cuts: list[np.ndarray], block: Block) -> np.ndarray:
    """Sums of gradients and weights by node of the level, feature and interval."""
    nodes, width = 1 << level, max(map(len, cuts)) + 1
    train = block.only(~block.held)
    p = model.probability(train.x)
    gradient = np.rint((train.positive - p) / _UNIT) * train.n
    weight = np.rint(p * (1 - p) / _UNIT) * train.n
    node = tree.place(train.x, level) - (nodes - 1)
    here = (node >= 0) & (node < nodes)  # others ended above
    out = np.empty((2, nodes, FEATURES, width))
    for f, c in enumerate(cuts):
        slot = (node * width + np.searchsorted(c, train.x[:, f]))[here]
        out[0, :, f] = np.bincount(slot, gradient[here], nodes * width).reshape(nodes, width)
        out[1, :, f] = np.bincount(slot, weight[here], nodes * width).reshape(nodes, width)
    return out.ravel()


def _grow(rows: Local | Kept, model: Model, cuts: list[np.ndarray], plan: BoostingPlan) -> Tree:
    """One regression tree by histograms of gradients, split where the gain is largest; a level is one pass."""
    nodes = 2 ** (plan.depth + 1) - 1
    tree = Tree(np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes))
    for level in range(plan.depth):
        if level and not (tree.feature[(1 << level - 1) - 1:(1 << level) - 1] >= 0).any():
            break
        sums = rows.total(partial(_histograms, model, tree, level, cuts)).reshape(2, 1 << level, FEATURES, -1) * _UNIT
        for i in range(1 << level):
            node = (1 << level) - 1 + i
            if level and tree.feature[(node - 1) // 2] < 0:
                continue
            g, h = sums[:, i, 0].sum(axis=1)
            tree.value[node] = plan.rate * g / (h + 1)
            best = (1e-6, -1, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs, hs = sums[:, i, f, :len(c)].cumsum(axis=1)
                gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            if best[1] >= 0:
                _, f, at = best
                tree.feature[node], tree.limit[node] = f, cuts[f][at]
                low_g, low_h = sums[:, i, f, :at + 1].sum(axis=1)
                tree.value[2 * node + 1] = plan.rate * low_g / (low_h + 1)
                tree.value[2 * node + 2] = plan.rate * (g - low_g) / (h - low_h + 1)
    return tree


LIMITS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)


def _sides(block: Block) -> np.ndarray:
    """Candidates by whether they are left out, and by label 0 or 1."""
    return np.bincount(2 * block.held + block.positive, block.n, 4)


def _chosen(model: Model, block: Block) -> np.ndarray:
    """Candidates left out, by kind, by how many of 0 and ``LIMITS`` their probability reaches, and by label 0 or 1."""
    b = block.only(block.held)
    reached = np.searchsorted(LIMITS, model.probability(b.x), "right")
    return np.bincount((b.x[:, 0].astype(np.int64) * (len(LIMITS) + 1) + reached) * 2 + b.positive, b.n,
                       len(KINDS) * (len(LIMITS) + 1) * 2)


def _lower(values: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Quantiles of ``values`` that occur ``n`` times: the largest one not above the place."""
    ends = n.cumsum()
    return values[np.searchsorted(ends, np.floor(shares * (ends[-1] - 1)), "right")]


def boost(rows: Local | Kept, plan: BoostingPlan = BoostingPlan()) -> Model:
    """Boosted trees from the rows that are not held out, thresholds from the others."""
    sides = rows.total(_sides)
    if len(sides) < 4 or not sides[0] or not sides[1]:
        return Model()
    share = sides[1] / (sides[0] + sides[1])
    model = Model(float(np.log(share / (1 - share))))
    shares = np.linspace(0, 1, plan.bins + 1)[:-1]
    cuts = [np.unique(_lower(values, n, shares)) for values, n in rows.values()]
    for _ in range(plan.trees):
        model.trees.append(_grow(rows, model, cuts, plan))
    chosen = rows.total(partial(_chosen, model)).reshape(len(KINDS), -1, 2) if sides[2:].any() else np.zeros((len(KINDS), 1, 2))
    for kind, mine in enumerate(chosen):
        if not mine.sum(axis=0).all():
            continue
        reached = mine[::-1].cumsum(axis=0)[::-1][1:]  # at least each limit
        for limit, (no, yes) in zip(LIMITS, reached, strict=True):
            if no + yes and yes / (no + yes) >= plan.precision:
                model.thresholds[kind] = limit
                break
    return model


def fit(x: np.ndarray, y: np.ndarray, order: np.ndarray, plan: BoostingPlan = BoostingPlan()) -> Model:
    """Boosted trees from four fifths of the rows, thresholds from the others (``order`` mod 5 = 0)."""
    return boost(Local(Block(x, np.where(y == 1, BASE, REFUTED), order % 5 == 0, np.ones(len(y), np.int64))), plan)


#: A probability in whole units of 2^-50 is found bit by bit, so many at a time.
_DIGITS, _ROUNDS = 10, 5


def _digit_counts(model: Model, known: np.ndarray, round_: int, block: Block) -> np.ndarray:
    """Positives left out, by kind and label, by the next digit of their probability where those before are ``known``."""
    b = block.only(block.held & block.positive)
    group = 2 * b.x[:, 0].astype(np.int64) + (b.label == VARIANT)
    unit = np.minimum((model.probability(b.x) * 2.0 ** 50).astype(np.int64), 2 ** 50 - 1) >> (_DIGITS * (_ROUNDS - 1 - round_))
    mine = unit >> _DIGITS == known[group]
    slot = (group << _DIGITS) + (unit & (1 << _DIGITS) - 1)
    return np.bincount(slot[mine], b.n[mine], 2 * len(KINDS) << _DIGITS)


def lowest_positives(rows: Local | Kept, model: Model, share: float) -> dict[int, float]:
    """Kind -> the probability, at most 0.5, below which ``share`` of its positives left out lie (of base spans or of variants, the
    smaller); kinds without such positives have none."""
    known = np.zeros(2 * len(KINDS), np.int64)
    before = total = None
    for i in range(_ROUNDS):
        counts = rows.total(partial(_digit_counts, model, known, i))
        if len(counts) < 2:
            return {}
        counts = counts.reshape(2 * len(KINDS), -1)
        if total is None:
            total = counts.sum(axis=1)
            before = np.floor(share * np.maximum(total - 1, 0))
        ends = counts.cumsum(axis=1)
        digit = np.array([min(np.searchsorted(e, r, "right"), len(e) - 1) for e, r in zip(ends, before, strict=True)])
        every = np.arange(len(known))
        before = before - (ends[every, digit] - counts[every, digit])
        known = (known << _DIGITS) + digit
    found = known * 2.0 ** -50
    return {k: min([0.5, *(float(found[g]) for g in (2 * k, 2 * k + 1) if total[g])])
            for k in range(len(KINDS)) if total[2 * k] or total[2 * k + 1]}


def _negatives(model: Model, limits: dict[int, float], block: Block) -> np.ndarray:
    """All rows but the unlabelled ones that look like positives."""
    limit = np.array([limits.get(k, np.inf) for k in range(len(KINDS))])[block.x[:, 0].astype(np.int64)]
    return (block.label != UNLABELLED) | (model.probability(block.x) < limit)


def learn(rows: Kept, plan: BoostingPlan = BoostingPlan()) -> Model:
    """``boost`` without the unlabelled rows that look like positives."""
    first = boost(rows, plan)
    return boost(rows.where(partial(_negatives, first, lowest_positives(rows, first, plan.left))), plan)


class Cover:
    """The code points of some spans, as disjoint intervals in order: whether a span meets one takes two look-ups."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touches(self, span: tuple[int, int, int]) -> bool:
        i = bisect_right(self.ends, span[1])
        return i < len(self.ends) and self.starts[i] < span[2]

    def add(self, span: tuple[int, int, int]) -> None:
        """A span that meets none."""
        i = bisect_right(self.ends, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


def training_rows(docs: DataFrame) -> DataFrame:
    """(label, held, x, n): the labelled candidates of all documents, each distinct surrounding counted once, a fifth of them held out."""

    @tidy
    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                if not text:
                    continue
                base = base_spans(text)
                covered = Cover(base)
                rows = [(text, k, BASE, s, e) for k, s, e in base]
                rows += [(t, k, VARIANT, s, e) for span in base for t, k, s, e in variants(text, *span)]
                rows += [(text, k, REFUTED if refuted(text, k, s, e) else UNLABELLED, s, e)
                         for k, s, e in candidates(text) if not covered.touches((k, s, e))]
                out += [(k, y, t[max(0, s - 12):e + 12], np.array(features(t, k, s, e), np.int32).tobytes()) for t, k, y, s, e in rows]
            yield pd.DataFrame(out, columns=["kind", "label", "around", "x"])

    found = docs.select("text").mapInPandas(made, "kind int, label int, around string, x binary")
    found = found.withColumn("rank", F.md5(F.concat_ws(":", "kind", "around").cast("binary")))
    found = found.groupBy("kind", "label", "rank").agg(F.min("x").alias("x"))
    held = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long") % 5 == 0
    return found.groupBy("label", held.alias("held"), "x").agg(F.count(F.lit(1)).alias("n"))


def kept_rows(docs: DataFrame) -> Kept:
    rows = cut_lineage(training_rows(docs))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                label, held, x, n = batch.slice(at, BLOCK_ROWS).columns
                yield Block(np.frombuffer(b"".join(x.to_pylist()), np.int32), label.to_numpy(),
                            held.to_numpy(zero_copy_only=False), n.to_numpy()).packed()

    return Kept(rows.coalesce(-(-rows.count() // TASK_ROWS) or 1).mapInArrow(blocks, _BLOCKS))


def train(docs: DataFrame, plan: BoostingPlan = BoostingPlan()) -> Model:
    """Learn from the candidates of all documents; sums of passes reach the driver, as many numbers as there are intervals."""
    return learn(kept_rows(docs), plan)


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the model adds."""
    base = base_spans(text)
    covered = Cover(base)
    loose = [c for c in candidates(text) if c[0] in model.thresholds and not covered.touches(c) and not refuted(text, *c)]
    if not loose:
        return base, []
    p = model.probability(np.array([features(text, *c) for c in loose]))
    added: list[tuple[int, int, int]] = []
    taken = Cover()
    for likely, (k, s, e) in sorted(zip(p, loose, strict=True), key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
        if likely >= model.thresholds[k] and not taken.touches((k, s, e)):
            added.append((k, s, e))
            taken.add((k, s, e))
    return base, added


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added)."""
    shared = spark.sparkContext.broadcast(model)

    @tidy
    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                base, added = all_spans(text or "", shared.value)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                out.append((doc_id, *counts, sha256(_written(base).encode()).hexdigest(), _written(base + added)))
            yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return with_id(docs.select(id_text().alias("doc_id"), "text").mapInPandas(
        spans, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every maximal run of overlapping spans becomes the mark of the kind that starts it."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by marks such as <EMAIL>, and ``n_chars`` anew
    where there is such a column; null texts stay null."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return pd.Series([t if not t else redact_text(t, sum(all_spans(t, shared.value), [])) for t in texts], dtype=object)

    out = docs.withColumn("text", redacted(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return find(spark, docs, train(docs))
