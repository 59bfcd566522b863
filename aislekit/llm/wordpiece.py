"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie over bytes plus an end-of-word symbol.  Every node has a failure
link to the node that remains after its longest vocabulary pieces are popped from the left, and the
number of pieces so popped.  Reading a word therefore takes one step a byte and some
popped steps, at most linear in the word's length, and no piece is ever built.

Words are split at 0x20 and 0x09-0x0D and A-Z is lower-cased.  The vocabulary file names pieces
in the byte-to-letter form of byte-level tokenizers, with ``</w>`` at pieces that end a word.
Every byte must be a piece, so that no word is unknown; an end mark that no piece takes counts nothing.

Nulls and ties: a null text counts as empty, with 0 words and 0 pieces; repeated rows are counted
alike; a null doc_id stays null; other columns are not returned; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import id_text, tidy, with_id

END = 256  #: the end-of-word symbol
_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())
_GAPS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of byte-level tokenizers:
    printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces as byte tuples, ending in END where the piece ends a word."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters, pieces = byte_letters(), []
    for piece in vocabulary:
        body = piece.removesuffix("</w>")
        if all(c in letters for c in body):
            pieces.append(tuple(letters[c] for c in body) + ((END,) if body != piece else ()))
    return [p for p in pieces if p]


class Automaton:
    """Trie with failure links and popped-piece counts; ``count`` gives a word's number of pieces."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                child = self.next[node].get(symbol)
                if child is None:
                    child = self.next[node][symbol] = len(final)
                    self.next.append({})
                    final.append(False)
                node = child
            final[node] = True
        lone_end = self.next[0].setdefault(END, len(final))
        if lone_end == len(final):
            self.next.append({})
            final.append(True)
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([(0, 0, None)])
        while queue:
            node, parent, symbol = queue.popleft()
            if symbol is not None:
                if final[node]:  # the whole node is one piece
                    self.fail[node], self.popped[node] = 0, int(node != lone_end)
                else:  # pop what the parent pops until the symbol can follow
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and symbol not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at][symbol], count
            queue.extend((child, node, s) for s, child in self.next[node].items())

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of ``word`` and its end mark."""
        node, count = 0, 0
        for symbol in (*word, END):
            while symbol not in self.next[node]:
                count += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    raise ValueError("the vocabulary lacks a single byte")
            node = self.next[node][symbol]
        while node:  # pop what is left
            count += self.popped[node]
            node = self.fail[node]
            if node < 0:
                raise ValueError("the vocabulary lacks a single byte")
        return count


class _Counts(dict):
    """word -> pieces, for words seen lately."""

    def __init__(self, automaton: Automaton, limit: int = 400_000):
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        made = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = made
        return made


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, built once in a worker."""
    if path not in _loaded:
        _loaded[path] = Automaton(read_vocabulary(path))
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_pieces (long) of every whole text.  ``vocabulary`` is the path of the file on
    every machine, as installed with the tokenizers."""

    @tidy
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _Counts(automaton(vocabulary))
        for frame in frames:
            words = [t.encode("utf-8").translate(_LOWER_TABLE).translate(_GAPS).split() if t else []
                     for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_words": [len(w) for w in words],
                                "n_pieces": [sum(map(counts.__getitem__, w)) for w in words]})

    one = docs.select(id_text().alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_id(one.mapInPandas(counted, "doc_id string, n_words long, n_pieces long"))


def op5_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
