"""Dictionary-coded documents: one row a document from tokens to weights.

A document's words come out of Spark's text functions, or, on the training side, of its lower-cased text (:func:`letter_rows`);
word 1- and 2-grams are looked up in a broadcast list of
terms and counted inside the row (Arrow's vectorised hash look-up, numpy counts), so that neither text nor (document, term) rows are
shuffled.  To learn terms, documents become sequences of word numbers (:func:`number_words`), and a gram is one number.  Coded rows are ``(doc_id, idx array<int>, tf array<int>)``, codes ascending; weighed ones have
``w array<double>`` as well, of unit length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Documents that are turned into terms at a time.
SLICE = 2048


def _prep(t: Column, normalize: str) -> Column:
    if normalize == "train":
        return X.normalize_train(t)
    if normalize == "fold":
        return X.fold_ascii(t)
    return t


def token_rows(docs: DataFrame, id_col: str, text_col: str, normalize: str = "train") -> DataFrame:
    """M1: ``doc_id, tokens``.  ``normalize='train'`` applies X1 first (training side), ``'fold'`` X2 (the reference's
    serving side), ``'none'`` neither."""
    tokens = X.train_tokens("_t") if normalize == "train" else X.word_tokens("_t")
    return (docs.select(F.col(id_col).alias("doc_id"), _prep(F.col(text_col), normalize).alias("_t"))
            .select("doc_id", tokens.alias("tokens")))


def letter_rows(docs: DataFrame, id_col: str, text_col: str, normalize: str = "train") -> DataFrame:
    """:func:`token_rows`, but for ``'train'`` ``tokens`` is the lower-cased text, which tasks cut into the same words
    (:func:`_cut_letters`): the regular expression takes most of the time of long texts."""
    if normalize != "train":
        return token_rows(docs, id_col, text_col, normalize)
    return docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("tokens"))


# Bytes of the kept letters: a-z, and the two bytes of the others, where a lead byte and a next byte share a bit.
_ASCII, _LEAD, _NEXT = np.zeros(256, bool), np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_ASCII[ord("a"):ord("z") + 1] = True
for _a, _b in (c.encode() for c in X.TRAIN_KEEP_LETTERS if ord(c) >= 0x80):
    _LEAD[_a] = 1 << (_a - 0xC3)
    _NEXT[_b] |= _LEAD[_a]


def _cut_letters(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """X1 and M1 of lower-cased texts: runs of two or more kept letters, each with the number of its document."""
    n, texts = len(texts), pc.fill_null(texts.cast(pa.string()), "")
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    keep = _ASCII[data]
    if len(data) and data.max() >= 0x80:
        pair = (_LEAD[data[:-1]] & _NEXT[data[1:]]) != 0
        keep[:-1] |= pair
        keep[1:] |= pair
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends with its text
    first, last = keep.copy(), keep.copy()
    first[1:] &= ~keep[:-1]
    last[:-1] &= ~keep[1:]
    first[edges], last[edges - 1] = keep[edges], keep[edges - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    one = (size == 1) | (size == 2) & (data[start] >= 0x80)  # one letter
    keep[start[one]] = False
    keep[start[one] + size[one] - 1] = False
    start, size = start[~one], size[~one]
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(np.append(0, size.cumsum()).astype(np.int32)), pa.py_buffer(data[keep]))
    return np.searchsorted(at, start, "right") - 1, words


def _words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of documents, each with the number of its document; of lists of words or of lower-cased texts."""
    if not pa.types.is_list(column.type):
        return _cut_letters(column)
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), counts), column.flatten()


def _grams(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """M2: 1- and 2-grams of documents, each with the number of its document."""
    doc, words = _words(tokens)
    if len(words) < 2:
        return doc, words
    same = doc[1:] == doc[:-1]
    inside = pa.array(same)
    pairs = pc.binary_join_element_wise(words[:-1].filter(inside), words[1:].filter(inside), " ")
    return np.concatenate([doc, doc[1:][same]]), pa.concat_arrays([words, pairs])


def gram_values(batch: pa.RecordBatch) -> Iterator[pa.Array]:
    """The terms of a batch of ``tokens``, in slices."""
    column = batch.column(batch.schema.get_field_index("tokens"))
    for at in range(0, len(column), SLICE):
        yield _grams(column.slice(at, SLICE))[1]


def word_values(batch: pa.RecordBatch) -> Iterator[pa.Array]:
    """The words of a batch of ``tokens``, in slices."""
    column = batch.column(batch.schema.get_field_index("tokens"))
    for at in range(0, len(column), SLICE):
        yield _words(column.slice(at, SLICE))[1]


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """``values`` of ascending ``rows`` as one list for each of n rows."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def code_rows(rows: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, idx, tf`` of token rows; a term's code is its place in ``terms``, others vanish."""
    sent = rows.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))
    size = max(1, len(terms))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0), batch.column(1)
            for at in range(0, len(tokens), SLICE):
                part = tokens.slice(at, SLICE)
                doc, grams = _grams(part)
                code = pc.index_in(grams.cast(pa.string()), value_set=sent.value)
                known = np.asarray(code.is_valid())
                key = doc[known] * size + code.drop_null().to_numpy().astype(np.int64)
                key, tf = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, SLICE), _lists((key % size).astype(np.int32), key // size, len(part), pa.int32()),
                     _lists(tf.astype(np.int32), key // size, len(part), pa.int32())], names=["doc_id", "idx", "tf"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "tokens").mapInArrow(coded, f"doc_id {kind}, idx array<int>, tf array<int>")


def number_words(rows: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id, seq`` of token rows: a document's words as places in ``words``, in order; other words, one or more, are -1."""
    sent = rows.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0), batch.column(1)
            for at in range(0, len(tokens), SLICE):
                part = tokens.slice(at, SLICE)
                doc, found = _words(part)
                coded = found.cast(pa.string()).dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=sent.value), -1).to_numpy().astype(np.int32)
                seq = place[coded.indices.to_numpy()]
                keep = np.ones(len(seq), bool)
                keep[1:] = (seq[1:] >= 0) | (seq[:-1] >= 0) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([ids.slice(at, SLICE), _lists(seq[keep], doc[keep], len(part), pa.int32())], names=["doc_id", "seq"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "tokens").mapInArrow(numbered, f"doc_id {kind}, seq array<int>")


def _gram_numbers(seqs: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """M2 on numbered words: a is its own number, ``a b`` is size * (a + 1) + b; each with the number of its document."""
    doc = np.repeat(np.arange(len(seqs)), pc.list_value_length(seqs).to_numpy(zero_copy_only=False))
    seq = seqs.flatten().to_numpy().astype(np.int64)
    known, both = seq >= 0, (doc[1:] == doc[:-1]) & (seq[1:] >= 0) & (seq[:-1] >= 0)
    return np.concatenate([doc[known], doc[1:][both]]), np.concatenate([seq[known], (size * (seq[:-1] + 1) + seq[1:])[both]])


def gram_name(number: int, words: list[str]) -> str:
    first, second = divmod(number, len(words))
    return f"{words[first - 1]} {words[second]}" if first else words[second]


def gram_number_values(size: int):
    """The grams of a batch of ``seq``, in slices, as numbers."""
    def values(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        column = batch.column(batch.schema.get_field_index("seq"))
        for at in range(0, len(column), SLICE):
            yield pa.array(_gram_numbers(column.slice(at, SLICE), size)[1])

    return values


def _known_grams(seqs: pa.ListArray, size: int, have: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, code, tf`` of the grams in ``have`` (numbers, ascending; their codes are in ``place``), by row and code."""
    doc, gram = _gram_numbers(seqs, size)
    if not len(have):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(have, gram), len(have) - 1)
    known = have[at] == gram
    key, tf = np.unique(doc[known] * len(have) + place[at[known]], return_counts=True)
    return key // len(have), key % len(have), tf


def _sorted_grams(grams: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Gram numbers ascending, and the place of each in ``grams``."""
    order = np.argsort(np.asarray(grams, np.int64), kind="stable")
    return np.asarray(grams, np.int64)[order], order.astype(np.int64)


def gram_totals(seqs: DataFrame, size: int, grams: list[int]) -> DataFrame:
    """``code, total, df`` of the grams (codes: places in ``grams``) that occur in ``seq`` rows; a task adds up its documents first."""
    sent = seqs.sparkSession.sparkContext.broadcast(_sorted_grams(grams))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, place = sent.value
        total, df = np.zeros(len(have), np.int64), np.zeros(len(have), np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                _, code, tf = _known_grams(batch.column(0).slice(at, SLICE), size, have, place)
                total += np.bincount(code, tf, len(have)).astype(np.int64)
                df += np.bincount(code, minlength=len(have))
        code = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code]), pa.array(df[code])], names=["code", "total", "df"])

    parts = seqs.select("seq").mapInArrow(added, "code int, total long, df long")
    return parts.groupBy("code").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def count_rows(seqs: DataFrame, size: int, grams: list[int]) -> DataFrame:
    """M4: ``doc_id, idx, tf`` of ``doc_id, seq`` rows; a gram's code is its place in ``grams``, others vanish."""
    sent = seqs.sparkSession.sparkContext.broadcast(_sorted_grams(grams))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.column(1).slice(at, SLICE)
                row, code, tf = _known_grams(part, size, *sent.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, SLICE), _lists(code.astype(np.int32), row, len(part), pa.int32()),
                     _lists(tf.astype(np.int32), row, len(part), pa.int32())], names=["doc_id", "idx", "tf"])

    kind = seqs.schema["doc_id"].dataType.simpleString()
    return seqs.select("doc_id", "seq").mapInArrow(counted, f"doc_id {kind}, idx array<int>, tf array<int>")


def weigh_rows(coded: DataFrame, idf: list[float], renumber: list[int] | None = None) -> DataFrame:
    """M6: adds ``w``, tf * idf of each term over the row's Euclidean norm.  ``renumber[c]`` is the new code of c, -1 to leave
    it out; it must keep the order of codes."""
    sent = coded.sparkSession.sparkContext.broadcast((np.asarray(idf, float), None if renumber is None else np.asarray(renumber, np.int32)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, number = sent.value
        for batch in batches:
            n = len(batch)
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), lengths)
            code = batch.column(1).flatten().to_numpy()
            tf = batch.column(2).flatten().to_numpy()
            if number is not None:
                code = number[code]
                row, tf, code = row[code >= 0], tf[code >= 0], code[code >= 0]
            w = tf * weight[code]
            norm = np.sqrt(np.bincount(row, w * w, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(code, row, n, pa.int32()), _lists(tf, row, n, pa.int32()),
                 _lists(w / norm[row], row, n, pa.float64())], names=["doc_id", "idx", "tf", "w"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "idx", "tf").mapInArrow(weighed, f"doc_id {kind}, idx array<int>, tf array<int>, w array<double>")


def products(row: np.ndarray, idx: np.ndarray, w: np.ndarray, n: int, matrix: np.ndarray) -> np.ndarray:
    """n sparse rows times a terms x classes matrix, a bounded number of terms at a time."""
    out = np.zeros((n, matrix.shape[1]))
    step = max(1, (1 << 21) // max(1, matrix.shape[1]))
    for at in range(0, len(idx), step):
        part = slice(at, at + step)
        first = np.flatnonzero(np.append(True, row[part][1:] != row[part][:-1]))
        out[row[part][first]] += np.add.reduceat(matrix[idx[part]] * w[part, None], first, axis=0)
    return out


def code_counts(coded: DataFrame) -> DataFrame:
    """``code, total, df``: occurrences and documents of every code."""
    return (coded.select(F.explode_outer(F.arrays_zip("idx", "tf")).alias("c")).select(F.col("c.idx").alias("code"), F.col("c.tf").alias("tf"))
            .where("code is not null").groupBy("code").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")))


def long_rows(weighed: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, term, idx, tf, tfidf`` (and ``keep``), a row for each term of a document."""
    parts = weighed.select("doc_id", *keep, F.explode_outer(F.arrays_zip("idx", "tf", "w")).alias("c")).where("c is not null")
    parts = parts.select("doc_id", *keep, "c.idx", "c.tf", F.col("c.w").alias("tfidf"))
    # the vocabulary's size is bounded (``features.MAX_FEATURES``)
    return parts.join(F.broadcast(vocab.select("idx", "term")), "idx").select(
        "doc_id", *keep, "term", "idx", F.col("tf").cast("long").alias("tf"), "tfidf")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the library
