"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of a pair that differs by one code point the shorter word (or, of equal lengths, either) is cut into two disjoint
chunks, its first and its last half; the edit leaves one of them whole.  The other word gives its positional grams of that
length.  A chunk that stays whole stands at most one place further on there: the first at the same place, the last as
far from the end, since an edit on the other side of the last chunk shifts it by the difference in length.  So the
positions that can meet within a shift of one are the two ends.  What remains of both words differs by that edit again, so the
rest is cut into two chunks in the same way, and both levels together are the join's key: three quarters of a word, which
keeps frequent halves (common prefixes, endings) from meeting all words that have them.  Candidates are verified.

Runs are counted in their documents, then in the task, then by word over all, so a frequent word is one row of a task.

Defined cases: null texts have no words; a null doc_id counts as the empty string before the colon; rows with equal doc_id are
documents of their own; an empty table gives no rows.  Runs may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .turn_trie import CRC_TABLE_SQL, crc32_sql

MIN_CHARS, MIN_COUNT = 5, 3
#: A word's form must be this many times as frequent.
RATIO = 2
#: The run's code point is deleted where this divides the crc32.
DAMAGE = 97
#: Words that a task counts before it hands them on.
FLUSH = 1 << 19
_RUN = re.compile("[a-zÀ-ÿ]+")


def document_words(doc_id: str, text: str) -> Counter:
    """Occurrences of the words of one text, damaged as the contract says."""
    out: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        if len(run) < MIN_CHARS:
            continue
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_CHARS:
                continue
        out[run] += n
    return out


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def rows() -> pd.DataFrame:
        frame = pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
        seen.clear()
        return frame

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            if text:
                seen.update(document_words(doc_id, text))
            if len(seen) >= FLUSH:
                yield rows()
    yield rows()


def words(docs: DataFrame) -> DataFrame:
    """(word, n): every word with its occurrences over all documents."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return ids.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= MIN_COUNT)


def _part(word: Column, first: bool, size: Column) -> Column:
    return F.substring(word, F.lit(1), size) if first else F.substring(word, F.length(word) - size + 1, size)


def _rest(word: Column, first: bool, size: Column) -> Column:
    return F.substring(word, size + 1, F.length(word) - size) if first else F.substring(word, F.lit(1), F.length(word) - size)


def keys(word: Column, length: Column) -> Column:
    """The four keys of a word against chunks of words of ``length``: which half, which chunk of the rest, both texts."""
    q = F.floor(length / 2).cast("int")
    s = F.floor((length - q) / 2).cast("int")
    return F.array(*[
        F.xxhash64(length, F.lit(2 * i + j), _part(word, i == 0, q), _part(_rest(word, i == 0, q), j == 0, s))
        for i in (0, 1) for j in (0, 1)])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words exactly one edit apart."""
    size = F.length("word")
    chunks = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(keys(F.col("word"), size)).alias("k"))
    grams = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n"),
                              F.explode(F.concat(keys(F.col("word"), size), keys(F.col("word"), size - 1))).alias("k"))
    longer = F.length("b") - F.length("a")
    # of two words of equal length one order is enough here
    found = chunks.join(grams, "k").where((longer == 1) | (longer == 0) & (F.col("a") < F.col("b"))).where(
        F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return found.select(both.alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers are doubled until none moves.  Along a chain n at least doubles,
    so it has at most 63 links and six rounds follow them all."""
    at = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        to = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut_lineage(at.join(to, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                                F.col("_next").isNotNull().alias("_moved")))
        at = moved.select("word", "root")
        if not moved.where("_moved").take(1):
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``; see the module."""
    vocabulary = cut_lineage(words(docs))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    near = near_pairs(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    taken = -F.col("best.m") >= RATIO * F.col("n")
    formed = cut_lineage(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.w")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")))
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all whole ``documents``."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spelling_sql() -> str:
    """The same by deletion neighbourhoods: two words are near if they agree after deleting the same place of both, or
    one is the other with a place deleted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS m FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY id, run),
named AS (SELECT id || ':' || run AS name, run, m FROM counted),
hashed AS (SELECT run, m, {crc32_sql("name")} AS h FROM named, crc),
words AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, m
  FROM hashed),
voc AS (SELECT word, sum(m)::BIGINT AS n FROM words WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(m) >= {MIN_COUNT}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc),
gone AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM cut),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, g.n, v.word, v.n FROM gone g JOIN voc v ON v.word = g.rest
  UNION SELECT v.word, v.n, g.word, g.n FROM gone g JOIN voc v ON v.word = g.rest),
ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM pairs),
formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0)::BIGINT AS n_near, CASE WHEN r.other_n >= {RATIO} * v.n THEN r.other END AS form,
         CASE WHEN r.other_n >= {RATIO} * v.n THEN r.other_n END AS form_n
  FROM voc v LEFT JOIN ranked r ON r.word = v.word AND r.r = 1),
chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at WHERE e.form IS NULL
"""
