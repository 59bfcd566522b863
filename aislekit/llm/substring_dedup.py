"""Suffix-array dedup: bytes covered by a repeated string of 50 bytes, by merged Burrows-Wheeler transforms.

A string of 50 bytes is removed where it also starts in a document with a smaller doc_id.  Equal strings have equal
minimisers (the 24-byte gram of smallest hash inside), so a text is cut into runs of strings that share one, and runs
are sent by minimiser.  Minimisers that only one text has cannot repeat, and are found first, by shards of
their hash.  Equal runs are aggregated to one, with the smallest doc_id.  Each task then turns its distinct runs into
shards of Burrows-Wheeler transforms and merges them (``bwt``), down to common prefixes of 50 bytes; the
repeated intervals give every string's smallest doc_id, which is joined back to the runs' places.  A minimiser whose distinct
runs exceed ``DedupPlan.key_bytes`` (a common passage beside each document's own context) goes to no single task: its runs
are cut into their strings, which meet by their 50 bytes (``split_owners``).

Texts that equal a text with a smaller doc_id are removed whole when 50 bytes or longer, and take no part in the rest.

Nulls and ties: a null text counts as empty; rows without doc_id come after all others; rows with one
doc_id do not remove from each other; texts under 50 bytes are kept; an empty table gives an empty result; other
columns are not returned.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from . import common
from .bwt import repeated_prefixes
from .common import doc_key, tidy
from .words import _power, constants, mix

_BYTE = constants(4, 256)
_BASE = int(constants(5, 1)[0]) | 1
SEGMENT = 1 << 20  #: strings hashed at once


@dataclass(frozen=True)
class DedupPlan:
    length: int = 50
    gram: int = 24
    shard_bytes: int = 24 << 20  #: text behind the minimisers of one shard
    part_bytes: int = 16 << 20  #: text behind the runs of one merge
    key_bytes: int = 16 << 20  #: most bytes of one minimiser's distinct runs in a merge
    run: int = 64  #: most strings of a run
    bitmap_bits: int = 23


def owner_of(raw: bytes) -> int:
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def minimisers(raw: bytes, plan: DedupPlan) -> Iterator[tuple[int, np.ndarray]]:
    """(position, smallest gram hash of each string that starts from there on), segment by segment."""
    data, k, width = np.frombuffer(raw, np.uint8), plan.gram, plan.length - plan.gram + 1
    for at in range(0, max(0, len(data) - plan.length + 1), SEGMENT):
        part = data[at:at + SEGMENT + plan.length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _power(_BASE, len(part), "gram up")[:len(part)], out=total[1:])
        low = mix((total[k:] - total[:-k]) * _power(pow(_BASE, -1, 1 << 64), len(part), "gram down")[:len(part) - k + 1])
        span, n = 1, len(part) - plan.length + 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        yield at, np.minimum(low[:n], low[width - span:width - span + n])


def _names(keys: np.ndarray, shards: int) -> np.ndarray:
    """A shard and 32 bits of a key: its name among the shared ones."""
    return (keys >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _listed(owner: np.ndarray, name: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(owner):
        return
    order = np.lexsort((name, owner))
    owner, name = owner[order], name[order]
    ids, start = np.unique(owner, return_index=True)
    for i, a, b in zip(ids.tolist(), start, np.append(start[1:], len(owner)), strict=True):
        yield i, name[a:b].astype("<u8").tobytes()


def shared_minimisers(texts: DataFrame, shards: int, plan: DedupPlan) -> DataFrame:
    """(owner, names): for every distinct text, its minimisers that another text has too (names of them)."""
    @tidy
    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def out() -> pd.DataFrame:
            owner = np.repeat(np.array(list(held), np.int64), [len(x) for x in held.values()])
            key = np.concatenate(list(held.values()))
            order = np.lexsort((owner, key))
            owner, key = owner[order], key[order]
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            many = same.copy()
            many[:-1] |= same[1:]
            name = _names(key, shards)
            # known here as shared; of each list only the first goes on to its shard
            rows = [(-1, True, owner_id, b"", names) for owner_id, names in _listed(owner[many], name[many])]
            owner, name, many = owner[~same], name[~same], many[~same]
            shard = (name >> np.uint64(32)).astype(np.int64)
            for flag in (False, True):
                mine = np.flatnonzero(many == flag)
                mine = mine[np.lexsort((owner[mine], shard[mine]))]
                cut = np.searchsorted(shard[mine], np.arange(shards + 1))
                for s in range(shards):
                    part = mine[cut[s]:cut[s + 1]]
                    if len(part):
                        ids, counts = np.unique(owner[part], return_counts=True)
                        packed = ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes()
                        rows.append((s, flag, 0, packed, name[part].astype("<u4").tobytes()))
            return pd.DataFrame(rows, columns=["shard", "known", "owner", "owners", "names"])

        for frame in frames:
            for text in frame["text"].tolist():
                raw = _raw(text)
                if len(raw) < plan.length or (me := owner_of(raw)) in held:
                    continue
                held[me] = np.unique(np.concatenate([m[np.append(True, m[1:] != m[:-1])] for _, m in minimisers(raw, plan)]))
                size += len(held[me])
                if size >= 2_000_000:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    @tidy
    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owners, names, known, shard = [], [], [], 0
        found: list[tuple[int, bytes]] = []
        for frame in frames:
            ready = frame["shard"] < 0
            found += zip(frame.loc[ready, "owner"].tolist(), frame.loc[ready, "names"].tolist(), strict=True)
            for row in frame[~ready].itertuples():
                both = np.frombuffer(row.owners, "<i8")
                ids, counts = both[:len(both) // 2], both[len(both) // 2:]
                owners.append(np.repeat(ids, counts))
                names.append(np.frombuffer(row.names, "<u4"))
                known.append(np.full(len(names[-1]), row.known))
                shard = row.shard
        if owners:
            owner, name, counted = np.concatenate(owners), np.concatenate(names), np.concatenate(known)
            order = np.lexsort((owner, name))
            owner, name, counted = owner[order], name[order], counted[order]
            new = np.ones(len(name) + 1, bool)
            new[1:-1] = name[1:] != name[:-1]
            start = np.flatnonzero(new[:-1])
            several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
            mine = several[np.cumsum(new[:-1]) - 1] & ~counted
            full = name[mine].astype(np.uint64) | np.uint64(shard) << np.uint64(32)
            found += _listed(owner[mine], full)
        # a row for each bucket of owners, not for each owner
        packed: dict[int, list[tuple[int, bytes]]] = {}
        for owner_id, of in found:
            packed.setdefault(owner_id % shards, []).append((owner_id, of))
        if packed:
            yield pd.DataFrame([(bucket, [o for o, _ in rows], [x for _, x in rows]) for bucket, rows in packed.items()],
                               columns=["bucket", "owners", "names"])

    @tidy
    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[int, list[bytes]] = {}
        for frame in frames:
            for owners, names in zip(frame["owners"], frame["names"], strict=True):
                for owner, part in zip(owners, names, strict=True):
                    of.setdefault(int(owner), []).append(part)
        if of:
            yield pd.DataFrame({"owner": np.array(list(of), np.int64), "names": list(of.values())})

    sent = texts.mapInPandas(mapped, "shard int, known boolean, owner long, owners binary, names binary")
    to = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(F.pmod(F.col("owner"), F.lit(shards)).cast("int"))
    packed = sent.repartitionById(shards, to).mapInPandas(met, "bucket int, owners array<long>, names array<binary>")
    return packed.repartitionById(shards, F.col("bucket")).mapInPandas(gathered, "owner long, names array<binary>")


def _runs(raw: bytes, shared: np.ndarray, shards: int, plan: DedupPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first, end) of runs of strings with one shared minimiser; positions of strings."""
    keys, first, end = [], [], []
    for at, key in minimisers(raw, plan):
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(cut[1:], len(key))
        name = _names(key[cut], shards)
        mine = shared[np.minimum(np.searchsorted(shared, name), len(shared) - 1)] == name
        for a, b in zip(cut[mine].tolist(), last[mine].tolist(), strict=True):
            for c in range(a, b, plan.run):
                keys.append(key[a])
                first.append(at + c)
                end.append(at + min(b, c + plan.run))
    return np.array(keys, np.uint64), np.array(first, np.int64), np.array(end, np.int64)


def _smallest_owners(strings: list[bytes], key: np.ndarray, least: np.ndarray, rows: np.ndarray,
                     plan: DedupPlan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, end, doc): for every distinct run, the smallest document of each of its strings, where it
    may remove something."""
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    several = counts[inverse] > 1
    width = np.array([len(s) for s in strings], np.int64) - plan.length + 1
    alone = np.flatnonzero(~several & (rows > 1))
    mine = np.flatnonzero(several)
    of = np.repeat(np.arange(len(mine)), width[mine])
    shift = np.cumsum(width[mine]) - width[mine]
    low = least[mine][of]
    if len(mine):
        string, offset, group = repeated_prefixes([strings[i] for i in mine], plan.length)
        if len(group):
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            best = np.minimum.reduceat(least[mine][string], start)
            low[shift[string] + offset] = np.repeat(best, np.diff(np.append(start, len(group))))
    # runs of strings of one text with the same smallest document
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(of))
    text = of[first]
    keep = (rows[mine][text] > 1) | (low[first] < least[mine][text])
    first, end, text = first[keep], end[keep], text[keep]
    return (np.concatenate([alone, mine[text]]), np.concatenate([np.zeros(len(alone), np.int64), first - shift[text]]),
            np.concatenate([width[alone], end - shift[text]]), np.concatenate([least[alone], low[first]]))


def heavy_keys(runs: DataFrame, plan: DedupPlan) -> DataFrame | None:
    """(key) of the minimisers whose distinct runs exceed ``key_bytes``; None if there are none.  At most one key for
    ``key_bytes`` of runs reaches the driver."""
    spark = runs.sparkSession

    def above(sizes: DataFrame) -> DataFrame | None:
        rows = sizes.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > plan.key_bytes).select("key").collect()
        return F.broadcast(spark.createDataFrame([(r["key"],) for r in rows], "key long")) if rows else None

    # with equal runs first, of two short columns; then without
    able = above(runs.select("key", "size"))
    return able and above(runs.join(able, "key", "left_semi").groupBy("key", "string").agg(F.first("size").alias("size")))


def split_owners(distinct: DataFrame, plan: DedupPlan, salts: int = 16) -> DataFrame:
    """As ``_smallest_owners``, of runs (key, string, sid, least, rows) cut into strings of ``length`` bytes, which are
    aggregated by their bytes before the shuffle and joined back over ``salts`` tasks."""
    places = F.explode(F.sequence(F.lit(0), F.length("string") - plan.length))
    cut = distinct.select("key", "sid", "least", "rows", "string", places.alias("at")).select(
        "key", "sid", "least", "rows", "at", F.expr(f"substring(string, at + 1, {plan.length})").alias("bytes"),
        F.pmod("sid", F.lit(salts)).cast("int").alias("salt"))
    best = cut.groupBy("bytes").agg(F.min("least").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "bytes", "low", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = cut.join(best, ["bytes", "salt"], "left").withColumn("low", F.coalesce("low", "least")).where("rows > 1 or low < least")
    # strings that follow each other with the same smallest document
    nth = F.row_number().over(Window.partitionBy("key", "sid", "low").orderBy("at"))
    return found.select("key", "sid", "low", "at", (F.col("at") - nth).alias("island")).groupBy("key", "sid", "low", "island").agg(
        F.min("at").cast("long").alias("first"), (F.max("at") + 1).cast("long").alias("end")).select(
        "key", "sid", "first", "end", F.col("low").alias("least"))


def dedup(docs: DataFrame, plan: DedupPlan = DedupPlan()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    one = docs.select(doc_key(docs).alias("k"), F.col("text").cast("string").alias("text"))

    @tidy
    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [_raw(t) for t in frame["text"].tolist()]
            yield pd.DataFrame({"k": frame["k"].to_numpy(), "owner": [owner_of(r) for r in raw], "digest": [
                blake2b(r, digest_size=16).digest() for r in raw], "n_bytes": [len(r) for r in raw], "sha": [sha256(r).hexdigest() for r in raw]})

    table = cut_lineage(one.mapInPandas(sized, "k long, owner long, digest binary, n_bytes long, sha string"))
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    shards, parts = max(1, math.ceil(total / plan.shard_bytes)), max(1, math.ceil(total / plan.part_bytes))
    first = table.groupBy("digest").agg(F.min("k").alias("rep"), F.first("owner").alias("owner"))
    shared = cut_lineage(shared_minimisers(one, shards, plan).join(first.select("owner", "rep"), "owner"))

    def with_text(ids: DataFrame) -> DataFrame:
        """(k, owner, text) of the documents ``ids`` names by rep; a bitmap keeps most others out of the shuffle."""
        bits = spark.sparkContext.broadcast(common.bitmap(ids.select(F.col("rep").alias("doc_id")), plan.bitmap_bits))

        @tidy
        def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame[common.in_bitmap(bits.value, frame["slot"].to_numpy())]
                yield pd.DataFrame({"k": frame["k"].to_numpy(), "owner": np.array([owner_of(_raw(t)) for t in frame["text"].tolist()], np.int64),
                                    "text": frame["text"].to_numpy()})

        slot = common.bitmap_slot(F.col("k"), plan.bitmap_bits)
        return one.select("k", "text", slot.alias("slot")).mapInPandas(named, "k long, owner long, text string")

    @tidy
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 128):
                keys, places, strings, ks, owners = [], [], [], [], []
                for row in frame.iloc[at:at + 128].itertuples():
                    raw = _raw(row.text)
                    key, a, b = _runs(raw, np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in row.names])), shards, plan)
                    strings += [raw[x:y + plan.length - 1] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    keys.append(key)
                    places.append(a)
                    ks.append(np.full(len(a), row.k))
                    owners.append(np.full(len(a), row.owner))
                if strings:
                    yield pd.DataFrame({"key": np.concatenate(keys).astype(np.int64), "string": strings, "size": [len(x) for x in strings], "k": np.concatenate(ks),
                                        "owner": np.concatenate(owners), "pos": np.concatenate(places)})

    texts = with_text(shared)
    runs = texts.join(shared.select(F.col("rep").alias("k"), "owner", "names"), ["k", "owner"]).mapInPandas(
        cut, "key long, string binary, size int, k long, owner long, pos long")
    path = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    runs.write.option("compression", "zstd").parquet(path)  # read twice; the strings' overlaps compress well
    del texts, runs
    common.release(spark)
    runs = spark.read.parquet(path)
    sid = F.xxhash64("string")  # names a run together with its minimiser

    @tidy
    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames) or [pd.DataFrame()])
        if not len(frame):
            return
        keys, sids = frame["key"].to_numpy(), frame["sid"].to_numpy()
        i, first_string, end, low = _smallest_owners(frame["string"].tolist(), keys, frame["least"].to_numpy(), frame["rows"].to_numpy(), plan)
        yield pd.DataFrame({"key": keys[i], "sid": sids[i], "first": first_string, "end": end, "least": low})

    heavy = heavy_keys(runs, plan)
    light = runs if heavy is None else runs.join(heavy, "key", "left_anti")
    distinct, whole = (r.groupBy("key", "string").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("rows")) for r in (
        light, runs if heavy is None else runs.join(heavy, "key", "left_semi")))
    (distinct.repartitionById(parts, F.pmod("key", F.lit(parts)).cast("int")).withColumn("sid", sid)
     .mapInPandas(merged, "key long, sid long, first long, end long, least long")
     .write.option("compression", "zstd").parquet(f"{path}-least"))
    if heavy is not None:
        split_owners(cut_lineage(whole.withColumn("sid", sid)), plan).write.mode("append").option("compression", "zstd").parquet(f"{path}-least")
    del distinct, whole, light  # their shuffles are the largest
    common.release(spark)
    least = spark.read.parquet(f"{path}-least")
    spans = (runs.select("key", sid.alias("sid"), "k", "owner", "pos").join(least, ["key", "sid"]).where("least < k")
             .groupBy("k", "owner").agg(F.collect_list(F.struct(
                 (F.col("pos") + F.col("first")).alias("a"), (F.col("pos") + F.col("end") + (plan.length - 1)).alias("b"))).alias("spans")))
    spans = cut_lineage(spans)
    del runs, least
    common.release(spark)

    @tidy
    def removed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                kept, n_removed, n_spans = cut_out(_raw(row.text), [(s["a"], s["b"]) for s in row.spans])
                out.append((row.k, row.owner, n_removed, n_spans, sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["k", "owner", "n_removed", "n_spans", "kept"])

    changed = with_text(spans.select(F.col("k").alias("rep"))).join(spans, ["k", "owner"]).mapInPandas(
        removed, "k long, owner long, n_removed long, n_spans long, kept string").dropDuplicates(["k", "owner"])
    copy = (F.col("rep") < F.col("k")) & (F.col("n_bytes") >= plan.length)
    nothing = sha256(b"").hexdigest()
    return table.join(first.select("digest", "rep"), "digest").join(changed, ["k", "owner"], "left").select(
        F.when(F.col("k") != common.NULL_KEY, F.col("k")).alias("doc_id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the spans (start, end; they may overlap), how many bytes go, in how many runs."""
    kept, at, n_removed, n_spans = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > at or not n_spans:
            kept.append(raw[at:a])
            n_spans += 1
            n_removed += b - a
            at = b
        elif b > at:
            n_removed += b - at
            at = b
    kept.append(raw[at:])
    return b"".join(kept), n_removed, n_spans


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))
