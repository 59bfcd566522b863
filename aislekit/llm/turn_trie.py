"""Trie of conversation prefixes, as double arrays over shards of sorted turn paths.

Every conversation is rebuilt (``rebuild``) and becomes one path of 16-byte turn hashes; texts are never
shuffled.  Equal paths are reduced to one row with their number, smallest conv_id and the digest of their ids.
Paths are dealt in lexicographic ranges, so that a shard holds a run of the trie in preorder and only the nodes
on its first and last path can also lie in a neighbour.  In a shard the turns get dense ids, the trie is packed
into BASE and CHECK arrays, and the paths traverse these; what a shard knows of a node is a sum or a minimum, so the
shared upper nodes are completed by one small aggregate over all shards.

Defined cases: rows without conv_id belong to no conversation and are left out; turns with equal numbers stand in the
order of their md5; repeated rows are turns of their own; ids below zero have the base that Spark's ``%`` gives
(-5 belongs to 0); an empty table gives no node, not even a root.  Hashes of turns and paths have 128 bits and are
not verified.  A conversation's turns (20 bytes each) must fit into a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Turns of distinct paths in a shard.
SHARD_TURNS = 1 << 18
#: A conversation shares up to 5 first turns with the first of its hundred.
GROUP, SHARED = 100, 6
WIDTH = 16
#: Slots of the double array that are searched at once.
WINDOW = 2048
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, steps): the turns (h = md5 of role and text, n = code points of text) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("t"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("h"),
        F.length(text).alias("n")).where("conv_id is not null")
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "h", "n"))).alias("own"))
    own = own.select("conv_id", F.transform("own", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"))).alias("own"),
                     F.expr(f"conv_id - conv_id % {GROUP}").alias("_base"),
                     (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("_k"))
    first = own.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("_base"),
                                                      F.slice("own", 1, SHARED - 1).alias("_head"))
    both = own.join(first, "_base", "left")
    head = F.expr("case when _head is null then slice(own, 1, 0) else slice(_head, 1, _k) end")
    return both.select("conv_id", F.concat(head, F.expr("slice(own, _k + 1, size(own))")).alias("steps"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For rows sorted by path key and conv_id: per key its rows, smallest id and SHA-256 of its ids.  A key's ids pass
    through one digest in order, whatever their number, and are not held."""
    key, n, low, sha = None, 0, 0, None
    for frame in frames:
        keys, ids = frame["key"].to_numpy(), frame["conv_id"].to_numpy()
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
        done = []
        for a, b in zip(cut, np.append(cut[1:], len(keys)).astype(int), strict=True):
            listed = ",".join(map(str, ids[a:b].tolist())).encode()
            if keys[a] == key:
                sha.update(b"," + listed)
                n += b - a
                continue
            if key is not None:
                done.append((key, n, low, sha.hexdigest()))
            key, n, low, sha = keys[a], int(b - a), int(ids[a]), hashlib.sha256(listed)
        yield pd.DataFrame(done, columns=["key", "n", "conv_id", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, n, low, sha.hexdigest())], columns=["key", "n", "conv_id", "ends"])


def paths(rebuilt: DataFrame) -> DataFrame:
    """Distinct paths: path binary, sizes array<int>, n conversations, smallest conv_id, ends (digest of all ids)."""
    path = F.unhex(F.array_join(F.transform("steps", lambda x: F.hex(x["h"])), ""))
    rows = rebuilt.select("conv_id", path.alias("path"), F.transform("steps", lambda x: x["n"]).alias("sizes"))
    rows = cut_lineage(rows.withColumn("key", F.unhex(F.md5("path"))))
    ends = rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(
        _digests, "key binary, n long, conv_id long, ends string")
    once = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    return once.join(ends, "key").drop("key")


class DoubleArray:
    """A trie over dense codes: the child of state s by code c is t = BASE[s] + c if CHECK[t] = s.  Slot 0 is the root."""

    def __init__(self, room: int) -> None:
        self.base = np.zeros(room + 1, np.int64)
        self.check = np.full(room + 1, -1, np.int64)
        self.end = self.hint = 1

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def add_level(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Places the children of a level: distinct (parent, code), sorted.  Children with consecutive codes go one
        after the other behind all; others into the first gap that takes them, windows that are 95 % full left out."""
        start = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(start, len(parent)))
        low = code[start]
        close = code[start + count - 1] - low + 1 == count
        at = self.end + np.cumsum(np.where(close, count, 0)) - np.where(close, count, 0)
        total = int(count[close].sum())
        self._grow(self.end + total)
        self.base[parent[start[close]]] = at[close] - low[close]
        rows = np.repeat(close, count)
        slots = self.base[parent[rows]] + code[rows]
        self.check[slots] = parent[rows]
        self.end += total
        for s, n in zip(start[~close].tolist(), count[~close].tolist(), strict=True):
            codes, p = code[s:s + n], int(parent[s])
            shape = codes - codes[0]
            at = self.hint
            while True:
                self._grow(at + WINDOW + int(shape[-1]) + 1)
                free = np.flatnonzero(self.check[at:at + WINDOW] < 0) + at
                if len(free) < WINDOW // 20 and at == self.hint:
                    self.hint += WINDOW
                for step in shape[1:]:
                    free = free[self.check[free + step] < 0]
                if len(free):
                    break
                at += WINDOW
            self.base[p] = int(free[0]) - int(codes[0])
            self.check[free[0] + shape] = p
            self.end = max(self.end, int(free[0] + shape[-1]) + 1)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        to = self.base[state] + code
        if len(to) and (to.min() < 0 or to.max() >= len(self.check) or (self.check[to] != state).any()):
            raise ValueError("a path leaves the double array")
        return to


def dense_ids(turns: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Numbers of the distinct 16-byte turns, in order of the first (level, row) ``where`` each stands, which gives
    siblings neighbouring numbers."""
    if not len(turns):  # a shard of the turnless path alone
        return np.empty(0, np.int64)
    order = np.lexsort((where, turns[:, 1], turns[:, 0]))
    s = turns[order]
    new = np.append(True, (s[1:] != s[:-1]).any(axis=1))
    group = np.cumsum(new) - 1
    rank = np.empty(int(new.sum()), np.int64)
    rank[np.argsort(where[order][new], kind="stable")] = np.arange(len(rank))
    out = np.empty(len(turns), np.int64)
    out[order] = rank[group]
    return out


def _common(a: bytes | None, b: bytes) -> int:
    """Turns that two paths have in common; -1 without a first one."""
    if a is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x = np.frombuffer(a, np.uint8)[:n * WIDTH].reshape(n, WIDTH)
    y = np.frombuffer(b, np.uint8)[:n * WIDTH].reshape(n, WIDTH)
    other = np.flatnonzero((x != y).any(axis=1))
    return int(other[0]) if len(other) else n


SHARD_SCHEMA = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
                "n_children long, n_leaves long, gain long, cost long, ends string")


def shard_nodes(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard.  ``gain`` sums n_convs * length over a node's subtree here, ``cost`` sums the lengths of
    the nodes that no earlier shard has.  Nodes that a neighbour also has carry a key."""
    rows = rows.sort_values("path", ignore_index=True)
    seqs = rows["path"].tolist()
    before, after = (None if pd.isna(v) else bytes(v) for v in (edges["before"].iloc[0], edges["after"].iloc[0]))
    size = np.array([len(p) // WIDTH for p in seqs], np.int64)
    offset = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2).astype(np.uint64)
    lens = np.concatenate([np.asarray(v, np.int64) for v in rows["sizes"]]) if len(flat) else np.empty(0, np.int64)
    level = np.arange(len(flat)) - np.repeat(offset, size)
    code = dense_ids(flat, level * (len(seqs) + 1) + np.repeat(np.arange(len(seqs)), size))

    trie = DoubleArray(len(flat) + 1)
    n_of, low_of = rows["n"].to_numpy(np.int64), rows["conv_id"].to_numpy(np.int64)
    state = np.zeros(len(seqs), np.int64)
    levels: list[np.ndarray] = [np.zeros(1, np.int64)]
    members: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(seqs)), state.copy())]
    alive = np.flatnonzero(size > 0)
    while len(alive):
        d = len(levels) - 1
        edge = np.unique(np.stack([state[alive], code[offset[alive] + d]], axis=1), axis=0)
        trie.add_level(edge[:, 0], edge[:, 1])
        state[alive] = trie.step(state[alive], code[offset[alive] + d])
        levels.append(trie.step(edge[:, 0], edge[:, 1]))
        members.append((alive, state[alive].copy()))
        alive = alive[size[alive] > d + 1]

    room = trie.end
    n, low = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max)
    length, depth = np.zeros(room, np.int64), np.zeros(room, np.int64)
    for d, (who, at) in enumerate(members):
        np.add.at(n, at, n_of[who])
        np.minimum.at(low, at, low_of[who])
        depth[at] = d
        if d:
            length[at] = lens[offset[who] + d - 1]
    ends = np.full(room, None, object)
    ends[state] = rows["ends"].to_numpy()

    def route(path: int, upto: int) -> list[int]:
        """States of the nodes of depth 0 to ``upto`` on a path."""
        out = [0] if upto >= 0 else []
        for d in range(upto):
            out.append(int(trie.base[out[-1]] + code[offset[path] + d]))
        return out

    same = _common(before, seqs[0])
    inherited = route(0, same)
    shared = dict.fromkeys(inherited) | dict.fromkeys(route(len(seqs) - 1, _common(after, seqs[-1])))
    gain, cost = n * length, length.copy()
    cost[inherited] = 0
    children, leaves = np.zeros(room, np.int64), np.zeros(room, np.int64)
    for at in reversed(levels[1:]):
        leaves[at] += children[at] == 0
        up = trie.check[at]
        np.add.at(children, up, 1)
        for total in (leaves, gain, cost):
            np.add.at(total, up, total[at])
    leaves[0] += children[0] == 0
    children[inherited[:-1]] -= 1
    if before is not None and same == len(before) // WIDTH:  # the shard before took its last path for childless
        leaves[inherited] -= 1

    keys: dict[int, bytes] = {}
    for path, upto in ((0, same), (len(seqs) - 1, _common(after, seqs[-1]))):
        digest = hashlib.md5()
        for d, s in enumerate(route(path, upto)):
            if d:
                digest.update(seqs[path][(d - 1) * WIDTH:d * WIDTH])
            keys[s] = digest.copy().digest()
    node = np.concatenate(levels)
    parent = trie.check[node]
    open_parent = np.isin(parent, list(shared)) & (node > 0)
    below_root = depth[node] == 1  # the root's name is known to all
    key = [keys.get(s) for s in node.tolist()]
    return pd.DataFrame({
        "key": key, "parent_key": [keys[p] if o else None for p, o in zip(parent.tolist(), open_parent & ~below_root, strict=True)],
        "conv_id": low[node], "depth": depth[node],
        "parent_conv_id": pd.array(np.where(open_parent | (node == 0), 0, low[parent]), "Int64").copy(),
        "n_convs": n[node], "n_children": children[node], "n_leaves": leaves[node], "gain": gain[node],
        "cost": cost[node], "ends": ends[node]}).assign(
            parent_conv_id=lambda f: f["parent_conv_id"].mask(open_parent | (node == 0)))


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the module."""
    found = cut_lineage(paths(rebuild(conversations)))
    total, smallest = found.agg(F.sum(F.size("sizes")), F.min("conv_id")).first()
    shards = max(1, math.ceil((total or 0) / shard_turns))
    dealt = cut_lineage(found.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()))
    ends = dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    order = Window.orderBy("shard")  # two paths for a shard: one row for SHARD_TURNS turns
    ends = ends.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    nodes = cut_lineage(dealt.groupBy("shard").cogroup(ends.groupBy("shard")).applyInPandas(shard_nodes, SHARD_SCHEMA))
    upper = nodes.where("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "gain", "cost")], F.max("ends").alias("ends"))
    whole = nodes.where("key is null").unionByName(upper)
    names = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"))
    return whole.join(names, "parent_key", "left").select(
        "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.coalesce("parent_conv_id", "_up")).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("gain") - F.col("cost")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt ``conversations``."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB query of one row, the table of crc32, which ``crc32_sql`` expects as ``crc_table``.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_table"""


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of a string's UTF-8, byte by byte."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), "
            f"lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])))")


def turn_trie_sql() -> str:
    return f"""
WITH crc AS ({CRC_TABLE_SQL}),
turns AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
marked AS (SELECT *, {crc32_sql("c::VARCHAR")} % {SHARED} AS h FROM turns, crc),
rebuilt AS (
  SELECT m.c, list_concat(coalesce(b.own[1:m.h], []), m.own[m.h + 1:]) AS steps
  FROM marked m LEFT JOIN turns b ON b.c = m.c - m.c % 100),
prefix AS (SELECT c, d, steps[1:d] AS path, len(steps) AS total FROM rebuilt, UNNEST(range(len(steps) + 1)) AS u(d)),
node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE total = d), '')) AS ends
  FROM prefix GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_node AS (
  SELECT n.*, coalesce(k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE length(n.path[d].t) END AS size
  FROM node n LEFT JOIN kids USING (path)),
below AS (
  SELECT path[1:a] AS path, sum((k = 0)::INT) AS leaves, sum((n - 1) * size) AS saved
  FROM full_node, UNNEST(range(d + 1)) AS u(a) GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.k::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM full_node n JOIN below b ON b.path = n.path LEFT JOIN node p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
