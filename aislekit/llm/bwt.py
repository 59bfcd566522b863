"""Burrows-Wheeler transforms of string collections, merged by iterative interleave refinement.

A shard is a list of byte strings; its suffixes, each ended by a terminator of its own string, are sorted once, which
gives its transform (the byte before each suffix) and, by counting, where the suffix that starts with that byte
stands (the last-to-first mapping).  To merge shards, only their interleave is refined: the list of all
shards' entries, which starts as shard after shard, right for prefixes of length 0.  One pass reads the
transforms in the order of the interleave and deals the entries out by the byte read, which makes it right for prefixes
one byte longer (the code takes two bytes at once).  Ranks whose prefixes are equal so far carry one group number, dealt out along with them, so common
prefixes and repeated intervals come from the same passes, and suffixes are never compared again.  An entry alone in
its group stays alone with any byte before it, so it is left out of further passes.

Bytes 0xFE and 0xFF must not occur (they do not in UTF-8).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _joined(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one, with a 0 after each string, and the start of each string."""
    lengths = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF becomes 0
    return raw, np.cumsum(lengths + 1) - lengths - 1


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes up to their terminators; equal ones in order of position.

    Ranks of prefixes of 8 bytes are doubled in length until all suffixes differ or end.
    """
    n = len(text)
    end = np.flatnonzero(text == 0)
    left = np.repeat(end, np.diff(end, prepend=-1)) - np.arange(n)  # bytes before the terminator
    eight = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(7, np.uint8)), 8)
    key = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)
    short = np.flatnonzero(left < 8)  # bytes after a terminator do not count
    drop = (64 - 8 * left[short]).astype(np.uint64)
    key[short] = np.where(drop < 64, key[short] >> (drop % 64) << (drop % 64), np.uint64(0))
    order = np.argsort(key)
    step = 8
    while True:
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        longer = left >= step
        if new.all():
            return order
        if not longer.any():
            return np.argsort(rank * n + np.arange(n))  # equal suffixes by position
        after = np.zeros(n, np.int64)
        at = np.flatnonzero(longer)
        after[at] = rank[at + step]
        key = rank * (n + 1) + after
        order = np.argsort(key)
        step *= 2


class Shard:
    """Transform of some strings, suffixes in order: ``before`` (the byte plus one before each, 0 at a string's
    start), ``last_to_first`` (the rank of the suffix that starts there), and the suffix as string and offset."""

    def __init__(self, strings: Sequence[bytes]):
        text, starts = _joined(strings)
        order = suffix_order(text)
        before = np.zeros(len(text), np.uint8)
        before[1:] = text[:-1]
        before[starts] = 0
        self.before = before[order]
        self.last_to_first = np.empty(len(order), np.int32)
        self.last_to_first[np.argsort(self.before, kind="stable")] = np.arange(len(order), dtype=np.int32)
        self.string = (np.searchsorted(starts, order, side="right") - 1).astype(np.int32)
        self.offset = (order - starts[self.string]).astype(np.int32)


def merge(shards: Sequence[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, group): the merged ranks whose prefix of ``depth`` bytes occurs more than once.  Entries count
    through shard after shard; equal prefixes have equal groups and stand together."""
    shift = np.cumsum([0] + [len(x.before) for x in shards])
    before = np.concatenate([x.before for x in shards])
    back = np.concatenate([x.last_to_first + np.int32(f) for x, f in zip(shards, shift, strict=False)])
    # two passes at once: both bytes before an entry, and where the suffix stands that starts with them
    twice = before[back].astype(np.uint16) << np.uint16(8) | before
    twice[(before == 0) | (before[back] == 0)] = 0
    steps = [(before, back)] * (depth % 2) + [(twice, back[back])] * (depth // 2)
    entry = np.arange(shift[-1], dtype=np.int32)
    group = np.zeros(len(entry), np.int32)
    for bytes_before, to in steps:
        read = bytes_before[entry]
        deal = np.argsort(read, kind="stable")
        deal = deal[np.count_nonzero(read == 0):]  # nothing stands before a string's start
        entry, byte, old = to[entry[deal]], read[deal], group[deal]
        new = np.ones(len(entry) + 1, bool)
        new[1:-1] = (byte[1:] != byte[:-1]) | (old[1:] != old[:-1])
        group = np.cumsum(new[:-1], dtype=np.int32)
        alone = new[:-1] & new[1:]
        if np.count_nonzero(alone) * 4 > len(entry):
            entry, group = entry[~alone], group[~alone]
    again = np.zeros(len(group), bool)
    again[1:] = group[1:] == group[:-1]
    again[:-1] |= group[1:] == group[:-1]
    return entry[again], group[again]


def repeated_prefixes(strings: Sequence[bytes], depth: int, shard_bytes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, group) of every place where ``depth`` bytes begin that also begin elsewhere in the strings;
    equal ones share a group."""
    shards, firsts, at = [], [], 0
    while at < len(strings):
        size, start = 0, at
        while at < len(strings) and (size < shard_bytes):
            size += len(strings[at]) + 1
            at += 1
        shards.append(Shard(strings[start:at]))
        firsts.append(start)
    if not shards:
        none = np.empty(0, np.int64)
        return none, none, none
    entry, group = merge(shards, depth)
    string = np.concatenate([x.string + np.int32(f) for x, f in zip(shards, firsts, strict=True)])[entry]
    return string, np.concatenate([x.offset for x in shards])[entry], group
