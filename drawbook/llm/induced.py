"""Suffix order and common prefixes of a string by external induced sorting, in batches.

The leftmost-S suffixes are sorted first: their substrings get names, and the suffixes of the string of names are sorted
by the same method, or by doubling of ranks once they fit in memory. All other suffixes follow by induction: a suffix is
taken from the queue in order, and the suffix one place to its left is put into the queue of its first symbol. A queue's
key is (first symbol, arrival), and arrivals come in suffix order, so the queue is one array with an append point per
symbol, written and read in sequence; beyond ``memory`` bytes it lives in a file. Each entry carries its common prefix
with the entry before it; that of an induced suffix is one more than the least value passed since the last arrival in the
same queue, kept per symbol from batch to batch.
"""

from __future__ import annotations

import tempfile

import numpy as np

BATCH = 1 << 18


class Scratch:
    """Arrays in memory, or in files of a task's own temporary folder where they are large. Files go with the object."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.count = memory, None, 0

    def empty(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.memory:
            return np.empty(n, kind)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory(prefix="suffixes-")
        self.count += 1
        return np.memmap(f"{self.folder.name}/{self.count}", kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last (its symbol is the only smallest one) counts as such."""
    n = len(text)
    rises = np.empty(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[-1] = 1
    steps = np.flatnonzero(rises)
    return np.repeat(rises[steps] > 0, np.diff(np.concatenate([[-1], steps])))


def packed_symbols(text: np.ndarray, at: np.ndarray, end: np.ndarray, take: int, bits: int) -> np.ndarray:
    """The next ``take`` symbols of each span as one number; past the end the symbol above all others."""
    key = np.zeros(len(at), np.int64)
    above = (1 << bits) - 1
    for j in range(take):
        inside = at + j < end
        key = (key << bits) | np.where(inside, text[np.minimum(at + j, len(text) - 1)].astype(np.int64), above)
    return key


def split_groups(rank: np.ndarray, members: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Refines ``rank`` (index of an element's group in the order) by ``key`` among ``members``; returns members of groups still shared."""
    old = rank[members]
    if old.any():  # one number holds group and key
        if len(key) and int(key.max()) >= 1 << 31:
            key = np.unique(key, return_inverse=True)[1]
        turn = np.argsort((old << 32) | (key + 1))
    else:
        turn = np.argsort(key)
    members, key = members[turn], key[turn]
    old = rank[members]
    new_group = np.ones(len(members), bool)
    new_group[1:] = old[1:] != old[:-1]
    fresh = new_group.copy()
    fresh[1:] |= key[1:] != key[:-1]
    index = np.arange(len(members))
    group_at = np.maximum.accumulate(np.where(new_group, index, 0))
    fresh_at = np.maximum.accumulate(np.where(fresh, index, 0))
    rank[members] = old + (fresh_at - group_at)
    alone = fresh & np.concatenate([fresh[1:], [True]])
    return members[~alone]


def name_substrings(text: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Rank of each leftmost-S substring (up to and with the next such position); equal substrings share one.

    Of two substrings one of which begins the other, the shorter is the greater: where it ends, its suffix rises.
    """
    bits = max(2, int(symbols + 1).bit_length())
    take = 62 // bits
    end = np.concatenate([lms[1:] + 1, [len(text)]])
    rank = np.zeros(len(lms), np.int64)
    shared, offset = np.arange(len(lms)), 0
    while len(shared):
        shared = split_groups(rank, shared, packed_symbols(text, lms[shared] + offset, end[shared], take, bits))
        offset += take
        if len(shared):
            longer = np.zeros(len(lms) + 1, bool)
            longer[rank[shared[end[shared] - lms[shared] > offset]]] = True
            shared = shared[longer[rank[shared]]]
    return rank


def double_ranks(rank: np.ndarray, depth: int) -> None:
    """Sorts the suffixes of the string of ranks, in place, as far as their first ``depth`` symbols."""
    shared, reach = np.arange(len(rank)), 1
    counts = np.bincount(rank, minlength=len(rank))
    shared = shared[counts[rank] > 1]
    while len(shared) and reach < depth:
        following = np.where(shared + reach < len(rank), rank[np.minimum(shared + reach, len(rank) - 1)], -1)
        shared = split_groups(rank, shared, following)
        reach *= 2


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, at most ``depth``."""
    out = np.zeros(len(a), np.int64)
    padded = np.concatenate([text, np.full(depth, -1, text.dtype if text.dtype.kind == "i" else np.int32)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    for k in range(0, len(a), 8192):
        same = rows[a[k: k + 8192]] == rows[b[k: k + 8192]]
        first = np.argmin(same, axis=1)
        out[k: k + 8192] = np.where(same[np.arange(len(first)), first], depth, first)
    return out


class Queues:
    """Queues of suffixes by first symbol, and the pushes of a scan into them."""

    def __init__(self, sizes: np.ndarray, scratch: Scratch, depth: int, total: int):
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.head = self.start[:-1].copy()
        self.item = scratch.empty(int(self.start[-1]), np.int32 if total < 2**31 else np.int64)
        self.depth = depth
        self.common = scratch.empty(int(self.start[-1]), np.uint8) if depth else None
        self.least = np.full(len(sizes), depth, np.uint8)

    def push(self, items: np.ndarray, common: np.ndarray | None, chosen: np.ndarray, symbol: np.ndarray) -> None:
        """``items`` in scan order, their common prefixes with the item scanned before; those ``chosen`` push the place to their left."""
        if not len(items):
            return
        if not len(chosen):
            if self.depth:
                np.minimum(self.least, common.min(), out=self.least)
            return
        turn = np.argsort(symbol, kind="stable")
        at, symbol = chosen[turn], symbol[turn]
        first = np.ones(len(at), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.concatenate([heads, [len(at)]]))
        target = np.repeat(self.head[symbol[heads]] - heads, sizes) + np.arange(len(at))
        self.item[target] = items[at] - 1
        if self.depth:
            since = np.zeros(len(at), np.int64)
            since[1:] = at[:-1] + 1
            since[heads] = 0
            table = self._minima(common)
            value = self._least(table, since, at)
            value[heads] = np.minimum(value[heads], self.least[symbol[heads]])
            value = np.minimum(value.astype(np.int16) + 1, self.depth).astype(np.uint8)
            value[heads[self.head[symbol[heads]] == self.start[symbol[heads]]]] = 0
            self.common[target] = value
            np.minimum(self.least, common.min(), out=self.least)
            last = at[heads + sizes - 1]
            rest = np.full(len(last), self.depth, np.uint8)
            inner = last + 1 < len(items)
            rest[inner] = self._least(table, last[inner] + 1, np.full(int(inner.sum()), len(items) - 1))
            self.least[symbol[heads]] = rest
        self.head[symbol[heads]] += sizes

    @staticmethod
    def _minima(common: np.ndarray) -> np.ndarray:
        """Minima of all runs whose length is a power of two."""
        n = len(common)
        table = np.empty((n.bit_length(), n), np.uint8)
        table[0] = common
        for k in range(1, len(table)):
            half = 1 << (k - 1)
            np.minimum(table[k - 1, : n - half], table[k - 1, half:], out=table[k, : n - half])
            table[k, n - half:] = table[k - 1, n - half:]
        return table

    @staticmethod
    def _least(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        return np.minimum(table[level, lo], table[level, hi + 1 - (1 << level.astype(np.int64))])


def suffix_order(text: np.ndarray, symbols: int, depth: int, memory: int, in_memory: int, with_common: bool = True):
    """Sorts the suffixes of ``text`` (symbols below ``symbols``, the last one the only smallest) by their first ``depth`` symbols at least.

    Returns (falling, rising, borders): the queues of suffixes that are larger (ascending) and smaller (descending) than the
    next one, and for each symbol with both the common prefix of the last falling and the least rising one.
    """
    n = len(text)
    scratch = Scratch(memory)
    rising = s_types(text)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    rank = name_substrings(text, lms, symbols)
    if len(lms) > in_memory and len(np.unique(rank)) < len(lms):
        names = np.unique(rank, return_inverse=True)[1]
        falling_names, rising_names, _ = suffix_order(names, int(names.max()) + 1, depth, memory, in_memory, False)
        order = sorted_items(falling_names, rising_names, len(names))
        rank[order] = np.arange(len(order))
        falling_names.scratch.close()
    else:
        double_ranks(rank, depth)
    seeds = lms[np.argsort(rank, kind="stable")]
    if with_common:
        seed_common = np.zeros(len(seeds), np.uint8)
        seed_common[1:] = common_prefixes(text, seeds[:-1], seeds[1:], depth)
    carried = depth if with_common else 0
    seed_symbol = text[seeds]
    present = np.unique(text)
    cuts = np.searchsorted(seed_symbol, present), np.searchsorted(seed_symbol, present, "right")

    falls = Queues(np.bincount(text[~rising], minlength=symbols), scratch, carried, n)
    falls.scratch = scratch
    borders: dict[int, int] = {}
    for c, a, b in zip(present.tolist(), *(x.tolist() for x in cuts), strict=True):
        done = int(falls.start[c])
        while done < falls.head[c]:
            end = min(int(falls.head[c]), done + BATCH)
            items = np.array(falls.item[done:end])
            symbol = text[np.maximum(items - 1, 0)]
            chosen = np.flatnonzero((symbol >= c) & (items > 0))
            falls.push(items, np.array(falls.common[done:end]) if carried else None, chosen, symbol[chosen])
            done = end
        for k in range(a, b, BATCH):
            items = seeds[k: min(b, k + BATCH)]
            common = None
            if carried:
                common = seed_common[k: k + len(items)].copy()
                if k == a:
                    common[0] = common_prefixes_one(text, int(falls.item[done - 1]), int(items[0]), depth) if done > falls.start[c] else 0
            chosen = np.flatnonzero(items > 0)
            falls.push(items, common, chosen, text[items[chosen] - 1])

    counts = np.bincount(text[rising], minlength=symbols)
    counts[text[-1]] -= 1
    rises = Queues(counts, scratch, carried, n)
    rises.scratch = scratch
    for c in present[::-1].tolist():
        done = int(rises.start[c])
        while done < rises.head[c]:
            end = min(int(rises.head[c]), done + BATCH)
            items = np.array(rises.item[done:end])
            symbol = text[np.maximum(items - 1, 0)]
            chosen = np.flatnonzero((symbol <= c) & (items > 0))
            rises.push(items, np.array(rises.common[done:end]) if carried else None, chosen, symbol[chosen])
            done = end
        lo, hi = int(falls.start[c]), int(falls.start[c + 1])
        if carried and hi > lo:
            borders[c] = common_prefixes_one(text, int(rises.item[done - 1]), int(falls.item[hi - 1]), depth) if done > rises.start[c] else 0
        for top in range(hi, lo, -BATCH):
            low = max(lo, top - BATCH)
            items = np.array(falls.item[low:top])[::-1]
            common = None
            if carried:
                above = np.empty(top - low, np.uint8)
                above[:-1] = falls.common[low + 1: top]
                above[-1] = falls.common[top] if top < hi else borders[c]
                common = above[::-1]
            symbol = text[np.maximum(items - 1, 0)]
            chosen = np.flatnonzero((symbol < c) & (items > 0))
            rises.push(items, common, chosen, symbol[chosen])
    return falls, rises, borders


def common_prefixes_one(text: np.ndarray, a: int, b: int, depth: int) -> int:
    x, y = text[a: a + depth], text[b: b + depth]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def sorted_items(falls: Queues, rises: Queues, n: int) -> np.ndarray:
    """All suffixes in order; the last, which begins with the only smallest symbol, is the first."""
    parts = [np.array([n - 1])]
    for c in range(len(falls.head)):
        parts.append(np.asarray(falls.item[falls.start[c]: falls.start[c + 1]], np.int64))
        parts.append(np.asarray(rises.item[rises.start[c]: rises.start[c + 1]], np.int64)[::-1])
    return np.concatenate(parts)


def repeated_windows(segments: list[bytes], width: int, memory: int = 64 << 20, in_memory: int = 1 << 24) -> list[np.ndarray]:
    """For each segment, whether the string of ``width`` bytes at each start also starts at another place of the segments."""
    total = sum(map(len, segments)) + len(segments) + 1
    text = np.empty(total, np.int16)
    at, starts = 0, []
    for s in segments:
        text[at: at + len(s)] = np.frombuffer(s, np.uint8)
        text[at: at + len(s)] += 2
        text[at + len(s)] = 1
        starts.append(at)
        at += len(s) + 1
    text[-1] = 0
    falls, rises, borders = suffix_order(text, 258, width, memory, in_memory)
    flags = np.zeros(total, bool)
    for queue in (falls, rises):
        for k in range(0, len(queue.item), BATCH):
            hit = np.flatnonzero(queue.common[k: k + BATCH] >= width) + k
            flags[queue.item[hit]] = True
            flags[queue.item[hit - 1]] = True
    for c, common in borders.items():
        if common >= width:
            flags[falls.item[falls.start[c + 1] - 1]] = True
            flags[rises.item[rises.start[c + 1] - 1]] = True
    falls.scratch.close()
    return [flags[a: a + max(0, len(s) - width + 1)] for a, s in zip(starts, segments, strict=True)]
