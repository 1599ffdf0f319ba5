"""Signature trees over sets of 64-bit hashes, and their dual traversal.

A leaf holds one set: its size and a bitmap of its members. A node holds the OR of the bitmaps below
it, their range of sizes, and the largest number of members that share a bit with others of their
own set. Two nodes can hold a pair that is similar enough only if their sizes are close enough and
the bits they have in common leave room for the overlap the pair needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FAN = 8


@dataclass
class Level:
    bits: np.ndarray  # (nodes, words)
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray


def width_for(largest: int) -> int:
    """Bits of a bitmap for sets of up to ``largest`` members, a power of two."""
    return max(64, 1 << (4 * largest - 1).bit_length())


def tree(sets: list[np.ndarray], width: int) -> list[Level]:
    """Levels from the leaves up; sets come ordered by size, each sorted and distinct."""
    shift = np.uint64(64 - (width.bit_length() - 1))
    bits = np.zeros((len(sets), width // 8), np.uint8)
    flags = np.zeros(width, bool)
    for i, s in enumerate(sets):
        at = s >> shift
        flags[at] = True
        bits[i] = np.packbits(flags)
        flags[at] = False
    bits = bits.view(np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    levels = [Level(bits, size, size, size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
    while len(levels[-1].low) > FAN:
        below = levels[-1]
        at = np.arange(0, len(below.low), FAN)
        levels.append(
            Level(
                np.bitwise_or.reduceat(below.bits, at, axis=0),
                np.minimum.reduceat(below.low, at),
                np.maximum.reduceat(below.high, at),
                np.maximum.reduceat(below.slack, at),
            )
        )
    return levels


def _may_link(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the largest possible overlap below nodes ``i`` of a and ``j`` of b is enough."""
    near = (a.high[i] * 100 >= b.low[j] * percent) & (b.high[j] * 100 >= a.low[i] * percent)
    common = np.zeros(len(i), np.int64)
    step = max(1, (1 << 19) // a.bits.shape[1])
    for k in range(0, len(i), step):
        part = slice(k, k + step)
        both = a.bits[i[part]] & b.bits[j[part]]
        common[part] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    most = np.minimum(
        np.minimum(a.high[i], b.high[j]), common + np.minimum(a.slack[i], b.slack[j])
    )
    return near & (most * (100 + percent) >= percent * (a.low[i] + b.low[j]))


def candidates(a: list[Level], b: list[Level] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that may reach ``percent`` Jaccard; with ``b`` None, pairs i < j within ``a``."""
    alone = b is None
    b = a if alone else b
    top_a, top_b = len(a) - 1, len(b) - 1
    i = np.repeat(np.arange(len(a[top_a].low)), len(b[top_b].low))
    j = np.tile(np.arange(len(b[top_b].low)), len(a[top_a].low))
    while True:
        if alone:
            keep = (i <= j) if top_a else (i < j)
            i, j = i[keep], j[keep]
        keep = _may_link(a[top_a], b[top_b], i, j, percent)
        i, j = i[keep], j[keep]
        if top_a == 0 and top_b == 0:
            return i, j
        if top_a >= top_b:
            top_a, i, j = top_a - 1, *_children(i, j, len(a[top_a - 1].low))
        if top_b > top_a or (alone and top_b):
            top_b, j, i = top_b - 1, *_children(j, i, len(b[top_b - 1].low))


def _children(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``i`` replaced by its children among ``n`` nodes, ``j`` repeated."""
    child = (i[:, None] * FAN + np.arange(FAN)).ravel()
    there = child < n
    return child[there], np.repeat(j, FAN)[there]


class Groups:
    """Groups of numbers that grow together."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[inverse].tolist()

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.parent))])


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each group of ``n`` numbers that pairs tie together."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


CHUNK = 4096


def _left(
    sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the traversal leaves; numbers of b follow those of a."""
    width = width_for(max(len(s) for s in sets_a + (sets_b or [])))
    tree_b = None if sets_b is None else tree(sets_b, width)
    i, j = candidates(tree(sets_a, width), tree_b, percent)
    return i, j if sets_b is None else j + len(sets_a)


def every_link(
    sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that reach ``percent``; numbers of b follow those of a.

    Every pair that the traversal leaves is compared member by member, by bitmaps with a bit of its
    own for each member that two sets have.
    """
    every = sets_a + (sets_b or [])
    i, j = _left(sets_a, sets_b, percent)
    if not len(i):
        return i, j
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    size = np.array([len(every[k]) for k in used], np.int64)
    ends = np.cumsum(size)
    _, member, seen = np.unique(
        np.concatenate([every[k] for k in used]), return_inverse=True, return_counts=True
    )
    place = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[member]
    words = int((seen > 1).sum()) // 64 + 1
    bits = np.zeros((len(used), words), np.uint64)
    for k, (start, end) in enumerate(zip(ends - size, ends, strict=True)):
        flags = np.zeros(words * 64, bool)
        own = place[start:end]
        flags[own[own >= 0]] = True
        bits[k] = np.packbits(flags).view(np.uint64)
    x, y = at[: len(i)], at[len(i) :]
    keep = np.zeros(len(i), bool)
    step = max(1, (1 << 19) // words)
    for k in range(0, len(i), step):
        part = slice(k, k + step)
        common = np.bitwise_count(bits[x[part]] & bits[y[part]]).sum(axis=1, dtype=np.int64)
        keep[part] = 100 * common >= percent * (size[x[part]] + size[y[part]] - common)
    return i[keep], j[keep]


def links(
    sets_a: list[np.ndarray],
    sets_b: list[np.ndarray] | None,
    percent: int,
    groups: Groups,
) -> list[tuple[int, int]]:
    """Pairs that reach ``percent`` and join two groups; numbers of b follow those of a.

    Not every link: a pair whose ends are in one group already is not compared, as which documents
    hang together does not change by it. ``every_link`` returns them all.
    """
    every = sets_a + (sets_b or [])
    i, j = _left(sets_a, sets_b, percent)
    found = []
    for k in range(0, len(i), CHUNK):
        roots = groups.roots()
        a, b = i[k : k + CHUNK], j[k : k + CHUNK]
        apart = roots[a] != roots[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            gx, gy = groups.find(x), groups.find(y)
            if gx != gy and similar(every[x], every[y], percent):
                groups.parent[max(gx, gy)] = min(gx, gy)
                found.append((x, y))
    return found


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 * intersection >= percent * union."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)
