"""Hierarchical index over codes in Gray order, for linking codes at a small bit distance.

Codes sorted by the rank that the reflected Gray code gives them differ little
from their neighbours. ``FANOUT`` neighbours make a node, which keeps the bits
they share (a masked pattern); nodes make nodes in turn. Two nodes whose shared
bits differ in more than the allowed number of places have no close codes below
them, so both groups go at once; on the way down the masks fill up and the
differences add up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
#: Pairs of nodes looked at in one step.
PAIRS = 1 << 20


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of every uint64 code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


@dataclass
class Level:
    """Nodes of one height: shared ones, bits set anywhere, first child and first leaf (with an end mark)."""

    ones: np.ndarray
    some: np.ndarray
    child: np.ndarray
    leaf: np.ndarray


def _build(codes: np.ndarray, group: np.ndarray) -> list[Level]:
    levels = [Level(codes, codes, np.arange(len(codes) + 1), np.arange(len(codes) + 1))]
    groups = int((np.diff(group) != 0).sum()) + 1
    while len(levels[-1].ones) > groups:
        low = levels[-1]
        begins = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
        first = np.flatnonzero(place % FANOUT == 0)
        levels.append(Level(np.bitwise_and.reduceat(low.ones, first), np.bitwise_or.reduceat(low.some, first),
                            np.append(first, len(group)), np.append(low.leaf[first], len(codes))))
        group = group[first]
    return levels


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked leaves one label, the smaller one, in place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label[:] = parent[label]


def _children(level: Level, a: np.ndarray, b: np.ndarray, leaves: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unordered pairs of a child of each ``a`` and a child of its ``b``."""
    nb = level.child[b + 1] - level.child[b]
    n = (level.child[a + 1] - level.child[a]) * nb
    pair = np.repeat(np.arange(len(a)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    i, j = level.child[a[pair]] + at // nb[pair], level.child[b[pair]] + at % nb[pair]
    keep = (a[pair] != b[pair]) | ((i < j) if leaves else (i <= j))
    return i[keep], j[keep]


def link(codes: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the codes of each group that lie ``most`` or fewer bits apart.

    Returns (code, representative) pairs of uint64: every code that shares a
    component with another code of its group, apart from the representative
    itself. Groups that lie in one component already are not searched again,
    so a dense group costs no list of its pairs.
    """
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    label = np.arange(len(codes))
    levels = _build(codes, group)
    top = len(levels) - 1
    root = np.arange(len(levels[top].ones))
    root = root[np.diff(levels[top].leaf) > 1]
    todo = [(top, root, root)] if top else []
    while todo:
        height, a, b = todo.pop()
        upper, lower = levels[height], levels[height - 1]
        size = np.diff(upper.child)
        steps = np.searchsorted(np.cumsum(size[a] * size[b]), PAIRS) + 1
        if steps < len(a):
            todo.append((height, a[steps:], b[steps:]))
            a, b = a[:steps], b[:steps]
        low = np.minimum.reduceat(label, upper.leaf[:-1])
        high = np.maximum.reduceat(label, upper.leaf[:-1])
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        i, j = _children(upper, a[open_], b[open_], leaves=height == 1)
        differ = (lower.ones[i] ^ lower.ones[j]) & ~(lower.ones[i] ^ lower.some[i]) & ~(lower.ones[j] ^ lower.some[j])
        near = np.bitwise_count(differ) <= most
        i, j = i[near], j[near]
        if height == 1:
            _merge(label, i, j)
        elif len(i):
            todo.append((height - 1, i, j))
    moved = label != np.arange(len(codes))
    return codes[moved], codes[label[moved]]
