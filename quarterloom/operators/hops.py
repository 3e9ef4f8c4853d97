"""Sums of hops between the members of a graph's lists, 512 sources at a time, one bit each.

A list holds nodes that are neighbours of each other. Memory: the lists of one graph (about 60 bytes an
entry) and one bit per node (and list) and source of a block, whatever the number of sources.
"""

from __future__ import annotations

import numpy as np

#: Sources of a block, and entries that are gathered at once.
BLOCK, GATHER = 512, 16_384


class Lists:
    """Ragged lists of row numbers of another table; no list is empty."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = values, sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def pick(self, rows: np.ndarray) -> Lists:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        return Lists(self.values[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes)

    def turned(self, n: int) -> Lists:
        """Of each of ``n`` members the lists that hold it."""
        order = np.argsort(self.values, kind="stable")
        return Lists(np.repeat(np.arange(len(self.sizes)), self.sizes)[order], np.bincount(self.values, minlength=n))

    def any(self, marks: np.ndarray) -> np.ndarray:
        """The lists with a marked member."""
        return np.logical_or.reduceat(marks[self.values], self.starts) if len(self.sizes) else np.zeros(0, bool)

    def either(self, bits: np.ndarray) -> np.ndarray:
        """Per list the bitwise OR of its members' rows."""
        out = np.empty((len(self.sizes), bits.shape[1]), bits.dtype)
        i = 0
        while i < len(out):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + GATHER, side="right")))
            out[i:j] = np.bitwise_or.reduceat(bits[self.values[lo : self.ends[j - 1]]], self.starts[i:j] - lo, axis=0)
            i = j
        return out


def largest_component(holders: Lists, n: int) -> np.ndarray:
    """The members of the component with most nodes, of several the one with the least node, in order."""
    label, held = np.arange(n), holders.turned(n)
    while True:
        of_list = np.minimum.reduceat(label[holders.values], holders.starts)
        new = np.minimum.reduceat(of_list[held.values], held.starts)
        new = new[new]
        if (new == label).all():
            return np.flatnonzero(label == np.bincount(label, minlength=n).argmax())
        label = new


def hop_sums(holders: Lists, n: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """For each of the ``n`` nodes of a connected graph the sum of its hops to the sources, which are every
    ``parts``-th block of nodes from block ``part`` on.

    A level is a bitwise OR over each list and back. Only lists beside a node that the last level changed are
    read again, and only nodes that lack sources are written. A node lacks a source at as many levels as it is hops away.
    """
    total, held = np.zeros(n, np.int64), holders.turned(n)
    for lo in range(part * BLOCK, n, parts * BLOCK):
        own = np.arange(min(BLOCK, n - lo))
        ball = np.zeros((n, (len(own) + 63) // 64), np.uint64)
        ball[lo + own, own // 64] = np.left_shift(np.uint64(1), (own % 64).astype(np.uint64))
        of_list = np.zeros((len(holders.sizes), ball.shape[1]), np.uint64)
        count = np.zeros(n, np.int64)
        count[lo + own] = 1
        changed = count > 0
        while True:
            lacks = count < len(own)
            total += len(own) - count
            if not lacks.any():
                break
            again = holders.any(changed) & holders.any(lacks)
            of_list[again] = (holders if again.all() else holders.pick(np.flatnonzero(again))).either(ball)
            into = np.flatnonzero(lacks & held.any(again))
            ball[into] = (held if len(into) == n else held.pick(into)).either(of_list)
            now = np.bitwise_count(ball[into]).sum(axis=1, dtype=np.int64)
            changed = np.zeros(n, bool)
            changed[into] = now > count[into]
            count[into] = now
            if not changed.any():
                raise ValueError("the graph is not connected")
    return total
