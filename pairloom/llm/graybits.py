"""A hierarchical index over 64-bit fingerprints in Gray order, for all pairs within a number of differing bits.

The rows of a group are sorted by Gray rank, so neighbours differ in few bits. Runs of FAN rows make a node that holds the bits
its rows share; runs of nodes make the nodes above. Pairs of nodes are searched from the top: the shared bits in
which two nodes differ are a lower bound for all pairs below them, and whole groups fall away once it passes the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa

BITS = 64
FAN = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
FRONTIER = 1 << 20


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the sequence of Gray codes."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def key_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of which at least one agrees in full between any two values within ``radius``.

    The 64 bits are cut into ``blocks`` runs; at most ``radius`` of them can differ, so some choice of the others agrees.
    """
    if not radius < blocks <= BITS:
        raise ValueError(f"needs more than {radius} blocks and at most {BITS}")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(runs, blocks - radius)]


class Level:
    """Nodes of one height: the bits they share (``pattern`` under ``mask``) and the run of nodes below each."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray, group: np.ndarray, below: np.ndarray | None):
        self.pattern, self.mask, self.group, self.below = pattern, mask, group, below

    def above(self) -> Level | None:
        """The next level, or None when every group has one node."""
        new = np.ones(len(self.group), bool)
        new[1:] = self.group[1:] != self.group[:-1]
        if new.all():
            return None
        first = np.flatnonzero(new)
        place = np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))
        starts = np.flatnonzero(place % FAN == 0)
        ones, some = np.bitwise_and.reduceat(self.pattern, starts), np.bitwise_or.reduceat(self.pattern, starts)
        mask = np.bitwise_and.reduceat(self.mask, starts) & ~(ones ^ some)
        return Level(ones & mask, mask, self.group[starts], np.append(starts, len(new)))


def close_pairs(values: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) with i < j of the same group, in portions; rows must be sorted by group and Gray rank."""
    levels = [Level(values, np.full(len(values), ALL), groups, None)]
    while (level := levels[-1].above()) is not None:
        levels.append(level)
    top = np.arange(len(levels[-1].group))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        height, a, b = stack.pop()
        if height == 0:
            differ = np.bitwise_count(values[a] ^ values[b])
            near = (differ <= radius) & (a < b)
            yield a[near], b[near], differ[near]
            continue
        below, under = levels[height].below, levels[height - 1]
        size_a, size_b = below[a + 1] - below[a], below[b + 1] - below[b]
        total = np.cumsum(size_a * size_b)
        cuts = [0, *(np.searchsorted(total, np.arange(FRONTIER, total[-1], FRONTIER)) + 1).tolist(), len(a)] if len(a) else []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x >= y:
                continue
            n = size_a[x:y] * size_b[x:y]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(size_b[x:y], n)
            left, right = np.repeat(below[a[x:y]], n) + at // wide, np.repeat(below[b[x:y]], n) + at % wide
            bound = np.bitwise_count((under.pattern[left] ^ under.pattern[right]) & under.mask[left] & under.mask[right])
            open_ = (bound <= radius) & (left <= right)
            stack.append((height - 1, left[open_], right[open_]))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row is linked with, over any number of links; links come in portions."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, low, high = a[differ], b[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Regroup sorted batches so that no value of ``key`` is cut; a group must fit in memory."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(values, values[-1], "left"))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == values[-1]:
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
