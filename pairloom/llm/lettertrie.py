"""Words at one edit from each other, by a trie over their letter-group counts.

The code points of a word fall into groups; level g of the trie is the number of code points in group g. One inserted code point
raises one count by one, a replaced one raises one and lowers one, or neither. So a search from one word for those that are longer
by one, or as long and different, goes down the trie with a budget of one surplus and one deficit. Of two words of one length
only that one searches whose counts are first to be lower, so the deficit is spent after the surplus only; words of equal counts
compare their spelling. Every near pair is found once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .words import mix, span_hashes

GROUPS = 24
#: Below so many words a node is not divided further.
SMALL_NODE = 16
#: Pairs that are compared at once.
AT_ONCE = 1 << 18
PADDED = 32


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


@dataclass
class Words:
    words: np.ndarray  # of str

    def __post_init__(self):
        listed = self.words.tolist()
        self.size = np.fromiter(map(len, listed), np.int64, len(listed))
        self.codes = np.frombuffer("".join(listed).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size

    def counts(self, first: int = 0, last: int = GROUPS) -> np.ndarray:
        """How many code points of each word lie in the groups ``first`` to ``last``; a group is a remainder of code points."""
        rows = np.repeat(np.arange(len(self.words)), self.size)
        group = self.codes % GROUPS
        inside = (group >= first) & (group < last)
        cells = rows[inside] * (last - first) + (group[inside] - first)
        return np.bincount(cells, minlength=len(self.words) * (last - first)).reshape(-1, last - first).astype(np.int32)

    def padded(self) -> np.ndarray:
        """The first PADDED code points of every word, 0 behind the end."""
        at = np.arange(PADDED)[None, :] + self.starts[:, None]
        inside = at < self.ends[:, None]
        return np.where(inside, self.codes[np.minimum(at, max(len(self.codes) - 1, 0))] if len(self.codes) else 0, 0).astype(np.uint32)

    def halves(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the head of size // 2 code points and of the tail of the other size - size // 2."""
        mixed = mix(self.codes.astype(np.uint64) + np.uint64(1))
        head = size // 2
        return span_hashes(mixed, self.starts, self.starts + head), span_hashes(mixed, self.ends - (size - head), self.ends)


def _one_edit(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For rows of padded code points: one replaced where ``same``, else one inserted in b."""
    differ = a != b
    shifted = a[:, :-1] != b[:, 1:]
    last = np.where(shifted.any(1), PADDED - 2 - np.argmax(shifted[:, ::-1], 1), -1)
    return np.where(same, differ.sum(1) == 1, last < np.argmax(differ, 1))


class Trie:
    """The indexed words in the order of their counts: a node is a range of them."""

    def __init__(self, words: np.ndarray):
        counts = Words(words).counts()
        order = np.lexsort(counts.T[::-1])
        self.all = Words(words[order])
        self.order, self.counts = order, counts[order]
        self.code = self.all.padded()
        size = self.all.size
        self.equal = self.all.halves(size)  # as a word of the length of the searching one
        self.longer = self.all.halves(np.maximum(size - 1, 0))  # as a word longer by one

    def pairs(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in ``words``, place in the indexed words) of the near pairs found from ``words``; in portions."""
        search = Words(words)
        self.search, self.search_code, self.search_halves = search, search.padded(), search.halves(search.size)
        wanted = search.counts()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        for q, w in self._candidates(wanted):
            held.append((q, w))
            n_held += len(q)
            if n_held >= AT_ONCE // 4:
                yield self._verified(held)
                held, n_held = [], 0
        if held:
            yield self._verified(held)

    def _candidates(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(wanted)
        # Depth first: a node, the words that search in it, and what they have spent: 0 nothing, 1 the surplus, 2 both.
        stack = [(0, len(self.counts), 0, np.arange(n), np.zeros(n, np.int8))]
        while stack:
            low, high, depth, q, spent = stack.pop()
            if depth == GROUPS or high - low <= SMALL_NODE:
                if depth == GROUPS and (high - low) * len(q) > AT_ONCE // 16:
                    yield from self._by_halves(low, high, q, spent)
                else:
                    step = max(1, AT_ONCE // (high - low))
                    for at in range(0, len(q), step):
                        yield self._compared(wanted, low, high, depth, q[at : at + step], spent[at : at + step])
                continue
            values = self.counts[low:high, depth]
            cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
            own = wanted[q, depth]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low]):
                more = values[a] - own
                goes = (more == 0) | ((more == 1) & (spent == 0)) | ((more == -1) & (spent == 1))
                if goes.any():
                    stack.append((low + a, low + b, depth + 1, q[goes], spent[goes] + (more[goes] != 0)))

    def _compared(self, wanted: np.ndarray, low: int, high: int, depth: int, q: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all words of a small node those that share a half and keep the budget."""
        wide = high - low
        q, spent, w = np.repeat(q, wide), np.repeat(spent, wide), np.tile(np.arange(low, high), len(q))
        longer = self.all.size[w] - self.search.size[q]
        head = np.where(longer == 0, self.equal[0][w], self.longer[0][w]) == self.search_halves[0][q]
        tail = np.where(longer == 0, self.equal[1][w], self.longer[1][w]) == self.search_halves[1][q]
        fits = (head | tail) & ((longer == 0) | (longer == 1))
        q, w, spent = q[fits], w[fits], spent[fits]
        more = self.counts[w, depth:] - wanted[q, depth:]
        left = more != 0
        none = ~left.any(1)
        surplus, deficit = (spent > 0) + (more > 0).sum(1), (spent > 1) + (more < 0).sum(1)
        first = more[np.arange(len(q)), np.argmax(left, 1)] if more.shape[1] else np.zeros(len(q), np.int32)
        small = (np.abs(more) <= 1).all(1) & (surplus <= 1) & (deficit <= 1) & ((spent > 0) | none | (first > 0))
        return q[small], w[small]

    def _by_halves(self, low: int, high: int, q: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of many words of equal counts those whose head or whose tail is that of the searching word: looked up, not compared."""
        for longer, halves in ((False, self.equal), (True, self.longer)):
            some = q[(spent == 1) == longer]
            for side in (0, 1):
                keys = halves[side][low:high]
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                asked = self.search_halves[side][some]
                a, b = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
                n = b - a
                upto = np.cumsum(n)
                at = 0
                while at < len(some):
                    stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
                    k = n[at:stop]
                    place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(a[at:stop], k)
                    left, right = np.repeat(some[at:stop], k), low + order[place]
                    if side:  # pairs that share both halves were found by the head
                        new = halves[0][right] != self.search_halves[0][left]
                        left, right = left[new], right[new]
                    yield left, right
                    at = stop

    def _verified(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        q, w = (np.concatenate(x) for x in zip(*held))
        same = self.search.size[q] == self.all.size[w]
        ok = _one_edit(self.search_code[q], self.code[w], same)
        for i in np.flatnonzero(self.all.size[w] > PADDED):
            ok[i] = near(self.search.words[q[i]], self.all.words[w[i]])
        # Equal counts: of two words, the smaller one searches.
        tie = np.flatnonzero(ok & same)
        if len(tie):
            a, b = self.search_code[q[tie]], self.code[w[tie]]
            differ = a != b
            at = np.argmax(differ, 1)
            x, y = a[np.arange(len(tie)), at], b[np.arange(len(tie)), at]
            for i in np.flatnonzero(~differ.any(1)):  # they differ beyond what is padded
                x[i], y[i] = next((ord(c), ord(d)) for c, d in zip(self.search.words[q[tie[i]]], self.all.words[w[tie[i]]]) if c != d)
            ok[tie[(x % GROUPS == y % GROUPS) & (x > y)]] = False
        return q[ok], self.order[w[ok]]
