"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, then exact similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import majority
from .words import Texts, keep_rows, slices, texts_of

SHINGLE = 5
#: 64 bits in 8 blocks: within 23 differing bits some block has at most two.
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Text of benchmark items that is held by a task at a time; a larger benchmark is searched in several passes.
ITEM_BYTES = 16 << 20
FILTER_BITS = 20


def _near_values(most: int) -> np.ndarray:
    """For every block value the values that differ in at most ``most`` bits."""
    flips = [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(BLOCK_BITS), k)]
    return np.arange(1 << BLOCK_BITS)[:, None] ^ np.array(flips)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all values in the ranges starts .. starts + sizes."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


class Items:
    """Benchmark items that share a shingle size: shingles, fingerprints and the multi-index."""

    def __init__(self, ids: np.ndarray, texts: Texts, size: int, radius: int):
        self.size, self.radius = size, radius
        first, hashes = texts.windows(texts.hashes, size)
        bounds = np.searchsorted(first, texts.word_bounds)
        self.ids, self.words, self.n_shingles = ids, texts.n_words, np.diff(bounds)
        self.prints = majority(hashes, bounds)
        # Which items have a shingle, and how often.
        owner = np.repeat(np.arange(len(ids)), self.n_shingles)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        self.hashes, self.owner, self.count = hashes[at], owner[at], np.diff(np.append(at, len(hashes)))
        self.different = np.unique(self.hashes)
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(self.different >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        # (number of words, block, value of the block) -> items with a value that is near enough.
        self.lengths = np.unique(self.words)
        near = _near_values(radius // BLOCKS)
        rank = np.searchsorted(self.lengths, self.words)
        keys, who = [], []
        for b in range(BLOCKS):
            value = (self.prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            keys.append(((rank[:, None] * BLOCKS + b) << BLOCK_BITS | near[value]).ravel())
            who.append(np.repeat(np.arange(len(ids)), near.shape[1]))
        keys, who = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(keys, kind="stable")
        self.listed = who[order]
        self.list_at = np.searchsorted(keys[order], np.arange((len(self.lengths) * BLOCKS << BLOCK_BITS) + 1))

    def candidates(self, prints: np.ndarray, length_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all items of a window's length within the radius of its fingerprint."""
        found = []
        for b in range(BLOCKS):
            value = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & ((1 << BLOCK_BITS) - 1)
            key = (length_rank * BLOCKS + b) << BLOCK_BITS | value
            window, place = _ranges(self.list_at[key], self.list_at[key + 1] - self.list_at[key])
            item = self.listed[place]
            near = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[near] * len(self.ids) + item[near])
        both = np.unique(np.concatenate(found))
        return both // len(self.ids), both % len(self.ids)

    def search(self, texts: Texts, least: float) -> list[np.ndarray]:
        """Columns (text, item, first word, words, differing bits, similarity) of all windows that are similar enough."""
        first, hashes = texts.windows(texts.hashes, self.size)
        maybe = np.flatnonzero(self.present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.different, hashes[maybe]), len(self.different) - 1)
        hits = maybe[self.different[at] == hashes[maybe]]
        if not len(hits):
            return [np.zeros(0)] * 6

        # Windows as long as an item (or as the whole text, if that is shorter) that hold a shingle of the item.
        low, high = np.searchsorted(self.hashes, hashes[hits], "left"), np.searchsorted(self.hashes, hashes[hits], "right")
        which, place = _ranges(low, high - low)
        hit, length = hits[which], np.searchsorted(self.lengths, self.words[self.owner[place]])
        once = np.unique(hit * len(self.lengths) + length)
        hit, length = once // len(self.lengths), once % len(self.lengths)
        bounds = np.searchsorted(first, texts.word_bounds)
        text = np.searchsorted(bounds, hit, "right") - 1
        shingles = np.minimum(self.lengths[length] - self.size + 1, bounds[text + 1] - bounds[text])
        lowest = np.maximum(hit - shingles + 1, bounds[text])
        highest = np.minimum(hit, bounds[text + 1] - shingles)
        which, start = _ranges(lowest, np.maximum(highest - lowest + 1, 0))
        once = np.unique(start * len(self.lengths) + length[which])
        start, length = once // len(self.lengths), once % len(self.lengths)
        text = np.searchsorted(bounds, start, "right") - 1
        shingles = np.minimum(self.lengths[length] - self.size + 1, bounds[text + 1] - bounds[text])

        rows = []
        for a in range(0, len(start), 50_000):  # keeps the working arrays small
            rows.append(self._verified(hashes, hits, start[a : a + 50_000], length[a : a + 50_000], shingles[a : a + 50_000], least))
        start, item, bits, similarity, n = (np.concatenate(c) for c in zip(*rows))
        text = np.searchsorted(bounds, start, "right") - 1
        return [text, item, first[start] - texts.word_bounds[text], n + self.size - 1, bits, similarity]

    def _verified(self, hashes, hits, start, length, shingles, least):
        # Fingerprints of the windows, from running sums over the shingles they cover.
        covered = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(covered, start, 1)
        np.add.at(covered, start + shingles, -1)
        used = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        ones = np.zeros((len(used) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(hashes[used].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32, out=ones[1:])
        place = np.searchsorted(used, start)
        over_half = 2 * (ones[place + shingles] - ones[place]) > shingles[:, None]
        prints = np.packbits(over_half, axis=1, bitorder="little").view("<u8").ravel()
        window, item = self.candidates(prints, length)

        # The shingles both have can be no more than those of a window that any item has.
        own, theirs = shingles[window], self.n_shingles[item]
        before = np.searchsorted(hits, start)
        within = (np.searchsorted(hits, start + shingles) - before)[window]
        open_ = within >= least * (own + theirs - within) - 1e-9
        window, item, own, theirs = window[open_], item[open_], own[open_], theirs[open_]

        # Exact: the smaller count of every shingle, summed, against the larger.
        pair, at = _ranges(start[window], own)
        order = np.lexsort((hashes[at], pair))
        pair, value = pair[order], hashes[at][order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (value[1:] != value[:-1])
        runs = np.flatnonzero(new)
        count = np.diff(np.append(runs, len(pair)))
        pair, value = pair[runs], value[runs]
        other = self._count(value, item[pair])
        shared = np.bincount(pair, np.minimum(count, other), len(window))
        similarity = shared / (own + theirs - shared)
        kept = similarity >= least
        window, item = window[kept], item[kept]
        return start[window], item, np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64), similarity[kept], own[kept]

    def _count(self, value: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How often each shingle occurs in each item."""
        rank = np.searchsorted(self.different, value)
        known = rank < len(self.different)
        known[known] = self.different[rank[known]] == value[known]
        if not hasattr(self, "_pairs"):
            self._pairs = np.searchsorted(self.different, self.hashes) * len(self.ids) + self.owner
        key = rank * len(self.ids) + item
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(known & (self._pairs[at] == key), self.count[at], 0)


def compiled(ids: np.ndarray, texts: Texts, size: int = SHINGLE, radius: int = RADIUS) -> list[Items]:
    """Items by shingle size: ``size`` words, or all words of a shorter item. Items without words are left out."""
    texts = texts.lower()
    found = []
    for k in range(1, size + 1):
        chosen = np.flatnonzero((texts.n_words == k) if k < size else (texts.n_words >= size))
        if len(chosen):
            parts = [texts.data[texts.bounds[i] : texts.bounds[i + 1]] for i in chosen]
            own = Texts(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
            found.append(Items(ids[chosen], own, k, radius))
    return found


def _portions(docs: DataFrame, benchmark: DataFrame, size: int, radius: int, item_column: str, item_text: str) -> Iterator[Broadcast]:
    """The compiled benchmark in portions of about ITEM_BYTES of text, each sent to the executors."""
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(total // ITEM_BYTES) + 1
    for k in range(passes):
        portion = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).distinct().orderBy("item", "text").toArrow()
        yield docs.sparkSession.sparkContext.broadcast(compiled(np.array(portion.column("item").to_pylist(), object), texts_of(portion.column("text").combine_chunks()), size, radius))


def leaks(
    docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.8, size: int = SHINGLE, radius: int = RADIUS,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per text and benchmark item it holds: id, item id, similarity, bits, first_word, n_words of the best window.

    A window has as many words as the item, or is the whole text if that is shorter. Its shingles (``size`` lower-cased words,
    repeats counted; all words of a shorter item) are weighted by how often they occur, and windows and items are similar by the sum of the
    smaller over the sum of the larger weights. Windows are found as follows. Those that share no shingle with any item have similarity
    0 and are passed over; every other window gets a 64-bit SimHash. Items whose fingerprint lies within ``radius`` bits come from
    an index of eight blocks, of which one differs in ``radius // 8`` bits at most. Candidates are verified exactly. With the
    default radius a window of similarity 0.8 differs in about 10 bits, so next to none is missed.

    Texts pass no shuffle. The benchmark is read in portions of about ITEM_BYTES of text, each searched in a pass over the texts. Null and
    empty texts and items give no rows; item ids must be whole numbers or null; repeated rows give repeated results; of equal windows the first is returned.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item long, similarity double, bits long, first_word long, n_words long"
    found = None
    for shared in _portions(docs, benchmark, size, radius, item_column, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches, "text"):
                lower = texts.lower()
                for own in shared.value:
                    text, item, word, n, bits, similarity = own.search(lower, min_similarity)
                    if len(text):
                        best = np.lexsort((word, -similarity, item, text))
                        keep = np.ones(len(best), bool)
                        keep[1:] = (text[best][1:] != text[best][:-1]) | (item[best][1:] != item[best][:-1])
                        best = best[keep]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("id").take(pa.array(text[best])), pa.array(own.ids[item][best], pa.int64()), *[pa.array(c[best]) for c in (similarity, bits, word, n)]],
                            schema=pa.schema([("id", part.schema.field("id").type), ("item", pa.int64()), ("similarity", pa.float64()), ("bits", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64())]),
                        )

        one = source.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.withColumnRenamed("id", id_column).withColumnRenamed("item", item_column)


def clean(
    docs: DataFrame, benchmark: DataFrame, min_similarity: float = 0.8, size: int = SHINGLE, radius: int = RADIUS,
    text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``leaks`` has no row for."""
    for shared in _portions(docs, benchmark, size, radius, item_column, item_text):

        def free(texts: Texts, _, shared=shared) -> np.ndarray:
            lower, bad = texts.lower(), np.zeros(texts.n, bool)
            for own in shared.value:
                bad[own.search(lower, min_similarity)[0].astype(np.int64)] = True
            return ~bad

        docs = keep_rows(docs, text_column, free)
    return docs
