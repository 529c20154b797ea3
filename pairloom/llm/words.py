"""Words of a column of texts as flat numpy arrays: where they start and end, and a 64-bit hash of each.

Everything works on the UTF-8 bytes of a slice of an Arrow batch. Slices hold whole texts, so memory is bounded by
``SLICE_BYTES`` or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
#: Of texts that are filtered in place: models and caches of several stages are in the worker then.
KEEP_BYTES = 1 << 19
#: White space between words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RANDOM = np.random.default_rng(20240229)
BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}
MOST_POWERS = 4 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept by the process up to MOST_POWERS."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16) if n > MOST_POWERS // 2 else max(1 << 16, 2 * n)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= MOST_POWERS:
            _POWERS[base] = have
    return have[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run codes[start:end], equal for equal runs wherever they lie."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often a mask over bytes or words holds inside each text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[bounds])


@dataclass
class Texts:
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # n + 1 places where texts begin and end

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    @cached_property
    def _word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        word = ~SPACE[self.data]
        edge = np.zeros(len(word) + 1, bool)
        edge[self.bounds] = True
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return starts, ends

    @property
    def starts(self) -> np.ndarray:
        return self._word_spans[0]

    @property
    def ends(self) -> np.ndarray:
        return self._word_spans[1]

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Words of text i are word_bounds[i] to word_bounds[i + 1]."""
        return np.searchsorted(self.starts, self.bounds)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @cached_property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(BYTE_CODE[self.data], self.starts, self.ends)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of every run of ``size`` words inside one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.text_of_word[:n] == self.text_of_word[size - 1 :])
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * np.uint64(BASE) + hashes[k : k + n]
        return first, mix(total[first])

    def lower(self) -> Texts:
        """The same texts with A-Z lower-cased."""
        data = self.data.copy()
        data[(data >= 0x41) & (data <= 0x5A)] |= 0x20
        return Texts(data, self.bounds)


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return Texts(raw, bounds - bounds[0])


def slices(batches: Iterator[pa.RecordBatch], text_column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches into runs of rows with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            part = batch.slice(at, stop - at)
            yield part, texts_of(part.column(text_column))
            at = stop


def keep_rows(docs: DataFrame, text_column: str, keep: Callable[[Texts, np.ndarray | None], np.ndarray], extra: Column | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, for which ``keep`` says so from their texts (and the values of ``extra``).

    Nothing is shuffled. Columns keep their names and types, whatever they are called.
    """
    name, plain = "extra", extra is None
    while name in docs.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_column, KEEP_BYTES):
            if plain:
                yield part.filter(pa.array(keep(texts, None)))
            else:
                values = part.column(name).to_numpy(zero_copy_only=False)
                yield part.drop_columns([name]).filter(pa.array(keep(texts, values)))

    source = docs if plain else docs.withColumn(name, extra)
    return source.mapInArrow(run, docs.schema)


#: Parts that the rows of a group are thinned in before they meet.
PARTS = 64


def first_rows(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of every group in the given order; of rows that agree in it any.

    A hot group is thinned in PARTS parts first, so no task sorts it alone: at most PARTS * n rows of a group meet, whatever its share.
    """
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    thin = part.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).where(F.col("_place") <= n).drop("_part", "_place")
    return thin.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= n).drop("_place")
