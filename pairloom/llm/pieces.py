"""SentencePiece encoding by suffix-array matching and relaxation, and decoding, of whole columns of texts.

For byte-pair models with byte fallback whose normalizer only writes spaces as ``▁`` and puts one before the text. Inside,
``▁`` is the byte 0x20. Pieces never hold a ``▁`` after another character, so a text falls into units (spaces and what
follows them) that are encoded apart, and each different unit of a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_CODE, slices, span_hashes

SLICE = 1 << 20
MAX_UNITS = 1 << 18
MAX_IDS = 1 << 21
#: Text of units that is encoded at once.
UNIT_BYTES = 1 << 17
PAIR_SLOTS = 1 << 20
MARK = "▁"
SPACE_BYTE = 0x20


class Vocabulary:
    """The pieces of a model file, and which pairs of them may stand side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
        self.size = n
        self.unknown = n  # stands for a character without a piece; written as its bytes
        self.names = names
        self.score = {names[i]: model.get_score(i) for i in range(n) if not special[i]}
        if any(MARK in name.lstrip(MARK) for name in self.score):
            raise ValueError("pieces with a space after another character are not supported")
        self.ids = {name: i for i, name in enumerate(names) if not special[i]}
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_of = np.full(n, -1)
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
        self.control = np.array([model.is_control(i) for i in range(n)])
        self.unknown_id = model.unk_id()
        # Pieces to search for, in the order of their bytes.
        self.search = sorted((name.replace(MARK, " ").encode(), i) for name, i in self.ids.items())
        self.piece_id = np.array([i for _, i in self.search])
        self.piece_size = np.array([len(b) for b, _ in self.search])
        self.single = np.array([len(names[i]) == 1 for i in self.piece_id])
        longest = -(-int(self.piece_size.max()) // 8)
        padded = lambda fill: np.array([list(b.ljust(8 * longest, fill)) for b, _ in self.search], np.uint8).view(">u8").astype(np.uint64)
        self.low, self.high = padded(b"\x00"), padded(b"\xff")
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_value = np.zeros(PAIR_SLOTS, bool)
        self.units = Units()
        # For decoding: the bytes of every piece.
        shown = [b"" if self.control[i] else bytes([self.byte_of[i]]) if self.byte_of[i] >= 0 else " ⁇ ".encode() if i == self.unknown_id else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.shown_size = np.array([len(b) for b in shown])
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_size)[:-1]])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The pair merges of a short string: always the pair whose joint piece scores best, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, key: int) -> bool:
        left, right = divmod(int(key), self.size + 2)
        a = "" if left > self.unknown else self.names[left] if left < self.unknown else None
        b = self.names[right] if right < self.unknown else None
        if a is None or b is None:  # nothing merges with an unknown character
            return all(x is None or x == "" or self.merged(x) == [x] for x in (a, b))
        return self.merged(a + b) == ([a, b] if a else [b])

    def stands(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges of two neighbouring pieces' text give just these two; ``size + 1`` on the left is the unit's start."""
        key = left.astype(np.int64) * (self.size + 2) + right
        slot = (key * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        unseen = self.pair_key[slot] != key
        value = self.pair_value[slot]
        if unseen.any():
            new = pd.unique(key[unseen])
            found = np.fromiter((self._stands(k) for k in new.tolist()), bool, len(new))
            place = (new * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
            self.pair_key[place], self.pair_value[place] = new, found
            by_key = np.argsort(new)
            value[unseen] = found[by_key][np.searchsorted(new[by_key], key[unseen])]
        return value


class Units:
    """Encoded units by hash; starts anew when it holds MAX_UNITS units or MAX_IDS ids."""

    def __init__(self):
        self.hashes, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        at = np.concatenate([[0], np.cumsum(n)[:-1]]) + len(self.pool) if len(n) else np.zeros(0, np.int64)
        hashes, at, n = np.concatenate([self.hashes, hashes]), np.concatenate([self.at, at]), np.concatenate([self.n, n])
        order = np.argsort(hashes)
        self.hashes, self.at, self.n, self.pool = hashes[order], at[order], n[order], np.concatenate([self.pool, ids])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of known units, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _words_at(data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zero from ``stop`` on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        place = at + k
        inside = place < stop
        out = (out << np.uint64(8)) | np.where(inside, data[np.minimum(place, len(data) - 1)], 0).astype(np.uint64)
    return out


def occurrences(vocabulary: Vocabulary, data: np.ndarray, suffixes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, index of the piece) of every piece that occurs at one of the ``suffixes``, none reaching past its ``stop``.

    The suffixes are sorted by as many bytes as the longest piece has, eight at a time and later ones only among ties; two
    binary searches per piece then give the range of suffixes that begin with it.
    """
    first = _words_at(data, suffixes, stop)
    order = np.argsort(first)
    suffixes, stop, first = suffixes[order], stop[order], first[order]
    words = [first]
    tied = np.zeros(len(first), bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:]
    tied &= (first & np.uint64(0xFF)) != 0
    slots = np.flatnonzero(tied)
    for k in range(1, vocabulary.low.shape[1]):
        word = np.zeros(len(first), np.uint64)
        longer = np.flatnonzero(stop - suffixes > 8 * k)
        word[longer] = _words_at(data, suffixes[longer] + 8 * k, stop[longer])
        words.append(word)
    if len(slots):
        by = np.lexsort([w[slots] for w in reversed(words)])
        suffixes[slots], words = suffixes[slots[by]], [words[0], *[_moved(w, slots, by) for w in words[1:]]]
    low = np.searchsorted(words[0], vocabulary.low[:, 0], "left")
    high = np.searchsorted(words[0], vocabulary.high[:, 0], "right")
    for k in range(1, len(words)):
        for p in np.flatnonzero((vocabulary.piece_size > 8 * k) & (low < high)).tolist():
            part = words[k][low[p] : high[p]]
            base = low[p]
            low[p], high[p] = base + np.searchsorted(part, vocabulary.low[p, k], "left"), base + np.searchsorted(part, vocabulary.high[p, k], "right")
    n = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return suffixes[place], piece


def _moved(values: np.ndarray, slots: np.ndarray, by: np.ndarray) -> np.ndarray:
    values[slots] = values[slots[by]]
    return values


def encode_units(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many per unit) of units that lie one after the other in ``data``.

    Every occurrence of a piece is an edge from its first to behind its last character. Edges are sorted by the character at
    which they end and relaxed in that order: an edge reaches its end if the piece and the one that reaches its start
    may stand side by side. For byte-pair merges just one edge reaches each place, and the path back from
    the end of a unit is the library's result.
    """
    size = ends - starts
    begin, stop = np.repeat(starts, size), np.repeat(ends, size)
    char = (data & 0xC0) != 0x80
    suffixes = np.flatnonzero(char)
    source, piece = occurrences(vocabulary, data, suffixes, stop[suffixes])
    target, ids = source + vocabulary.piece_size[piece], vocabulary.piece_id[piece]

    # Characters without a piece of their own.
    covered = np.zeros(len(data), bool)
    covered[source[vocabulary.single[piece]]] = True
    bare = suffixes[~covered[suffixes]]
    next_char = np.append(suffixes, len(data))[np.searchsorted(suffixes, bare) + 1]
    source, target, ids = np.concatenate([source, bare]), np.concatenate([target, next_char]), np.concatenate([ids, np.full(len(bare), vocabulary.unknown)])

    chars = np.concatenate([[0], np.cumsum(char)])
    step = chars[target] - chars[begin[source]]
    order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 65_536 else step, kind="stable")
    source, target, ids, step = source[order], target[order], ids[order], step[order]
    last = np.full(len(data) + 1, -1, np.int64)
    back = np.full(len(data) + 1, -1, np.int64)
    at_start = begin[source] == source if len(source) else np.zeros(0, bool)
    edges = np.searchsorted(step, np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        left = np.where(at_start[a:b], vocabulary.size + 1, last[source[a:b]])
        reached = vocabulary.stands(left, ids[a:b]) & (left >= 0)
        last[target[a:b][reached]] = ids[a:b][reached]
        back[target[a:b][reached]] = source[a:b][reached]

    found_at, found_to, found_id = [], [], []
    at, first = ends.copy(), starts
    while len(at):
        found_at.append(back[at])
        found_to.append(at)
        found_id.append(last[at])
        at = back[at]
        going = at > first
        at, first = at[going], first[going]
    if not found_at:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    at, to, ids = np.concatenate(found_at), np.concatenate(found_to), np.concatenate(found_id)
    order = np.argsort(at)
    at, to, ids = at[order], to[order], ids[order]
    n = np.where(ids == vocabulary.unknown, to - at, 1)
    place = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = np.repeat(ids, n)
    ids = np.where(ids == vocabulary.unknown, vocabulary.byte_ids[data[place]], ids).astype(np.int32)
    return ids, np.diff(np.searchsorted(place, np.append(starts, len(data))))


def encode_texts(vocabulary: Vocabulary, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, n + 1 bounds) of the texts that lie one after the other in ``raw``."""
    parts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    if MARK.encode() in raw:
        parts = [p.replace(MARK.encode(), b" ") for p in parts]
    parts = [b" " + p if p else p for p in parts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    text_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    space = data == SPACE_BYTE
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[text_at[:-1][np.diff(text_at) > 0]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    code, hashes = pd.factorize(span_hashes(BYTE_CODE[data], starts, ends))
    units = vocabulary.units
    if len(units.hashes) + len(hashes) > MAX_UNITS or len(units.pool) > MAX_IDS:
        units = vocabulary.units = Units()
    missing = np.flatnonzero(units.find(hashes) < 0)
    if len(missing):
        one = np.zeros(len(hashes), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]  # a unit of each hash
        one = one[missing]
        size = ends[one] - starts[one]
        # An edge takes about a hundred bytes and a character has several, so units are encoded some at a time.
        upto, at, found = np.cumsum(size), 0, []
        while at < len(one):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + UNIT_BYTES, "right")))
            some, own = one[at:stop], size[at:stop]
            to = np.cumsum(own)
            text = data[np.repeat(starts[some] - (to - own), own) + np.arange(to[-1])]
            found.append(encode_units(vocabulary, text, to - own, to))
            at = stop
        units.add(hashes[missing], *(np.concatenate(x) for x in zip(*found)))
    place = units.find(hashes)[code]
    n, at = units.n[place], units.at[place]
    to = np.cumsum(n)
    ids = units.pool[np.repeat(at - (to - n), n) + np.arange(to[-1])]
    return ids, np.concatenate([[0], to])[np.searchsorted(starts, text_at)]


def decode_texts(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts of runs of ids: pieces with ``▁`` as space, byte pieces as bytes, without the space put before the text."""
    n = vocabulary.shown_size[ids]
    to = np.concatenate([[0], np.cumsum(n)])
    out = vocabulary.shown[np.repeat(vocabulary.shown_at[ids] - to[:-1], n) + np.arange(to[-1])].tobytes()
    texts = [out[a:b] for a, b in zip(to[bounds[:-1]].tolist(), to[bounds[1:]].tolist())]
    return [(t[1:] if t[:1] == b" " else t).decode(errors="replace") for t in texts]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids (array of piece ids, without begin and end), and round_trip: whether decoding gives the text back.

    The ids are those of the library. A null or empty text has no ids. ``▁`` in a text reads as a space and is the one
    character that does not come back. Texts are processed whole, in slices of about 1 MB; what is known of units and pairs is
    kept by the worker up to a fixed size. The model file must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(model_path)
        for part, texts in slices(batches, "text", SLICE):
            raw = texts.data.tobytes()
            ids, bounds = encode_texts(vocabulary, raw, texts.bounds)
            back = decode_texts(vocabulary, ids, bounds)
            same = [b.encode() == raw[x:y] for b, x, y in zip(back, texts.bounds[:-1].tolist(), texts.bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(same)], names=["id", "ids", "round_trip"],
            )

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>, round_trip boolean").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id and the text of an array of piece ids; a null array gives an empty text, broken byte sequences a replacement mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [r or [] for r in part.column("ids").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
                texts = decode_texts(vocabulary, np.array([i for r in rows for i in r], np.int64), bounds)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    source = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
