"""Token counts of whole texts as a tokenizer library gives them, with huge texts encoded in overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

SLICE = 4 << 20
MAX_KNOWN = 500_000
#: White space at which the tokenizer always ends a token, whatever stands before or after it.
STABLE = " \t\n\r\x0b\x0c"

_LOADED: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer and the counts of words seen so far, kept by the worker process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = (Tokenizer.from_file(path), {})
    return _LOADED[path]


def spliced_count(text: str, encode: Callable[[str], np.ndarray], chunk: int, overlap: int) -> int:
    """Number of tokens of a text that is too long to be encoded at once.

    ``encode`` gives the start offsets of the tokens of a piece of text. Each chunk begins ``overlap`` characters before
    the end of the one before it. The two are joined at the last place in the overlap where both have a token start and a white
    space stands before it: there a token begins whatever surrounds it, so the left tokens up to it and the right ones from
    it on are those of the whole text. Where an overlap has no such place it is doubled, and once it reaches the last
    joint the chunk itself grows.
    """
    total, joint, begin, size = 0, 0, 0, chunk
    left = encode(text[:size])
    end = min(size, len(text))
    while end < len(text):
        width = overlap
        while True:
            start = max(end - width, joint)
            new_end = min(len(text), start + max(chunk, 2 * (end - start)))
            if start == joint:  # the overlap covers all that is not counted yet: encode it as one longer chunk
                right, place = encode(text[joint:new_end]), joint
                break
            right = encode(text[start:new_end])
            both = np.intersect1d(left + begin, right + start)
            stable = [b for b in both[(both > start) & (both < end)].tolist() if text[b - 1] in STABLE]
            if stable:
                place = stable[-1]
                break
            width *= 2
        total += int(((left + begin >= joint) & (left + begin < place)).sum())
        joint, left, begin, end = place, right, start, new_end
    return total + int((left + begin >= joint).sum())


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = 32_768, overlap: int = 256,
) -> DataFrame:
    """Count the tokens of every text: id, n_bytes, n_tokens. A null text counts as empty; rows are kept as they are.

    For tokenizers that end every token at white space. Texts of up to ``chunk`` characters go through the library word by
    word, each different word once per worker (at most ``MAX_KNOWN`` are remembered, then the memory starts anew); longer ones in overlapping
    chunks with offsets. Special strings in a text are treated as the library does by default; none are added.
    The tokenizer's file must be readable on every executor.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(tokenizer_path)

        def starts(piece: str) -> np.ndarray:
            return np.array([o[0] for o in tokenizer.encode(piece, add_special_tokens=False).offsets], np.int64)

        for part, texts in slices(batches, "text", SLICE):
            raw, n_tokens, split = texts.data.tobytes(), np.zeros(texts.n, np.int64), {}
            for i in range(texts.n):
                text = raw[texts.bounds[i] : texts.bounds[i + 1]]
                if len(text) > chunk and len(whole := text.decode()) > chunk:
                    n_tokens[i] = spliced_count(whole, starts, chunk, overlap)
                else:
                    split[i] = text.split()
            new = list(set().union(*split.values()) - known.keys()) if split else []
            if len(known) + len(new) > MAX_KNOWN:
                known.clear()
                new = list(set().union(*split.values()))
            for at in range(0, len(new), 20_000):
                words = new[at : at + 20_000]
                encoded = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
                known.update(zip(words, map(len, encoded)))
            for i, words in split.items():
                n_tokens[i] = sum(map(known.__getitem__, words))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(texts.bounds)), pa.array(n_tokens)], names=["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_column)
