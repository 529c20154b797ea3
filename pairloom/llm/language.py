"""Language by prediction by partial matching: each language's byte contexts give a code length, the shortest wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import KEEP_BYTES, Texts, first_rows, keep_rows, slices

ORDER = 4
UNKNOWN = "und"


def grams(texts: Texts, order: int = ORDER) -> np.ndarray:
    """For every byte the ``order`` bytes before it and itself, as one number; before a text there are zero bytes."""
    out = np.zeros(len(texts.data), np.int64)
    place = np.arange(len(texts.data)) - np.repeat(texts.bounds[:-1], np.diff(texts.bounds))
    for back in range(order, -1, -1):
        out <<= 8
        if back == 0:
            out |= texts.data
        elif len(out) > back:
            out[back:] |= np.where(place[back:] >= back, texts.data[:-back], 0)
    return out


@dataclass
class Contexts:
    """Counts of one order: (context and byte) and (context), both sorted, with what the escape needs."""

    keys: np.ndarray
    counts: np.ndarray
    heads: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray


@dataclass
class Model:
    """The context trees of all languages, frozen after training; ``trees[language][order]``."""

    languages: list[str]
    trees: list[list[Contexts]]
    order: int = ORDER

    def code_lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits that each language needs for the last byte of each gram.

        The longest context that was seen codes the byte with count / (total + kinds) if it has followed there, else it
        pays the escape kinds / (total + kinds) and the next shorter context is asked; below the empty context all 256 bytes
        are equal. Contexts never seen cost nothing.
        """
        bits = np.zeros((len(keys), len(self.languages)))
        for j, tree in enumerate(self.trees):
            open_ = np.arange(len(keys))
            for order in range(self.order, -1, -1):
                at = tree[order]
                key = keys[open_] & ((1 << (8 * (order + 1))) - 1)
                head = key >> 8
                h = np.minimum(np.searchsorted(at.heads, head), len(at.heads) - 1)
                seen = at.heads[h] == head if len(at.heads) else np.zeros(len(key), bool)
                k = np.minimum(np.searchsorted(at.keys, key), len(at.keys) - 1)
                hit = at.keys[k] == key if len(at.keys) else np.zeros(len(key), bool)
                if seen.any():
                    weight = (at.totals + at.kinds)[h]
                    bits[open_[hit], j] += np.log2(weight[hit] / at.counts[k[hit]])
                    miss = seen & ~hit
                    bits[open_[miss], j] += np.log2(weight[miss] / at.kinds[h[miss]])
                open_ = open_[~hit]
            bits[open_, j] += 8
        return bits


def train_rows(docs: DataFrame, per_language: int, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """A bounded sample of labelled rows (lang, text): of each language the ``per_language`` rows whose hashed ids are lowest.

    Ids are chosen first, by ids and languages alone; texts are fetched for the chosen ids. Where an id has several rows, these compete
    by the hashes of their texts, so there are never more than ``per_language`` rows a language.
    """
    known = docs.where(F.col(lang_column).isNotNull())
    ids = known.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang")).distinct()
    chosen = first_rows(ids, "lang", per_language, F.xxhash64("id"), F.col("id"))
    texts = known.select(F.col(id_column).alias("_id"), F.col(lang_column).alias("_lang"), F.col(text_column).alias("text"))
    fetched = texts.join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_lang") == F.col("lang"))).select("id", "lang", "text")
    return first_rows(fetched, "lang", per_language, F.xxhash64("id"), F.col("id"), F.xxhash64("text")).select("lang", "text")


def fit(rows: DataFrame, order: int = ORDER) -> Model:
    """Count the contexts of all texts of (lang, text). Null texts count as empty; without rows the model has no language.

    The counts are summed on the executors; what comes to the driver are the different grams of a bounded sample.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", KEEP_BYTES):
            langs = np.repeat(part.column("lang").to_numpy(zero_copy_only=False), np.diff(texts.bounds))
            found = pd.DataFrame({"lang": langs, "gram": grams(texts, order)}).groupby(["lang", "gram"], sort=False).size().reset_index(name="n")
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return from_counts(counted, order)


def from_counts(counted: pd.DataFrame, order: int = ORDER) -> Model:
    languages, trees = sorted(counted["lang"].unique()), []
    for language in languages:
        own = counted[counted["lang"] == language]
        keys, counts, tree = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.int64), []
        for k in range(order + 1):
            short, where = np.unique(keys & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
            n = np.bincount(where, counts, len(short)).astype(np.int64)
            heads, where = np.unique(short >> 8, return_inverse=True)
            tree.append(Contexts(short, n, heads, np.bincount(where, n, len(heads)), np.bincount(where, minlength=len(heads)).astype(float)))
        trees.append(tree)
    return Model(languages, trees, order)


def _judged(model: Model, texts: Texts, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, bits per byte) of each text."""
    size = np.diff(texts.bounds)
    known = letters.astype(bool) & bool(model.languages)
    if not model.languages:
        return np.full(texts.n, UNKNOWN, object), np.zeros(texts.n), np.zeros(texts.n)
    codes, different = pd.factorize(grams(texts, model.order))
    cost = model.code_lengths(different)
    bits = np.empty((texts.n, len(model.languages)))
    for j in range(len(model.languages)):
        sums = np.zeros(len(codes) + 1)
        np.cumsum(cost[codes, j], out=sums[1:])
        bits[:, j] = np.diff(sums[texts.bounds])
    best = bits.argmin(1)
    least = bits[np.arange(texts.n), best]
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    names = np.array(model.languages, object)[best]
    return np.where(known, names, UNKNOWN), np.where(known, share, 0.0), least / np.maximum(size, 1)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The language whose contexts code the whole text in the fewest bits: id, lang_pred, score, bits_per_byte.

    ``score`` is the share of that language among all when each is given weight 2 ** -bits; equal lengths go to the first
    name. A text that is null or has no letter, and every text under a model without languages, is ``und`` with score 0.
    The model grows with the sample it was fitted on, not with the data, and travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            names, share, bits = _judged(shared.value, texts, part.column("letters").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(share), pa.array(bits)], names=["id", "lang_pred", "score", "bits_per_byte"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), has_letter(F.col(text_column)).alias("letters"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(score, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_column)


#: A byte costs this much below the shortest context: texts that cost more have nothing of the language in them.
RAW_BITS = 8.0
#: So many bytes more are allowed, as the first bytes of a text say little.
GRACE_BYTES = 4


def kept(docs: DataFrame, model: Model, least_score: float, text_column: str = "text", most_bits: float = RAW_BITS) -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least ``least_score``, and is known to it.

    A score compares the learnt languages only, and some language always fits best. So a text also goes if its language needs more than
    ``most_bits`` a byte for it: by default no less than bytes cost that were never learnt.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sure(texts: Texts, letters: np.ndarray) -> np.ndarray:
        names, share, bits = _judged(shared.value, texts, letters)
        size = np.diff(texts.bounds)
        return (names != UNKNOWN) & (share >= least_score) & (bits * size <= most_bits * (size + GRACE_BYTES))

    return keep_rows(docs, text_column, sure, has_letter(F.col(text_column)))
