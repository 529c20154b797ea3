"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_CODE, KEEP_BYTES, SPACE, Texts, first_rows, keep_rows, mix, slices, span_hashes

DIMENSIONS = 1 << 20

#: What a byte looks like: capital, small letter (and all beyond ASCII), digit, or itself.
LOOK = np.arange(256, dtype=np.uint8)
LOOK[0x41:0x5B] = ord("A")
LOOK[0x61:0x7B] = ord("a")
LOOK[0x80:] = ord("a")
LOOK[0x30:0x3A] = ord("0")
REPEATED = np.uint64(0xA24BAED4963EE407)


def shapes(texts: Texts) -> np.ndarray:
    """A hash of every word's shape: its looks with runs taken together, and whether it equals the word before it."""
    look = LOOK[texts.data]
    kept = ~SPACE[texts.data]
    kept[1:] &= look[1:] != look[:-1]
    kept[texts.starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    found = span_hashes(BYTE_CODE[look[kept]], place[texts.starts], place[texts.ends])
    words = texts.hashes
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (texts.text_of_word[1:] == texts.text_of_word[:-1])
    return np.where(again, found ^ REPEATED, found)


def features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, hashed feature) of the word and shape n-grams, a family each: words 1, 2 and shapes 1, 2, 3."""
    looks, families = shapes(texts), []
    for salt, (hashes, size) in enumerate([(texts.hashes, 1), (texts.hashes, 2), (looks, 1), (looks, 2), (looks, 3)]):
        first, found = texts.windows(hashes, size)
        families.append((first, (mix(found + np.uint64(salt)) % np.uint64(DIMENSIONS)).astype(np.int64)))
    return families


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, texts: Texts) -> np.ndarray:
        """Probability of label 1: each family adds the mean weight of its n-grams, a sparse dot product per text."""
        logit = np.full(texts.n, self.bias)
        for first, index in features(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[index], dtype=np.float64)])
            at = np.searchsorted(first, texts.word_bounds)
            logit += np.diff(sums[at]) / np.maximum(np.diff(at), 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


@dataclass(frozen=True)
class Training:
    """``per_class`` bounds the sample; alpha, beta, l1, l2 are the learner's rates and penalties."""

    per_class: int = 1500
    epochs: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Training) -> Classifier:
    """Follow the regularised leader, coordinate by coordinate, over (features, values, label) in the given order."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * how.l1 - z[at]
        return np.where(np.abs(z[at]) <= how.l1, 0.0, shrunk / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for index, value, label in rows:
            at, x = np.append(index, DIMENSIONS), np.append(value, 1.0)
            w = weights(at)
            p = 1 / (1 + math.exp(-max(min(float(w @ x), 500.0), -500.0)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return Classifier(w[:DIMENSIONS].astype(np.float32), float(w[DIMENSIONS]))


def fit(docs: DataFrame, marks: DataFrame, how: Training = Training(), id_column: str = "doc_id", text_column: str = "text") -> Classifier:
    """Train on the whole texts of a bounded sample of the labelled rows.

    ``marks`` has (id, label 0/1); an id with several labels takes the smallest, null labels do not count, and labels
    of ids that ``docs`` lacks are ignored. Of each class the ``per_class`` ids with the lowest hashes are taken, and of the rows of these
    ids, should some be repeated, again as many, by the hashes of their texts; the
    bias is then set to the class shares of all labelled rows. With one class or none the score is constant. The
    features of the sample, at most 2 * per_class texts, come to the driver.
    """
    known = marks.where(F.col("label").isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min("label").alias("label"))
    known = known.join(docs.select(F.col(id_column).alias("id")).distinct(), "id", "left_semi")
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return Classifier(np.zeros(DIMENSIONS, np.float32), math.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5)))
    chosen = first_rows(known, "label", how.per_class, F.xxhash64("id"), F.col("id")).select("id", "label")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", KEEP_BYTES):
            rows = []
            families = [(first, index, np.searchsorted(first, texts.word_bounds)) for first, index in features(texts)]
            for i in range(texts.n):
                both = [(index[at[i] : at[i + 1]], at[i + 1] - at[i]) for _, index, at in families]
                index, where = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
                value = np.concatenate([np.full(n, 1.0 / max(n, 1)) for _, n in both])
                rows.append((index.astype(np.int32), np.bincount(where, value, len(index)).astype(np.float32)))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"id": part.column("id").to_pandas(), "label": part.column("label").to_pandas(), "index": [r[0] for r in rows], "value": [r[1] for r in rows]}),
                schema=pa.schema([("id", part.schema.field("id").type), ("label", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]),
                preserve_index=False,
            )

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fetched = texts.join(F.broadcast(chosen.withColumn("label", F.col("label").cast("int"))), "id")
    sample = first_rows(fetched, "label", how.per_class, F.xxhash64("id"), F.col("id"), F.xxhash64("text"))
    sample = sample.select("id", "text", "label")
    kind = texts.schema["id"].dataType.simpleString()
    found = sample.mapInArrow(extract, f"id {kind}, label int, index array<int>, value array<float>").withColumn("turn", F.xxhash64("id", F.lit(1))).toPandas()
    # The same order whatever the partitions; hashing mixes the classes.
    found = found.assign(size=found["index"].map(len)).sort_values(["turn", "id", "size"], kind="stable")
    learnt = learn([(np.asarray(r.index_, np.int64), np.asarray(r.value, np.float64), r.label) for r in found.rename(columns={"index": "index_"}).itertuples(index=False)], how)
    taken = found["label"].value_counts()
    shift = math.log(shares[1] / shares[0]) - math.log(max(taken.get(1, 0), 1) / max(taken.get(0, 0), 1))
    return Classifier(learnt.weights, learnt.bias + shift)


def scored(docs: DataFrame, classifier: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of every whole text; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.score(texts))], names=["id", "score"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_column)


def kept(docs: DataFrame, classifier: Classifier, least_score: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    return keep_rows(docs, text_column, lambda texts, _: shared.value.score(texts) >= least_score)
