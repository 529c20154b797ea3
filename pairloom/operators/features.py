"""Feature engineering: indicator columns, token weights, projections, fingerprints and text vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from inspect import signature

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .aggregates import vector_sums
from .joins import hot_rows, salted_join

# Fixed value: what counts as a token of an id list or text.
TOKEN_PATTERN = "[A-Za-z0-9_-]+"

def multi_hot(df: DataFrame, array: str, classes: Sequence[str], prefix: str = "cat_") -> DataFrame:
    """One 0/1 column per given class of an array column; for any number of classes see ``multi_hot_rows``."""
    flags = [F.coalesce(F.array_contains(array, F.lit(c)).cast("int"), F.lit(0)).alias(f"{prefix}{c}") for c in classes]
    return df.select(*[c for c in df.columns if c != array], *flags)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column per given value but the first in sorted order (the baseline), and one for "missing"."""
    flags = [F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}__{v}") for v in sorted(values)[1:]]
    missing = F.col(column).isNull().cast("int").alias(f"{column}__nan")
    return df.select(*[c for c in df.columns if c != column], *flags, missing)


def class_index(df: DataFrame, column: str) -> DataFrame:
    """(class, index): the distinct non-null values of a column, numbered in their order; there may be any number."""
    from .ordering import row_index

    return row_index(df.select(F.col(column).alias("class")).where("class IS NOT NULL").distinct(), "class", name="index")


def multi_hot_rows(df: DataFrame, row_id: str, array: str) -> tuple[DataFrame, DataFrame]:
    """Sparse 0/1 rows (row_id, indices) over all classes of an array column, and the classes by index.

    Every row of ``df`` appears; without classes its list of indices is empty. ``row_id`` must be unique.
    """
    items = df.select(row_id, F.explode(F.array_distinct(array)).alias("class"))
    index = class_index(items, "class")
    found = items.join(index, "class").groupBy(row_id).agg(F.array_sort(F.collect_list("index")).alias("indices"))
    rows = df.select(row_id).join(found, row_id, "left")
    return rows.withColumn("indices", F.coalesce("indices", F.array().cast("array<bigint>"))), index


def one_hot_rows(df: DataFrame, row_id: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(row_id, index) with the class number of each row, 0 for the baseline and null for "missing", and the classes by index."""
    index = class_index(df, column)
    return df.select(row_id, F.col(column).alias("class")).join(index, "class", "left").select(row_id, "index"), index


def token_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lower-cased tokens of each text with their number of occurrences."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN_PATTERN), F.lit(0))
    return docs.select(doc_id, F.explode(tokens).alias("term")).groupBy(doc_id, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, doc_id: str, n_docs: int | Column | None = None) -> DataFrame:
    """Smooth TF-IDF weights with unit-length documents, in long form (doc, term, tf, df, weight).

    idf is ``ln((1 + n) / (1 + df)) + 1``; ``n_docs`` counts documents without tokens too when given.
    Counts are read several times and therefore written once instead of tokenizing again. A term found in a large share of
    the documents is salted. The length of a document is taken over its own distinct terms, which is no more than
    the document itself.
    """
    counts = cut_lineage(counts)
    if n_docs is None:
        n_docs = counts.agg(F.count_distinct(doc_id)).scalar()
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    frequency = cut_lineage(counts.groupBy("term").agg(F.count("*").alias("df")))
    found = salted_join(counts, frequency, "term", hot_rows(frequency, "df", "term"), [doc_id])
    raw = found.withColumn("raw", F.col("tf") * (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(doc_id)))
    return raw.select(doc_id, "term", "tf", "df", (F.col("raw") / length).alias("weight"))


def _weighted_sums(entries: DataFrame, by: str, key: str, vectors: DataFrame, size: int) -> DataFrame:
    """Per ``by``: the sum of weight times the vector (of ``size``) of ``key``, as (by, v)."""
    scaled = [F.get("v", F.lit(i)) * F.col("weight") for i in range(size)]
    return vector_sums(entries.join(vectors, key), [by], scaled, "v")


#: Triangles that are put on top of each other in one step of the tree.
FAN_IN = 32


def _triangle(vectors: DataFrame, k: int) -> np.ndarray:
    """The triangular factor of the table of vectors ``v``, one row each, by orthogonal reduction (k x k, fewer rows for a smaller table).

    Every task reduces its own rows to a triangle, and triangles are stacked and reduced again, FAN_IN at a time. Unlike
    the sum of products this does not square the numbers, so directions down to about 1e-15 of the largest are kept apart.
    """

    def reduced(stacks: Iterator[np.ndarray]) -> np.ndarray:
        top = np.zeros((0, k))
        for x in stacks:
            top = np.linalg.qr(np.vstack([top, x]), mode="r")
        return top

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = reduced(np.stack(batch["v"].to_numpy()) for batch in batches if len(batch))
        yield pd.DataFrame({"node": np.full(len(top), TaskContext.get().partitionId(), np.int64), "v": list(top)})

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        top = reduced([np.stack(part["v"].to_numpy())])
        return pd.DataFrame({"node": np.full(len(top), part["node"].iloc[0] // FAN_IN), "v": list(top)})

    kind, parts = "node long, v array<double>", vectors.rdd.getNumPartitions()
    level = vectors.select("v").mapInPandas(local, kind)
    while parts > FAN_IN:
        level = level.groupBy(F.floor(F.col("node") / FAN_IN)).applyInPandas(joined, kind)
        parts = -(-parts // FAN_IN)
    rows = level.select("v").collect()  # at most FAN_IN triangles
    return reduced([np.array([r["v"] for r in rows])] if rows else [])


def _directions(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the table of vectors, those that rounding leaves of others left out, and its right vectors as columns."""
    _, values, axes = np.linalg.svd(_triangle(vectors, k))
    used = values > max(values.max(initial=0.0), 0.0) * 1e-14 * max(k, 10)
    return values[used], axes[: len(values)][used].T


def _orthonormal(vectors: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Vectors with orthonormal columns that span the same, written once; if their lengths differ much, the first time leaves rounding errors
    and it is done twice."""
    while True:
        values, axes = _directions(vectors, k)
        vectors, k = cut_lineage(_times(vectors, axes / values)), len(values)
        if not k or values.min() > 1e-4 * values.max():
            return vectors, k


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every row's vector times a small matrix."""

    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ matrix)) if len(v) else pd.Series([], dtype=object)

    return vectors.withColumn("v", product("v"))


def truncated_svd(
    entries: DataFrame, row_id: str, column: str, k: int, rounds: int = 30, extra: int = 8, out: str = "latent",
) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Uncentred SVD of a sparse matrix in long form (row_id, column, weight): scores per row, singular values, right vectors per column.

    Subspace iteration on k + ``extra`` vectors: rows times vectors and back are joins and sums, so neither side of the matrix
    has to fit in memory; only triangles of k + ``extra`` rows reach the driver. Both sides are made orthonormal by a tree of QR steps, so
    values down to about 1e-13 of the first are found. It ends when the first k values stay the same twice, after ``rounds``
    at most; up to k + extra columns the result is exact. Fewer components come back where the matrix has a smaller rank. The
    sign of a component is such that its largest sum over the columns is positive.
    """
    entries = cut_lineage(entries.select(row_id, column, F.col("weight").cast("double").alias("weight")))
    names = cut_lineage(entries.select(column).distinct())
    n = names.count()
    none = F.array().cast("array<double>")
    size = min(k + extra, n)
    start = F.array(*[F.xxhash64(F.col(column), F.lit(j)) / F.lit(2.0**63) for j in range(size)])
    right, size = _orthonormal(cut_lineage(names.withColumn("v", start)), size) if n else (names, 0)
    before, same = None, 0
    while size:
        left = cut_lineage(_weighted_sums(entries, row_id, column, right, size))
        values, axes = _directions(left, size)
        largest = values[:k]
        same = same + 1 if before is not None and len(before) == len(largest) and np.allclose(before, largest, rtol=1e-13, atol=1e-15 * max(values.max(initial=0.0), 1e-300)) else 0
        if same == 2 or rounds <= 0 or n <= size or len(values) == 0:
            break
        before, rounds = largest, rounds - 1
        # The rows' side with orthonormal columns, then back to the columns' side.
        right, size = _orthonormal(cut_lineage(_weighted_sums(entries, column, row_id, _times(left, axes / values), len(values))), len(values))
    if not size or not len(values):
        return entries.select(row_id, none.alias(out)).distinct(), np.zeros(0), names.withColumn("v", none)
    turned = axes[:, :k]
    sums = right.select(Summarizer.sum(array_to_vector("v")).alias("s")).first()["s"]
    turned = turned * np.where(sums.toArray() @ turned < 0, -1.0, 1.0)
    return _times(left, turned).withColumnRenamed("v", out), values[:k], _times(right, turned)


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def standardized(df: DataFrame, vector: str = "features", out: str = "scaled") -> DataFrame:
    """Zero mean and unit population variance per dimension; a constant dimension becomes 0, no rows stay none."""
    if df.isEmpty():
        return df.withColumn(out, F.col(vector))
    stats = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s")).first()["s"]
    mean, n = stats["mean"].toArray(), stats["count"]
    deviation = np.sqrt(stats["variance"].toArray() * (n - 1) / n)
    factor = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    centred = F.zip_with(vector_to_array(vector), F.lit(mean.tolist()), lambda x, m: x - m)
    return df.withColumn(out, array_to_vector(F.zip_with(centred, F.lit(factor.tolist()), lambda x, f: x * f)))


def principal_components(df: DataFrame, k: int, vector: str = "features", out: str = "components") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Centred PCA: scores as an array column, explained-variance ratios, and loadings (axis x sqrt of variance)."""
    stats = df.select(Summarizer.metrics("mean", "variance").summary(F.col(vector)).alias("s")).first()["s"]
    mean, var = stats["mean"], stats["variance"]
    model = PCA(k=k, inputCol=vector, outputCol="_raw").fit(df)
    axes = model.pc.toArray()
    ratios = np.array(model.explainedVariance)
    offset = axes.T @ mean.toArray()
    shift = F.array(*[F.lit(float(o)) for o in offset])
    scores = F.zip_with(vector_to_array("_raw"), shift, lambda x, o: x - o)
    variances = ratios * float(np.sum(var.toArray()))
    return model.transform(df).withColumn(out, scores).drop("_raw"), ratios, axes * np.sqrt(variances)


def strong_loadings(loadings: np.ndarray, names: Sequence[str], floor: float = 0.5) -> list[str]:
    """Features whose loading on the first two axes is longer than ``floor``."""
    length = np.linalg.norm(loadings[:, :2], axis=1)
    return [n for n, v in zip(names, length) if v > floor]


def _class_moments(df: DataFrame, vector: str, label: str):
    rows = df.groupBy(label).agg(Summarizer.metrics("mean", "count").summary(F.col(vector)).alias("s")).limit(3).collect()  # two, or one too many
    return {r[label]: (r["s"]["mean"].toArray(), r["s"]["count"]) for r in rows}


def _gram(df: DataFrame, vector: str, center: np.ndarray, label: str | None = None) -> np.ndarray:
    """Sum of (x - center)(x - center)' over all rows; one small matrix per task is shuffled."""
    p = len(center)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) - center if len(batch) else np.zeros((0, p))
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(p), "row": list(total)})

    rows = df.select(vector_to_array(vector).alias("x")).mapInPandas(partial, "i int, row array<double>")
    summed = rows.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).collect()  # p rows
    out = np.zeros((p, p))
    for r in summed:
        out[r["i"]] = r["row"].toArray()
    return out


def _projected(df: DataFrame, vector: str, center: np.ndarray, axis: np.ndarray, out: str) -> DataFrame:
    weights = F.array(*[F.lit(float(a)) for a in axis])
    products = F.zip_with(vector_to_array(vector), weights, lambda x, w: x * w)
    return df.withColumn(out, F.aggregate(products, F.lit(-float(center @ axis)), lambda s, x: s + x))


def discriminant_axis(df: DataFrame, vector: str, label: str, out: str = "discriminant") -> tuple[DataFrame, np.ndarray]:
    """Two-class linear discriminant: project on the axis that best separates the class means."""
    moments = _class_moments(df, vector, label)
    if len(moments) != 2:
        raise ValueError("the discriminant needs exactly two classes")
    (m0, n0), (m1, n1) = (moments[k] for k in sorted(moments))
    n = n0 + n1
    center = (n0 * m0 + n1 * m1) / n
    between = sum(c * np.outer(m - center, m - center) for m, c in ((m0, n0), (m1, n1)))
    within = (_gram(df, vector, center) - between) / (n - 2)
    scale = np.sqrt(np.where(np.diag(within) > 0, np.diag(within), 1.0))  # solve on the correlation scale: features differ in size
    axis = np.linalg.pinv(within / np.outer(scale, scale)) @ ((m1 - m0) / scale) / scale
    axis = axis / np.sqrt(axis @ within @ axis)
    return _projected(df, vector, center, axis, out), axis


def pls_axes(df: DataFrame, vector: str, target: str, k: int = 2, out: str = "pls") -> tuple[DataFrame, np.ndarray]:
    """Partial least squares for one target: ``k`` score columns.

    All components follow from the Gram matrix of the standardized features and their products with the
    target, so the table is read twice however many components are asked for.
    """
    row = df.select(vector).first()
    if row is None:
        raise ValueError("no rows to fit the projection on")
    p = len(row[0])
    with_y = df.withColumn("_z", F.concat(vector_to_array(vector), F.array(F.col(target).cast("double"))))
    with_y = with_y.withColumn("_z", array_to_vector("_z"))
    mean = with_y.select(Summarizer.mean(F.col("_z"))).first()[0].toArray()
    gram = _gram(with_y, "_z", mean)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    c = gram / np.outer(scale, scale)
    xx, xy = c[:p, :p].copy(), c[:p, p].copy()
    rotations, basis = [], np.eye(p)
    for _ in range(k):
        w = xy / np.linalg.norm(xy)
        load = xx @ w / (w @ xx @ w)
        rotations.append(basis @ w)
        basis = basis @ (np.eye(p) - np.outer(w, load))
        deflate = np.eye(p) - np.outer(load, w)
        xx, xy = deflate @ xx @ deflate.T, deflate @ xy
    scored = df
    spread = scale[:p] / np.sqrt(df.count() - 1)
    for i, r in enumerate(rotations):
        scored = _projected(scored, vector, mean[:p], r / spread, f"{out}_{i}")
    return scored, np.stack(rotations, axis=1)


# Weights of the three characters of a trigram in its bucket number.
TRIGRAM_WEIGHTS = (961, 31, 1)


def _buckets(text: Column | str, size: int) -> Column:
    """Bucket number (as text) of every character trigram: a weighted sum of its code points modulo ``size``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    a, b, c = TRIGRAM_WEIGHTS
    n = F.greatest(F.size(codes) - 2, F.lit(0))
    first, second, third = (F.slice(codes, i, n) for i in (1, 2, 3))
    pairs = F.zip_with(first, second, lambda x, y: x * a + y * b)
    return F.zip_with(pairs, third, lambda x, z: F.pmod(x + z * c, F.lit(size)).cast("string"))


def _counted(df: DataFrame, buckets: Column, size: int, binary: bool, out: str) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="_buckets", outputCol=out).setBinary(binary)
    return model.transform(df.withColumn("_buckets", buckets)).drop("_buckets")


def fingerprints(df: DataFrame, text: str, bits: int = 2048, out: str = "fingerprint") -> DataFrame:
    """Binary fingerprint of a structure string: a bit per bucket of its character trigrams."""
    return _counted(df, _buckets(F.coalesce(F.col(text), F.lit("")), bits), bits, True, out)


Encoder = Callable[[Sequence[str]], np.ndarray]
# Encoders that this worker has built, by the name of the run they belong to.
_BUILT: dict[str, Encoder] = {}


def _built(name: str, factory: Callable[[], Encoder]) -> Encoder:
    if name not in _BUILT:
        _BUILT.clear()  # a worker serves one run after the other
        _BUILT[name] = factory()
    return _BUILT[name]


def encoded_texts(df: DataFrame, text: str, factory: Callable[[], Encoder], out: str = "vector", batch: int = 256) -> DataFrame:
    """Text to vector (array<double>) by an encoder that is dear to build, such as a model read from a file.

    Only ``factory`` travels with the tasks; every worker process builds its encoder once and keeps it. Each different lower-cased text is encoded
    once, ``batch`` at a time, and joined back; a null text reads as an empty one. The encoder returns one row a text.
    """
    name = uuid.uuid4().hex
    key = F.lower(F.coalesce(F.col(text), F.lit("")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                texts = part["_text"].iloc[at : at + batch]
                matrix = np.asarray(_built(name, factory)(texts.tolist()), float)
                if len(matrix) != len(texts):
                    raise ValueError(f"the encoder made {len(matrix)} rows of {len(texts)} texts")
                yield pd.DataFrame({"_text": texts.to_numpy(), out: list(matrix)})

    encoded = df.select(key.alias("_text")).distinct().mapInPandas(encode, f"_text string, {out} array<double>")
    return df.withColumn("_text", key).join(encoded, "_text").drop("_text")


def _factory(encoder: Encoder | Callable[[], Encoder]) -> Callable[[], Encoder]:
    """What can be called without arguments makes encoders; anything else is an encoder."""
    needed = [p for p in signature(encoder).parameters.values() if p.default is p.empty and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]
    return (lambda: encoder) if needed else encoder


def _trigram_units(texts: Sequence[str], size: int) -> np.ndarray:
    """Counted buckets of the character trigrams of every text (see ``_buckets``), each row brought to unit length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), lengths)
    a, b, c = TRIGRAM_WEIGHTS
    bucket = (codes[:-2] * a + codes[1:-1] * b + codes[2:] * c) % size
    own = row[:-2] == row[2:]
    counts = np.bincount(row[:-2][own] * size + bucket[own], minlength=len(texts) * size).reshape(-1, size).astype(float)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, length, out=counts, where=length > 0)


#: Texts, and about how many characters of them, whose trigrams are counted at once.
AT_ONCE = (1 << 10, 1 << 20)


def _unit_vectors(size: int):
    @F.pandas_udf("array<double>")
    def units(texts: pd.Series) -> pd.Series:
        out, part, held = [], [], 0
        for text in texts:
            part.append(text)
            held += len(text)
            if len(part) >= AT_ONCE[0] or held >= AT_ONCE[1]:
                out.extend(_trigram_units(part, size))
                part, held = [], 0
        if part:
            out.extend(_trigram_units(part, size))
        return pd.Series(out, dtype=object)

    return units


def text_vectors(df: DataFrame, text: str, encoder: Encoder | Callable[[], Encoder] | None = None, out: str = "vector", size: int = 256) -> DataFrame:
    """Text to vector (array<double>). ``encoder`` is a function from a batch of texts to a matrix or makes one, see ``encoded_texts``; the default
    counts the buckets of the character trigrams of the lower-cased text and brings them to unit length."""
    if encoder is not None:
        return encoded_texts(df, text, _factory(encoder), out)
    return df.withColumn(out, _unit_vectors(size)(F.lower(F.coalesce(F.col(text), F.lit("")))))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vector: str, right_vector: str,
                out: str = "similarity") -> DataFrame:
    """Cosine of the vectors on both sides of the given pairs.

    Vectors are brought to unit length once per entity, so the pair only needs their dot product.
    """
    from ..functions.arrays import dot, norm

    def unit(table: DataFrame, key: str, vector: str, name: str) -> DataFrame:
        length = norm(vector)
        return table.select(key, F.transform(vector, lambda x: F.try_divide(x.cast("double"), length)).alias(name))

    joined = pairs.join(unit(left, left_id, left_vector, "_a"), left_id).join(unit(right, right_id, right_vector, "_b"), right_id)
    return joined.select(*pairs.columns, dot("_a", "_b").alias(out))
