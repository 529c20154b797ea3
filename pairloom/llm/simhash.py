"""Near duplicates: SimHash fingerprints, the pairs within a few bits and the groups they form; and groups of similar shingle sets, by SimHash and then MinHash."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_index
from ..session import cut_lineage, cut_slim
from . import graybits
from .components import components
from .words import BASE, KEEP_BYTES, Texts, mix, slices, texts_of

XXH_SEED = 42
#: Rows of one group in a task; larger groups are cut into parts that meet pair by pair.
GROUP_ROWS = 4096
#: Rows per key that the number of blocks aims at, see ``n_blocks``.
AIM = 512
#: Bits by which SimHash fingerprints of near copies differ at most.
RADIUS = 4
#: Bytes of shingle sets of one part in a task, see ``exact_links``.
GROUP_BYTES = 16 << 20
#: MinHash of ``near_groups``: keys, minima in each, and the odd factors that give the orders.
BANDS, BAND_ROWS = 25, 5
MINIMA = BANDS * BAND_ROWS
ORDERS = np.random.default_rng(20240301).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows with a text or a set in a file of a table that is written on the way.
TEXTS_A_FILE = 1 << 12
#: Pairs whose sketches are compared at a time.
PAIRS = 1 << 17


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One value per run of hashes: a bit is set where over half the run has it set; an empty run gives zero."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, bounds[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, n + 1 bounds) of lower-cased texts: ``size`` words joined by spaces, or all words of a shorter text."""
    import xxhash

    texts = texts.lower()
    starts, ends = texts.starts, texts.ends
    length = ends - starts
    to = np.cumsum(length + 1)  # each word and a space, one after the other
    line = np.full(to[-1] if len(to) else 0, 0x20, np.uint8)
    word = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    line[(to - length - 1)[word] + inside] = texts.data[starts[word] + inside]
    raw = line.tobytes()
    n = np.where(texts.n_words > 0, np.maximum(texts.n_words - size + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - texts.word_bounds[:-1], n)
    last = np.minimum(first + size, np.repeat(texts.word_bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    begin, end = (to - length - 1)[first].tolist(), (to - 1)[last].tolist()
    return np.fromiter((digest(raw[a:b], XXH_SEED) for a, b in zip(begin, end)), np.uint64, len(begin)), bounds


def fingerprints(docs: DataFrame, size: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and fingerprint (a signed long with the 64 bits) of every whole text from its shingles of ``size`` words.

    Null texts and texts without words get zero; a text with fewer words is one shingle. Rows are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(majority(*shingle_hashes(texts, size)).view(np.int64))], names=["id", "fingerprint"])

    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fingerprint long").withColumnRenamed("id", id_column)


def hex_digits(fingerprint: Column) -> Column:
    """Sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def n_blocks(rows: int, radius: int) -> int:
    """Blocks the bits are cut into, so that a key of the index has about AIM of ``rows`` values that lie at random.

    More blocks make longer keys and more copies of every row; the pairs found are the same for any number.
    """
    blocks = radius + 1
    while blocks < radius + 4 and rows >> (graybits.BITS * (blocks - radius) // blocks) > AIM:
        blocks += 1
    return blocks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(values: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between the nodes of ``values`` (node long, table int, value long) whose values of a table differ in at most ``radius`` bits.

    Every row goes to one key per choice of blocks (table, choice and the bits in them); two values within the radius meet in at
    least one. A key with more than GROUP_ROWS rows is cut into parts by hash and every two parts meet in a group of their own, so
    no group exceeds 2 * GROUP_ROWS rows or so. Each group is searched through the Gray-order index.

    A group returns no list of all pairs: it links every row with the first it can be reached from, which keeps what is connected connected.
    """
    slim = cut_lineage(values.select(F.col("node"), F.col("table"), F.col("value")))
    masks = graybits.key_masks(radius, blocks or n_blocks(slim.count(), radius))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("value").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)])
    keyed = slim.select("node", "value", F.col("table"), F.explode(keys).alias("key")).select("node", "value", "table", "key.choice", "key.bits")
    name = ["table", "choice", "bits"]
    # Few keys pass the limit: at most rows / GROUP_ROWS of them.
    large = keyed.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ROWS).withColumn("parts", F.ceil(F.col("n") / GROUP_ROWS).cast("int"))
    parted = keyed.join(large.drop("n"), name, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")
    other = parted.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = other.select(
        "node", "value", F.xxhash64(*name, F.least("part", "other"), F.greatest("part", "other")).alias("group"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in graybits.whole_groups(batches, "group"):
            group, value, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "value", "node"))
            value = value.view(np.uint64)
            order = np.lexsort((graybits.gray_rank(value), group))
            group, value, node = group[order], value[order], node[order]
            a, b = _forest(node, value, group, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    tasks = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(search, "a long, b long").distinct()


def _forest(node: np.ndarray, value: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    root = graybits.roots(len(node), ((a, b) for a, b, _ in graybits.close_pairs(value, group, radius)))
    linked = root != np.arange(len(node))
    return node[linked], node[root[linked]]


def groups(marked: DataFrame, radius: int = 4, blocks: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """Add ``component_id`` to rows with a fingerprint: the smallest id that can be reached over links of at most ``radius`` bits.

    Rows with the same fingerprint are taken together first, so copies cost one row in the index however many there are. Ids must
    be whole numbers. Null ids get a null component unless they share a fingerprint with a row that has an id.
    """
    marked = cut_lineage(marked)
    different = marked.groupBy("fingerprint").agg(F.min(id_column).alias("node"))
    rows = different.where("node IS NOT NULL").select(F.col("node").cast("long"), F.lit(0).alias("table"), F.col("fingerprint").alias("value"))
    found = components(links(rows, radius, blocks))
    named = different.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fingerprint")


def _shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the lower-cased shingles of every row; all words of a shorter text are one shingle."""
    texts = texts.lower()
    first, found = texts.windows(texts.hashes, size)
    row = texts.text_of_word[first]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < size))
    whole = np.array([int(np.bitwise_xor.reduce(mix(texts.hashes[a:b] + np.arange(b - a, dtype=np.uint64)))) for a, b in zip(texts.word_bounds[short], texts.word_bounds[short + 1])], np.uint64)
    return np.concatenate([row, short]), np.concatenate([found, whole])


def _shingle_set(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the different shingles of every row, keys differing between rows."""
    row, found = _shingles(texts, size)
    key, at = np.unique(found ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    return key, row[at]


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, n + 1 bounds) of the different shingles of every row, ascending inside a row."""
    row, found = _shingles(texts, size)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return found[new], np.searchsorted(row[new], np.arange(texts.n + 1))


def similarities(left: Texts, right: Texts, size: int) -> np.ndarray:
    """Jaccard similarity of the shingle sets of two texts, row by row; 0 where neither has a word."""
    (a, row), (b, other) = _shingle_set(left, size), _shingle_set(right, size)
    both = np.bincount(row[np.isin(a, b, assume_unique=True)], minlength=left.n)
    all_ = np.bincount(row, minlength=left.n) + np.bincount(other, minlength=left.n) - both
    return both / np.maximum(all_, 1)


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MINIMA values per run of hashes: the least under as many orders. Two sets agree in one of them with the chance of their Jaccard similarity."""
    out = np.zeros((len(bounds) - 1, MINIMA), np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        spread, starts = mix(hashes), bounds[:-1][full]
        for k in range(MINIMA):
            out[full, k] = np.minimum.reduceat(spread * ORDERS[k], starts) >> np.uint64(32)
    return out


def least_agreeing(similarity: float) -> int:
    """How many of MINIMA values agree at least, but for one in ten million of the pairs that are just so similar."""
    below = 0.0
    for k in range(MINIMA + 1):
        below += math.comb(MINIMA, k) * similarity**k * (1 - similarity) ** (MINIMA - k)
        if below > 1e-7:
            return k
    return MINIMA


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """id, t, u and, from the set of shingles of the text: n (how many), h and g (128 bits of the set), fingerprint (its SimHash),
    buckets (a key per band) and sketch (8 bits of every minimum).

    A text without words has no h, g and buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", KEEP_BYTES):
            hashes, bounds = shingle_sets(texts, size)
            n = np.diff(bounds)
            worded = n > 0
            keys = np.zeros((2, texts.n), np.uint64)
            if worded.any():
                for k in range(2):
                    keys[k, worded] = mix(np.add.reduceat(mix(hashes + ORDERS[k]), bounds[:-1][worded]) + n[worded].astype(np.uint64))
            least = minima(hashes, bounds)
            bucket = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (texts.n, BANDS))
            for k in range(BAND_ROWS):
                bucket = mix(bucket * np.uint64(BASE) + least[:, k::BAND_ROWS])
            kept = bucket[worded].ravel().view(np.int64)
            at = np.concatenate([[0], np.cumsum(worded * BANDS)]).astype(np.int32)
            columns = [pa.array(n.astype(np.int64)), *[pa.array(k.view(np.int64), mask=~worded) for k in keys], pa.array(majority(hashes, bounds).view(np.int64))]
            columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(kept)), pa.array([r.tobytes() for r in least.astype(np.uint8)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("id", "t", "u")], *columns], names=["id", "t", "u", "n", "h", "g", "fingerprint", "buckets", "sketch"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "t", "u", "text").mapInArrow(run, f"id {kind}, t long, u long, n long, h long, g long, fingerprint long, buckets array<long>, sketch binary")


def verified(found: DataFrame, texts: DataFrame, size: int, least: float, rows: int) -> DataFrame:
    """The links (a, b) whose texts (node, text), about ``rows`` of them, have shingle sets that are at least ``least`` similar.

    One text that has very many links is a hot key, which the adaptive skew join splits.
    """
    wanted = cut_slim(texts, rows, TEXTS_A_FILE)
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = pairs.join(wanted.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(wanted.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "left", KEEP_BYTES):
            kept = pa.array(similarities(texts, texts_of(part.column("right")), size) >= least)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(kept)

    return sides.mapInArrow(compare, "a long, b long")


def _parted(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """Rows of every ``key`` cut into ``parts`` by their node, every two parts in a group of their own: adds part, other and group."""
    cut = rows.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("group", F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other"))).drop("parts")


def _likely_pairs(batch: pa.RecordBatch, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all rows of a group (sorted) with different ``comp`` whose sizes and sketches allow the similarity; two rows of one part meet in that part's own group only."""
    group, comp, part, other, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "comp", "part", "other", "n"))
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
    least, end, a, apart = least_agreeing(similarity), np.searchsorted(group, group, "right"), np.arange(len(group)), 0
    while len(a):
        apart += 1
        a = a[a + apart < end[a]]
        b = a + apart
        open_ = (comp[a] != comp[b]) & ((part[a] != part[b]) | (part[a] == other[a])) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9)
        x, y = a[open_], b[open_]
        for at in range(0, len(x), PAIRS):
            i, j = x[at : at + PAIRS], y[at : at + PAIRS]
            near = (sketch[i] == sketch[j]).sum(axis=1) >= least
            yield i[near], j[near]


def _sorted_groups(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def likely_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the rows (bucket, node, comp, n, sketch, rows of the bucket) that may be similar and are of different ``comp``; of the pairs of a group only as many as keep connected what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in graybits.whole_groups(batches, "group"):
            node = batch.column("node").to_numpy()
            root = graybits.roots(len(node), _likely_pairs(batch, similarity))
            linked = root != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    grouped = _parted(rows, "bucket", F.ceil(F.col("rows") / GROUP_ROWS))
    return _sorted_groups(grouped.select("group", "node", "comp", "part", "other", "n", "sketch"), run).distinct()


def exact_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the rows (cluster, node, comp, n, sketch, set) of a cluster whose sets are at least so similar.

    All pairs are compared, but for those that sizes or sketches rule out and those that verified links connect already. A cluster is cut into
    parts of at most GROUP_ROWS rows and GROUP_BYTES of sets or so, of which every two meet in a group.
    """
    size = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_ROWS), F.ceil(F.sum("n") * 8 / GROUP_BYTES)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in graybits.whole_groups(batches, "group"):
            node, n, sets = batch.column("node").to_numpy(), batch.column("n").to_numpy(), batch.column("set")
            names, comp = np.unique(batch.column("comp").to_numpy(), return_inverse=True)
            root, a, b = np.arange(len(names)), [], []
            for i, j in _likely_pairs(batch, similarity):
                apart = root[comp[i]] != root[comp[j]]
                for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                    low, high = sorted((root[comp[x]], root[comp[y]]))
                    if low == high:
                        continue
                    both = len(np.intersect1d(np.frombuffer(sets[x].as_buffer(), np.uint64), np.frombuffer(sets[y].as_buffer(), np.uint64), assume_unique=True))
                    if both / (n[x] + n[y] - both) >= similarity:
                        root[root == high] = low
                        a.append(node[x])
                        b.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    grouped = _parted(members.join(size, "cluster"), "cluster", F.col("parts"))
    return _sorted_groups(grouped.select("group", "node", "comp", "part", "other", "n", "sketch", "set"), run).distinct()


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, set) from (node, text): the hashes of the different shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", KEEP_BYTES):
            hashes, bounds = shingle_sets(texts, size)
            sets = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("node"), sets], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(run, "node long, set binary")


def near_rows(docs: DataFrame, size: int = 5, min_similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every different row (id, t and u: 128 bits of the text) with ``lead``, the first row (id, t, u) of its group.

    See ``near_groups``. Rows go by id, nulls last, then by text hashes; ids may be null or repeated.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})
    sketched = cut_lineage(sketches(rows, size).withColumns({"h": F.coalesce("h", "t"), "g": F.coalesce("g", "u")}))
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "t", "u")
    classes = sketched.groupBy("h", "g").agg(F.min(order).alias("row"), *[F.any_value(c).alias(c) for c in ("n", "fingerprint", "buckets", "sketch")])
    rows_read = sketched.count()
    placed = row_index(classes, "row", "h", "g", name="node", rows=rows_read)
    numbered = cut_slim(placed, rows_read, TEXTS_A_FILE)
    nodes = numbered.count()

    def texts(some: DataFrame) -> DataFrame:
        wanted = some.join(numbered.select("node", F.col("row.id").alias("own"), F.col("row.t").alias("t"), F.col("row.u").alias("u")), "node")
        return rows.join(wanted, (rows["t"] == wanted["t"]) & (rows["u"] == wanted["u"]) & rows["id"].eqNullSafe(wanted["own"])).select("node", "text").dropDuplicates(["node"])

    # SimHash fingerprints within RADIUS bits of each other, found in the Gray-order index: one partner a class.
    marked = numbered.where("n > 0").select("node", F.lit(0).alias("table"), F.col("fingerprint").alias("value"))
    hashed = cut_slim(links(marked, RADIUS).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")), nodes)

    # What SimHash cannot see: buckets of one class tell nothing, the others link each class with the first class of the bucket they share most often.
    keyed = numbered.select("node", F.explode("buckets").alias("bucket"))
    many = keyed.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = cut_slim(keyed.join(many, "bucket"), BANDS * nodes)
    heads = shared.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("times"))
    first = heads.groupBy("node").agg(F.max_by("head", F.struct("times", -F.col("head"))).alias("head"))
    star = cut_slim(hashed.join(first, "node", "full").select(F.col("node").alias("a"), F.coalesce("near", "head").alias("b")), nodes)
    wanted = texts(star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct())
    sure = cut_slim(verified(star, wanted, size, min_similarity, nodes), nodes, heavy=True)
    joined = cut_slim(components(sure, nodes).withColumnRenamed("component", "comp"), nodes)

    # What is still apart in a bucket: clusters of likely pairs, and inside them all pairs on their sets.
    known = shared.select("bucket", "node").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high")
    apart = known.join(mixed.select("bucket", "rows"), "bucket").join(numbered.select("node", "n", "sketch"), "node")
    clusters = cut_slim(components(likely_links(apart, min_similarity), nodes), nodes)
    members = (
        clusters.withColumnRenamed("component", "cluster").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        .join(numbered.select("node", "n", "sketch"), "node").join(_with_sets(texts(clusters.select("node")), size), "node")
    )
    found = components(sure.unionByName(exact_links(cut_slim(members, nodes, TEXTS_A_FILE), min_similarity)), nodes)
    leads = found.join(numbered.select(F.col("node").alias("component"), F.col("row").alias("lead")), "component").select("node", "lead")
    named = numbered.join(leads, "node", "left").select("h", "g", F.coalesce("lead", "row").alias("lead"))
    return sketched.select("id", "t", "u", "h", "g").distinct().join(named, ["h", "g"]).select(F.col("id").alias(id_column), "t", "u", "lead")


def near_groups(docs: DataFrame, size: int = 5, min_similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and ``component_id``, the smallest id reachable over near copies: texts whose sets of ``size`` lower-cased words are at least ``min_similarity`` similar.

    Texts with equal sets (null as empty) are one class first, so copies, also in other case or spacing, cost one row however many there are. Classes with
    words get a SimHash fingerprint of their set; the Gray-order index finds the pairs within RADIUS bits, which are verified on the sets. A block that is added
    or cut moves more bits than that, so what SimHash leaves apart is searched further: classes get MINIMA minima of their sets under random orders (MinHash), five of which make one of 25 keys; two
    classes at similarity s agree in a key with chance 1 - (1 - s ** 5) ** 25, whatever the edit: 0.99995 at 0.8, more above. Every class is compared with its partner by SimHash, or else
    the first of the keys they share most; what is still apart is compared pair by pair with all it shares a key with, on the sets of whole texts. Pairs are passed over
    only if they are connected already or if their sizes or all minima rule them out (one in ten million at ``min_similarity``). What is linked is always verified.
    Texts without words are alike only if equal.
    """
    return near_rows(docs, size, min_similarity, id_column, text_column).select(id_column, F.col("lead.id").alias("component_id"))
