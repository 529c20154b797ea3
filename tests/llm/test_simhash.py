"""Fingerprints, the Gray-order index and the groups against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairloom import session
from pairloom.llm import components, graybits, simhash
from pairloom.llm.queries import QUERIES

from .cases import FOLDER, ODD_TEXTS, documents, empty


def plain(text, size=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(marks, radius):
    """Smallest reachable id by value, over all pairs."""
    ids = sorted(marks)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return {i: root(i) for i in ids}


def test_odd_texts(spark):
    rows = simhash.groups(simhash.fingerprints(documents(spark))).withColumn("hex", simhash.hex_digits(F.col("fingerprint"))).collect()
    marks = {i: plain(t) for i, t in enumerate(ODD_TEXTS)}
    assert {r["doc_id"]: r["hex"] for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute(marks, 4)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op1_simhash"](spark, FOLDER).collect()
    marks = {i: plain(t) for i, t in docs.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute(marks, 4)


def clustered(n, seed):
    """Values around a few centres, so that links, chains and strangers all occur."""
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, 1 + n // 20, dtype=np.uint64)
    values = centres[r.integers(0, len(centres), n)]
    for _ in range(6):
        flip = r.random(n) < 0.5
        values = np.where(flip, values ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)), values)
    return values


@pytest.mark.parametrize("n, radius", [(1, 4), (17, 4), (300, 4), (700, 0), (700, 9)])
def test_index_finds_all_pairs(n, radius):
    values = clustered(n, n)
    groups = np.sort(np.random.default_rng(2).integers(0, 3, n))
    order = np.lexsort((graybits.gray_rank(values), groups))
    values, groups = values[order], groups[order]
    found = {(int(a), int(b)): int(d) for x, y, z in graybits.close_pairs(values, groups, radius) for a, b, d in zip(x, y, z)}
    differ = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {(i, j): int(differ[i, j]) for i in range(n) for j in range(i + 1, n) if groups[i] == groups[j] and differ[i, j] <= radius}
    assert found == want


@pytest.mark.parametrize("blocks, group_rows", [(5, 4096), (6, 4096), (7, 4096), (5, 16)])
def test_groups_do_not_depend_on_the_cut(spark, monkeypatch, blocks, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    values = clustered(400, 9).view(np.int64)
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(rows, 4, blocks).collect()}
    assert got == brute({i: int(v) & (2**64 - 1) for i, v in enumerate(values)}, 4)


def test_masks_cover_the_radius():
    for blocks in (5, 6, 8):
        masks = graybits.key_masks(4, blocks)
        r = np.random.default_rng(blocks)
        for _ in range(300):
            differ = sum(1 << int(k) for k in r.choice(64, 4, replace=False))
            assert any(differ & m == 0 for m in masks)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 100), (7, 3), (200, 201), (None, 4), (200, 201)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert simhash.groups(simhash.fingerprints(empty(spark))).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def brute_similar(texts, least=0.8):
    """Smallest reachable row, over all pairs of texts (with words) at least so similar."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def near(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}


def test_true_copies_inside_a_family_of_strangers(spark):
    """Lists of the same 40 lines in other orders share their words but few shingles; some have a true copy."""
    r = np.random.default_rng(5)
    lines = [" ".join(f"l{k}w{i}" for i in range(8)) for k in range(40)]
    rows = []
    for k in range(300):
        order = r.permutation(40)
        rows.append("\n".join(lines[i] for i in order))
        if k % 3 == 0:
            words = " ".join(lines[i] for i in order).split()
            words[int(r.integers(10, 300))] = "new"
            words[int(r.integers(10, 300))] = "other"
            rows.append(" ".join(words))
    # A family with one template: alike in 0.6 to 0.79, so nearly every two share keys, and copies at 0.9 among them.
    base = [f"t{k}" for k in range(300)]
    for k in range(60):
        own = base[:240] + [f"own{k}x{i}" for i in range(30)] + base[270:]
        rows.append(" ".join(own))
        if k % 4 == 0:
            rows.append(" ".join(own[:100] + ["swap"] + own[101:]))
    want = brute_similar(rows)
    assert sum(i != c for i, c in want.items()) >= 100
    assert near(spark, rows) == want


def block_edit(r, words, share, kind):
    """A copy whose shingles are about ``share`` like those of ``words``: a block added in front, added inside, or cut off the end."""
    extra = [f"x{r.integers(1 << 40)}" for _ in range(round(len(words) * (1 / share - 1)) - 4 * (kind == "inside"))]
    at = int(r.integers(20, len(words) - 20))
    return {"front": extra + words, "inside": words[:at] + extra + words[at:], "cut": words[: round(len(words) * share)]}[kind]


def test_copies_with_a_block_added_or_cut(spark):
    r = np.random.default_rng(8)
    rows = []
    for k in range(150):
        words = [f"v{r.integers(5000)}" for _ in range(int(r.integers(100, 500)))]
        rows += [" ".join(words), " ".join(block_edit(r, words, 0.815 + 0.09 * (k % 10) / 10, ("front", "inside", "cut")[k % 3]))]
    want = brute_similar(rows)
    assert sum(i != c for i, c in want.items()) >= 140
    assert near(spark, rows) == want


def test_equal_sets_are_one_class_and_equal_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    seen = []
    monkeypatch.setattr(simhash, "verified", lambda star, *a, f=simhash.verified: (seen.append(star.count()), f(star, *a))[1])
    monkeypatch.setattr(simhash, "likely_links", lambda apart, *a, f=simhash.likely_links: (seen.append(apart.count()), f(apart, *a))[1])
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(80)]
    rows = [(" " * int(r.integers(1, 4))).join(w.upper() if r.random() < 0.5 else w for w in words) for _ in range(300)]
    assert len(set(rows)) == 300 and near(spark, rows) == dict.fromkeys(range(300), 0)
    assert seen == [0, 0]
    same = spark.range(300).selectExpr("id AS node", "7L AS bucket")
    sizes = [g["count"] for g in simhash._parted(same, "bucket", F.lit(15)).groupBy("group").count().collect()]
    assert len(sizes) == 15 * 16 // 2 and max(sizes) <= 100


def test_near_groups_go_through_simhash(spark, monkeypatch):
    """Near copies are found by their fingerprints in the Gray-order index first, here with MinHash keys that find none."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(f"x{i}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = simhash.sketches
    own = F.transform("buckets", lambda b: F.xxhash64(b, "id"))
    monkeypatch.setattr(simhash, "sketches", lambda *given: sketches(*given).withColumn("buckets", own))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_tables_on_the_way_are_few_files(spark):
    """Rounds write small tables again and again: not in as many files as a shuffle has partitions, each of which costs an executor memory and time."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    words = [f"w{k}" for k in range(60)]
    rows = [" ".join(words[: 60 - k % 3] + [f"x{k // 9}"]) for k in range(270)]
    written = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    at = len(written)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = near(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_similar(rows)
    files = [len(spark.read.parquet(path).inputFiles()) for path in written[at:]]
    assert len(files) > 10 and max(files) <= spark.sparkContext.defaultParallelism
