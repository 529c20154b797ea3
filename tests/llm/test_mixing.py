"""The mix against a plain version, its targets against sharing again and again, and odd tables."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from pairloom.llm import mixing
from pairloom.llm.queries import MIX_SHARE, MOST_COPIES, QUERIES, SOURCE_WEIGHTS

from .cases import FOLDER, ODD_TEXTS, documents, empty


def number(text, digits):
    return int(md5(text.encode()).hexdigest()[:digits], 16)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights, share, most):
    """Targets by sharing the excess again and again; exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, targets = Fraction(share) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            targets |= {s: weight[s] * level for s in free}
            break
        targets |= {s: Fraction(most * sizes[s]) for s in above}
        left -= sum(targets[s] for s in above)
        free -= above
    return targets


def plain(rows, weights=SOURCE_WEIGHTS, share=MIX_SHARE, most=MOST_COPIES, seed=42):
    """Sorted (id, source, size, copies) of (id, source, text) rows, and the targets."""
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += n_words(text)
    targets, by_source = plain_targets(sizes, weights, share, most), defaultdict(list)
    for i, source, text in rows:
        by_source[source].append((n_words(text), number(f"{'' if i is None else i}:{seed}", 15), i is not None, i or 0))
    found = []
    for source, docs in by_source.items():
        ticks = int(targets[source] / sizes[source] * (1 << 24) + Fraction(1, 2)) if sizes[source] else 0
        upto = number(f"{source or ''}:{seed}", 6)
        for size, _, named, i in sorted(docs):
            found.append((i if named else None, source, size, ((upto + ticks) >> 24) - (upto >> 24)))
            upto += ticks
    return sorted(found, key=repr), targets


def result(copies):
    return sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in copies.collect()), key=repr)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "text").collect()]
    found = QUERIES["op11_mixing"](spark, FOLDER)
    want, targets = plain(docs)
    assert result(found) == want
    taken, largest = Counter(), Counter()
    for r in found.collect():
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(float(targets[r["source"]]), rel=1e-12)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert sum(targets.values()) == Fraction(3, 2) * sum(r["size"] for r in found.collect())


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = result(mixing.copies_of(docs, SOURCE_WEIGHTS))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert result(mixing.copies_of(docs.repartition(7, F.rand(3)), SOURCE_WEIGHTS)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert result(mixing.copies_of(docs, SOURCE_WEIGHTS, seed=7)) != want


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 100, "c": 100, "d": 5}, {"a": 10, None: 10}, {"x": 7}, {"a": 0, "b": 3}, {"a": 1, "b": 1, "c": 1000, "é": 4, "z": 0, None: 2}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(rows, (5, 2, 1), 1.5, 2).collect()}
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    assert {s: r["target"] for s, r in got.items()} == pytest.approx({s: float(t) for s, t in want.items()})
    assert all(0 <= r["ticks"] <= 2 << 24 and r["target"] <= 2 * sizes[s] for s, r in got.items())


def test_odd_texts_nulls_and_repeated_rows(spark):
    rows = [(i, None if i % 3 else "s", t) for i, t in enumerate(ODD_TEXTS)] + [(None, "s", "a b"), (None, "s", "a b"), (4, "t", None), (4, "t", "x y z"), (4, "t", "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = docs.withColumns({c: F.lit(7) for c in ("id", "size", "tie", "row", "part", "ticks", "target", "source_size", "_start", "copies", "at")})
    copies = mixing.copies_of(clash, SOURCE_WEIGHTS)
    assert result(copies) == plain(rows)[0]

    texts = Counter()
    for r in copies.join(spark.createDataFrame(rows, "i long, s string, t string").selectExpr("i", "s", "xxhash64(coalesce(t, '')) AS k").distinct(),
                         F.expr("doc_id <=> i AND source <=> s AND text_key = k")).collect():
        texts[r["doc_id"], r["source"], r["text_key"]] += r["copies"]
    given = mixing.mixed(clash, copies)
    assert given.columns == clash.columns
    assert Counter((r["doc_id"], r["source"], r["k"]) for r in given.selectExpr("*", "xxhash64(coalesce(text, '')) AS k").collect()) == +texts


def test_one_source_and_one_id_may_hold_all_rows(spark):
    docs = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("hot").alias("source"), F.lit("a b c").alias("text"))
    copies = mixing.copies_of(docs, SOURCE_WEIGHTS)
    assert {r["copies"] for r in copies.collect()} == {1, 2} and abs(copies.agg(F.sum("copies")).first()[0] - 7500) <= 1


def test_empty_and_all_null(spark):
    assert mixing.copies_of(empty(spark), SOURCE_WEIGHTS).count() == 0
    nothing = documents(spark, [None, "", " "]).drop("source").withColumn("source", F.lit(None).cast("string"))
    assert [(r["size"], r["source_size"], r["target"], r["copies"]) for r in mixing.copies_of(nothing, SOURCE_WEIGHTS).collect()] == [(0, 0, 0.0, 0)] * 3
