"""Shards against a plain version of the prefix sums, and odd tables."""

from collections import defaultdict
from zlib import crc32

from pyspark.sql import functions as F

from pairloom.llm import sharding
from pairloom.llm.queries import N_SHARDS, QUERIES

from .cases import FOLDER, ODD_TEXTS, documents, empty


def plain(rows, n_shards):
    """(id, size, crc, shard, slot) of (id, text) rows; null ids come first."""
    sized = [(i, crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r))
    total, start, seen, found = sum(size for _, _, size in sized), 0, defaultdict(int), []
    for i, crc, size in sized:
        shard = (2 * start + size) * n_shards // (2 * total)
        found.append((i, size, crc, shard, seen[shard]))
        seen[shard] += 1
        start += size
    return found


def result(df):
    rows = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in df.collect()]
    return sorted(rows, key=lambda r: r[3:])


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    query = QUERIES["op4_sharding"](spark, FOLDER)
    got = result(query)
    assert got == plain(docs, N_SHARDS)
    assert query.where("law = 'bytes' AND grown_shard IS NULL").count() == len(docs)
    held, longest = defaultdict(int), max(r[1] for r in got)
    for _, size, _, shard, _ in got:
        held[shard] += size
    target = sum(held.values()) / N_SHARDS
    assert all(abs(held[s] - target) <= longest for s in range(N_SHARDS))


def test_main_path_is_native(spark):
    plan = sharding.byte_shards(documents(spark), 4)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_odd_texts_and_clashing_columns(spark):
    clash = documents(spark).withColumns({c: F.lit(7) for c in ("size", "crc", "part", "shard", "slot", "row", "start", "index")})
    for n_shards in (1, 3, 100):
        assert result(sharding.byte_shards(clash, n_shards)) == plain(list(enumerate(ODD_TEXTS)), n_shards)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a"), (None, None), (4, "same"), (4, "same"), (4, None), (2, ""), (4, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(sharding.byte_shards(docs, 2)) == plain(rows, 2)


def test_one_id_may_fill_many_shards(spark):
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("0123456").alias("text"))
    assert result(sharding.byte_shards(docs, 9)) == plain([(5 if i % 3 == 0 else i, "0123456") for i in range(900)], 9)


def test_empty(spark):
    assert sharding.byte_shards(empty(spark), 16).count() == 0
