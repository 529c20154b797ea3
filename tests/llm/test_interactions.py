"""Filter interactions against applying every order to every document, path counts, SQL, and odd tables."""

from collections import defaultdict
from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from pairloom.llm import interactions
from pairloom.llm.queries import QUERIES, SQL, audit_conditions
from tests.compare import connect, differences

from .cases import FOLDER, ODD_TEXTS, empty

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_fails(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = sum("A" <= c <= "Z" for c in text)
    return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}


def plain(rows, labels):
    """All rows of the audit, with every filter applied to every document in every order."""
    ids, good, toxic = defaultdict(set), set(), set()
    for i, _, text in rows:
        if i is not None:
            ids[text or ""].add(i)
    for i, quality, tox in labels:
        good |= {i} if quality == 1 else set()
        toxic |= {i} if tox == 1 else set()
    parts = defaultdict(list)
    for i, source, text in rows:
        fails = text_fails(text or "") | {"E": i is not None and min(ids[text or ""]) < i}
        parts[source or ""].append(({f for f, bad in fails.items() if bad}, i in good and i is not None, i in toxic and i is not None))
    found, shapley = {}, defaultdict(int)
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [d for d in docs if f in d[0] and not d[0] & before]
                found[part, "".join(order), step] = [
                    sum(not d[0] & (before | {f}) for d in docs), len(here), sum(f in d[0] and bool(d[0] & before) for d in docs),
                    sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
                shapley[part, f] += len(here)
    return {key: (*values, shapley[key[0], key[1][key[2] - 1]]) for key, values in found.items()}


def audited(docs, labels):
    rows = interactions.audit(interactions.failed_sets(docs, labels, audit_conditions()), "ABCDE").collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows = QUERIES["op12_interactions"](spark, FOLDER).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in rows} == plain(docs, labels)


def test_query_follows_sql(spark):
    assert differences(QUERIES["op12_interactions"](spark, FOLDER), connect(FOLDER), SQL["op12_interactions"]) is None


def test_paths():
    for k in (1, 3, 5):
        paths = interactions.lattice_paths(k)
        assert len(paths) == k << (k - 1)
        for state, f, reach, leave in paths:
            n = state.bit_count()
            assert not state >> f & 1 and (reach, leave) == (factorial(n), factorial(k - n - 1))


def test_odd_texts_nulls_and_repeats(spark):
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "b", t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "b", "word"), (None, "b", "word"), (40, "b", "word"), (40, "b", "word"), (40, "c", None), (3, "c", "word"), (-1, None, "Zz " * 60)]
    labels = [(4, 1, 0), (4, 0, 1), (40, None, None), (None, 1, 1), (12, 0, 1), (12, 1, 1), (40, 1, 0), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = docs.withColumns({c: F.lit(True) for c in ("id", "part", "mask", "t", "u", "n", "good", "toxic", "low", "kind", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(clash, marks) == plain(rows, labels)
    assert audited(clash, marks.limit(0)) == plain(rows, [])


def test_a_hot_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.when(F.col("id") % 3 == 0, "same | text").otherwise(F.col("id").cast("string")).alias("text"))
    found = audited(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    assert found["s0", "EABCD", 1][:2] == (1001, 499) and found["s1", "EABCD", 1][:2] == (1000, 500)
    assert found["s0", "AEBCD", 1] == (0, 1500, 0, 0 + 1000, 1, 0, found["s0", "ABCDE", 1][6])


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(empty(spark), labels) == {}
