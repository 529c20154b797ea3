"""Leaks against a search of every window of every text."""

import random
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import decontaminate
from pairloom.llm.queries import QUERIES

from .cases import FOLDER, ODD_TEXTS, documents, empty


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lower = lower.replace(space, " ")
    return [w for w in lower.split(" ") if w]


def bag(words, size):
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def plain(text, item, size=5):
    """Best (similarity, first word) over all windows, or None without any."""
    own, other = words_of(text), words_of(item)
    size = min(size, len(other))
    if not other or len(own) < size:
        return None
    n, target = min(len(other), len(own)), bag(other, size)
    best = None
    for s in range(len(own) - n + 1):
        window = bag(own[s : s + n], size)
        value = sum((window & target).values()) / sum((window | target).values())
        if best is None or value > best[0]:
            best = (value, s)
    return best


def brute(texts, items, least=0.8):
    found = {}
    for i, text in texts.items():
        for j, item in items.items():
            best = plain(text, item)
            if best and best[0] >= least:
                found[i, j] = best
    return found


def result(df):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (similarity, first) in want.items():
        assert abs(got[key][0] - similarity) < 1e-9 and got[key][1] == first


@pytest.mark.parametrize("portion", [None, 40])
def test_edited_passages(spark, monkeypatch, portion):
    if portion:
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", portion)
    r = random.Random(4)
    some = [f"w{k}" for k in range(60)]
    items = {j: " ".join(r.choices(some, k=r.choice([1, 3, 4, 5, 6, 9, 20, 40]))) for j in range(30)}
    items |= {30: "a b a b a b a b a b a b", 31: "", 32: None, 33: items[7]}
    texts = {}
    for i in range(150):
        passage = words_of(items[r.randrange(31)])
        for _ in range(r.randrange(4)):
            passage.insert(r.randrange(len(passage) + 1), r.choice(some)) if r.random() < 0.5 else passage and passage.pop(r.choice([0, -1]))
        texts[i] = " ".join([*r.choices(some, k=r.choice([0, 0, 5, 30])), *passage, *r.choices(some, k=r.choice([0, 3, 30]))])
    texts |= {500 + i: t for i, t in enumerate(ODD_TEXTS)} | {900: "A  B\na b a b A b a b a b", 901: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    same(result(decontaminate.leaks(docs, bench)), brute(texts, items))


def test_query_holds_all_whole_passages(spark):
    docs = {r["doc_id"]: " ".join(words_of(r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(words_of(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = result(QUERIES["op2_decontamination"](spark, FOLDER))
    whole = {(i, j) for i, t in docs.items() for j, b in items.items() if f" {b} " in f" {t} "}
    assert whole and whole <= got.keys()
    for (i, j), (similarity, _) in got.items():
        assert similarity >= 0.8 and abs(plain(docs[i], items[j])[0] - similarity) < 1e-9


def test_blocks_guarantee_the_radius():
    r = np.random.default_rng(3)
    near = decontaminate._near_values(decontaminate.RADIUS // decontaminate.BLOCKS)
    for _ in range(500):
        a = int(r.integers(0, 1 << 63))
        b = a
        for k in r.choice(64, decontaminate.RADIUS, replace=False):
            b ^= 1 << int(k)
        assert any((b >> 8 * k) & 255 in near[(a >> 8 * k) & 255] for k in range(8))


def test_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontaminate.leaks(empty(spark), bench).count() == 0
    assert decontaminate.leaks(documents(spark), bench.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.leaks(documents(spark), bench).collect()) == [
        i for i, t in enumerate(ODD_TEXTS) if (t or "").lower() == "one two three four"
    ]


def test_items_without_an_id(spark):
    passages = [" ".join(f"{w}{k}" for k in range(30)) for w in "abc"]
    docs = spark.createDataFrame([(i, f"before {p} after") for i, p in enumerate(passages)] + [(3, "clean text of five words")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (5, passages[2])], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == {(0, None), (1, None), (2, 5)}
    assert [r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()] == [3]
