"""Spelling variants against brute force over all pairs of words, and odd tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import lettertrie, spelling
from pairloom.llm.queries import QUERIES

from .cases import FOLDER, ODD_TEXTS, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """By trying every edit of the shorter word."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    near, by_length = defaultdict(list), defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    for length, words in by_length.items():
        for a, b in [*combinations(words, 2), *((a, b) for a in words for b in by_length.get(length + 1, []))]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * n:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, form.get(w), counts[form[w]] if w in form else None, len(near[w]), root(w)) for w, n in counts.items()}


def result(df):
    rows = df.collect()
    found = {r["word"]: (r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(docs))
    found = QUERIES["op13_spelling"](spark, FOLDER)
    assert dict(found.dtypes) == {"word": "string", "n": "bigint", "form": "string", "form_n": "bigint", "n_near": "bigint", "root": "string"}
    assert result(found) == want and any(form for _, form, *_ in want.values())


def invented(n, seed, letters="abcdeé"):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(4, 7))) for _ in range(n)}
    for w in sorted(words)[: n // 3]:
        at = draw.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + draw.choice("xyzÿ") + w[at + 1 :], w[:at] + draw.choice("xyz") + w[at:]}
    return {w: draw.randint(3, 60) for w in sorted(words)}


@pytest.mark.parametrize("node_words", [3, 40, 1 << 14])
def test_split_nodes_find_the_same(spark, node_words):
    """Small nodes make the upper levels go on to the last one, and split the leaves and the words that search in them."""
    counts = invented(400, 5)
    words = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    assert result(spelling.variants(words, node_words=node_words)) == plain_variants(counts)


def test_many_words_of_equal_counts(spark):
    """One leaf that holds all words: they are looked up by their halves."""
    draw = random.Random(2)
    words = sorted({"".join(draw.sample("aabbccdd", 8)) for _ in range(3000)} | {"".join(draw.sample("aabbccddy", 9)) for _ in range(500)} | {"yabbccdd", "aybbccdd"})
    found = {frozenset((words[a], words[b])) for q, w in lettertrie.Trie(np.array(words, object)).pairs(np.array(words, object)) for a, b in zip(q, w)}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    want = {frozenset(p) for ws in by_length.values() for p in combinations(ws, 2) if sum(x != y for x, y in zip(*p)) == 1}
    want |= {frozenset((a, b)) for b in by_length[9] for i in range(9) for a in [b[:i] + b[i + 1 :]] if a in set(by_length[8])}
    assert found == want and want


def test_long_words_and_any_code_points(spark):
    words = ["x" * 40 + "a", "x" * 40 + "b", "x" * 41 + "a", "x" * 9000, "x" * 9001, "x" * 8999 + "y", "漢字漢字漢", "漢字漢字", "\U0001f600aaaa", "\U0001f600aaab", "aaaa", "x" * 33, "x" * 32, "x" * 31 + "y"]
    counts = {w: 3 + 7 * i for i, w in enumerate(words)}
    assert result(spelling.variants(spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long"))) == plain_variants(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "ccccc": 5, "ccccd": 10, "dcccc": 10, "eeeee": 5, "eeeef": 9}
    got = result(spelling.variants(spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")))
    assert got == plain_variants(counts)
    assert got["aaaaa"] == (3, "aaaab", 6, 1, "bbbbb") and got["ccccc"][1] == "ccccd" and got["eeeee"] == (5, None, None, 1, "eeeee")


def test_odd_texts_nulls_and_repeats(spark):
    long = ("Straße élève ÉLÈVE naïve " * 20000)[:-3]
    texts = [*ODD_TEXTS, "hello HELLO hello Hello hallo hallo hallo", "hello hello", "×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷", long, "a" * 200000, "a" * 200000, "a" * 200000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "hello nullid nullid nullid"), (None, "hello"), (7, "hello"), (7, "hello")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "word", "run", "piece", "n", "node", "part")})
    want = plain_variants(plain_counts(rows))
    assert result(spelling.spelling_variants(docs)) == want and "a" * 200000 in want


def test_empty(spark):
    assert spelling.spelling_variants(empty(spark)).count() == 0
    assert spelling.spelling_variants(documents(spark, [None, "", "ab cd"])).count() == 0
