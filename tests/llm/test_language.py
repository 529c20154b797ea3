"""Code lengths against a plain version of the context trees, and accuracy on held-out rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import language, words
from pairloom.llm.queries import QUERIES, remainder

from .cases import FOLDER, documents, empty

TRAIN = [("en", "the cat sat on the mat"), ("en", "the theatre"), ("de", "der Hund und die Katze"), ("de", "ß"), ("en", None)]


def plain_bits(own, text, order):
    seen = defaultdict(Counter)
    for t in own:
        raw = b"\0" * order + t.encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen[raw[i - k : i]][raw[i]] += 1
    raw, bits = b"\0" * order + text.encode(), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            counts = seen.get(raw[i - k : i])
            if counts:
                weight = sum(counts.values()) + len(counts)
                if raw[i] in counts:
                    bits -= math.log2(counts[raw[i]] / weight)
                    break
                bits -= math.log2(len(counts) / weight)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths(spark, order):
    model = language.fit(spark.createDataFrame(TRAIN, "lang string, text string"), order)
    assert model.languages == ["de", "en"]
    for text in ["the hat", "Katze", "x", "漢字", "ththe\0\0e"]:
        got = model.code_lengths(language.grams(words.texts_of(pa.array([text])), order)).sum(0)
        want = [plain_bits([t for lang, t in TRAIN if lang == name and t], text, order) for name in model.languages]
        assert np.allclose(got, want)


def test_whole_texts_are_summed(spark):
    model = language.fit(spark.createDataFrame(TRAIN, "lang string, text string"))
    docs = spark.createDataFrame([(1, "the mat"), (2, "und die"), (3, None), (4, "12 34 !"), (5, "the mat"), (6, "")], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "en", "und"]
    assert rows[3]["score"] == rows[4]["score"] == 0 and rows[1]["score"] > 0.9
    own = [t for lang, t in TRAIN if lang == "en" and t]
    assert math.isclose(rows[1]["bits_per_byte"], plain_bits(own, "the mat", 4) / 7)


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, FOLDER).collect()}
    held = docs.where(remainder("doc_id", 4) == 2).select("doc_id", "lang").collect()
    assert len(rows) == docs.count() and {r["doc_id"] for r in held} == {i for i, r in rows.items() if r["held_out"]}
    assert sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_odd_tables(spark):
    docs = documents(spark)
    model = language.fit(language.train_rows(docs, 3))
    assert model.languages == ["en"]
    assert language.predict(docs, model).count() == docs.count()
    nothing = language.fit(language.train_rows(empty(spark), 3))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


def test_sample_is_bounded_by_rows(spark):
    """Two ids hold all rows, and one language most of them."""
    docs = spark.range(4000).selectExpr("id % 2 AS doc_id", "IF(id % 9 = 0, 'de', 'en') AS lang", "concat('text ', id) AS text")
    sizes = {r["lang"]: r["count"] for r in language.train_rows(docs, 3).groupBy("lang").count().collect()}
    assert sizes == {"de": 3, "en": 3}
    nameless = docs.withColumn("doc_id", docs["doc_id"].cast("string").substr(2, 1).try_cast("long"))
    assert language.train_rows(nameless, 3).count() == 6
    first = sorted(map(tuple, language.train_rows(docs, 3).collect()))
    assert first == sorted(map(tuple, language.train_rows(docs.repartition(5), 3).collect()))


FOREIGN = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa rodzina jest nieszczęśliwa na swój sposób.",
    "幸福な家庭はどれも似たものだが、不幸な家庭はいずれもそれぞれに不幸なものである。", "qZx7 vKq9w JjX2 0zQw Xk3Jq zzQ9 wWxK qJ8x Kq2Z xxVw 9QkZ jjXq W7zk qXv3 KwJz 8qZx", "привет",
]


def test_foreign_and_junk_texts_go(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(language.train_rows(docs, 500))
    found = language.kept(spark.createDataFrame([(t,) for t in FOREIGN], "text string"), model, 0.5)
    assert found.count() == 0
    assert language.kept(docs, model, 0.5).count() >= 0.99 * docs.count()
