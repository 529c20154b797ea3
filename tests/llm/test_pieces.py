"""Piece ids against the library, and the way back."""

import random

import numpy as np
import pytest

from pairloom.llm import pieces
from pairloom.llm.queries import QUERIES, tokenizer_path

from .cases import FOLDER, ODD_TEXTS, documents, empty

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_odd_texts(spark, library):
    docs = documents(spark)
    encoded = pieces.encode(docs, PATH)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert {i: r["ids"] for i, r in rows.items()} == {i: library.encode(t or "") for i, t in enumerate(ODD_TEXTS)}
    assert [i for i, r in rows.items() if not r["round_trip"]] == [i for i, t in enumerate(ODD_TEXTS) if t and "▁" in t]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, PATH).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD_TEXTS)}


def test_random_texts(library):
    vocabulary, chars = pieces.Vocabulary(PATH), random.Random(3)
    texts = ["".join(chars.choice("ab é'sx1\n 漢́theinr▁  \t\U0001f600") for _ in range(chars.randint(0, 80))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    ids, bounds = pieces.encode_texts(vocabulary, b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text), repr(text)


def test_all_pieces(library):
    vocabulary = pieces.Vocabulary(PATH)
    texts = [library.id_to_piece(i).replace("▁", " ") for i in range(3, library.get_piece_size())]
    raw = [t.encode() for t in texts]
    ids, bounds = pieces.encode_texts(vocabulary, b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == library.encode(texts)


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_sentencepiece"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode(t) for i, t in docs.items()}
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)


def test_empty_and_null(spark, library):
    assert pieces.encode(empty(spark), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [library.piece_to_id("▁"), 7])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(nothing, PATH).collect())) == [(1, ""), (2, "\x04")]
