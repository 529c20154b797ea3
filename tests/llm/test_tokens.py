"""Token counts against the library on whole texts."""

import random

import numpy as np
import pytest

from pairloom.llm import tokens
from pairloom.llm.queries import QUERIES, tokenizer_path

from .cases import FOLDER, ODD_TEXTS, documents, empty

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def counts(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in df.collect()}


def want(library, texts):
    return {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts}


@pytest.mark.parametrize("chunk", [32_768, 64, 7])
def test_odd_texts(spark, library, chunk):
    assert counts(tokens.token_counts(documents(spark), PATH, chunk=chunk, overlap=5)) == want(library, enumerate(ODD_TEXTS))


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert counts(QUERIES["op8_token_counts"](spark, FOLDER)) == want(library, docs)


def test_splices_random_texts(library):
    chars = random.Random(5)

    def starts(piece):
        return np.array([o[0] for o in library.encode(piece, add_special_tokens=False).offsets], np.int64)

    for _ in range(300):
        text = "".join(chars.choice("ab é'sx1\n 漢́") * chars.choice([1, 1, 1, 2, 9]) for _ in range(chars.randint(0, 120)))
        assert tokens.spliced_count(text, starts, chars.randint(2, 40), chars.randint(1, 8)) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_empty(spark):
    assert tokens.token_counts(empty(spark), PATH).count() == 0
