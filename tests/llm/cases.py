"""Small tables with the odd cases every operator must take, and the sample folder."""

FOLDER = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "one two three four", "One TWO three four", "a b c a b c a b c", "x " * 9000, "é ü ß 漢字 \U0001f600 é ́x",
    "tab\there\x0bvertical\x0cfeed\rreturn\x1fnot \x85 nel nbsp", "line\nline\nline\n other \nline ", "#$%&* ### ***", "it's don't WE'LL <|endoftext|> <|startoftext|>x",
    "nospace" * 3000, "\x00\x00 \x00", "▁a ▁▁ b  c   d", "aaaa aaaa­b ​zero", "ΑΣ ΑΣΑ ΟΔΥΣΣΕΥΣ", "1234567890 12 3", "one two three four", "<unk> <s> </s> <0x41>",
]


def documents(spark, texts=ODD_TEXTS, **more):
    """Rows of documents with ids from 0, a column whose name clashes with inner ones, and null lang or source."""
    rows = [(i, t, None if i % 3 == 0 else "en", None, None if t is None else len(t), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, h string")


def empty(spark):
    return documents(spark, []).limit(0)
