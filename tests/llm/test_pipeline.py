"""Each stage of the pipeline against a plain version on its own input, and odd tables."""

import re

import pytest

import corpus_pipeline as pipeline
from pairloom.llm import simhash
from pairloom.session import cut_lineage

from .cases import FOLDER, ODD_TEXTS, documents, empty
from .test_decontaminate import plain as best_window
from .test_simhash import brute

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage, and the result, on the sample folder."""
    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], FOLDER)))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_stages_keep_rows_and_columns(stages):
    for before, after in zip(stages[:4], stages[1:5]):
        assert after.columns == before.columns == DOCUMENT_COLUMNS
        assert after.exceptAll(before).count() == 0


def test_clean_documents_pass_language_and_quality(spark, stages):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, language, quality = map(texts, stages[:3])
    assert len(language) >= 0.98 * len(before)
    good = [i for i in language if marks.get(i) == 1]
    bad = [i for i in language if marks.get(i) == 0]
    assert sum(i in quality for i in good) >= 0.97 * len(good) and sum(i in quality for i in bad) <= 0.1 * len(bad)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sets = {i: shingles(t) for i, t in before.items()}
    ids = sorted(before)
    pairs = [(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if before[i] == before[j] or similarity(sets[i], sets[j]) >= 0.8]
    # Bits that tell the components of the exact pairs: every document that goes is near one that stays or that goes with it.
    near = {i: {i} for i in ids}
    for i, j in pairs:
        near[i].add(j)
        near[j].add(i)
    assert all(len(near[i]) > 1 for i in before if i not in after)
    caught = [not (i in after and j in after) for i, j in pairs]
    assert pairs and sum(caught) >= 0.95 * len(pairs)
    component = {}
    for i in ids:
        if i not in component:
            open_ = [i]
            while open_:
                k = open_.pop()
                if k not in component:
                    component[k] = i
                    open_ += near[k]
    assert {component[i] for i in after} == set(component.values())


def test_leaks_go(spark, stages):
    items = texts(spark.read.parquet(f"{FOLDER}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    before, after = texts(stages[3]), texts(stages[4])
    leaking = {i for i, t in before.items() if any((best_window(t, item) or (0,))[0] >= 0.8 for item in items.values())}
    assert leaking and set(before) - set(after) == leaking


def test_pieces_of_all_that_is_left(stages):
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts(stages[4])) and all(r["round_trip"] for r in rows)


def test_run_is_registered(spark, stages):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, FOLDER).count() == stages[5].count()


def test_near_groups_of_odd_texts(spark):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(documents(spark)).collect()}
    same = {i: next(j for j, u in enumerate(ODD_TEXTS) if (u or "") == (t or "")) for i, t in enumerate(ODD_TEXTS)}
    assert got == same | {5: 5, 6: 5, 20: 5}  # "One TWO three four" is near "one two three four"
    assert simhash.near_groups(empty(spark)).count() == 0


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 20)
    base = [f"w{k}" for k in range(120)]
    rows = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(60)] + [" ".join(f"v{k}x{n}" for n in range(50)) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(70)}
    assert brute({0: 1, 1: 1}, 0) == {0: 0, 1: 0}


def test_documents_without_an_id_stay(spark):
    rows = [(None, "some text that stands alone"), (None, "another text of five words"), (None, "some text that stands alone"), (1, "a third text, with an id"), (2, "a third text, with an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = pipeline.keep_one_of_each_group(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, rows[1][1]), (0, rows[0][1]), (1, rows[3][1])]


def test_rows_that_share_an_id_or_have_none(spark):
    copies = [" ".join(f"{w}{k}" for k in range(60)) for w in "abc"]
    near = copies[0].replace("a30 ", "new ")
    rows = [(7, copies[0]), (7, copies[1]), (3, near), (None, copies[1] + " end"), (None, copies[2]), (9, copies[2]), (9, copies[2]), (None, "stands alone")]
    kept = pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    want = [(3, near), (7, copies[1]), (9, copies[2]), (None, "stands alone")]
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame(want, "doc_id long, text string").collect())


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
@pytest.mark.parametrize("docs", [empty, documents, lambda s: documents(s).unionByName(documents(s))], ids=["empty", "odd", "repeated"])
def test_odd_tables(spark, stage, docs):
    table = docs(spark)
    assert stage(spark, table, FOLDER).count() <= table.count()
