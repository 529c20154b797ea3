"""Counts of texts against a plain version, and the estimation of rule accuracies."""

import re
from collections import Counter
from itertools import product
from math import log, prod

import pytest

from pairloom.llm import rules
from pairloom.llm.queries import QUERIES

from .cases import FOLDER, ODD_TEXTS, documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered),
        len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text)),
    )


def test_counts_of_odd_texts(spark):
    got = {r["doc_id"]: tuple(r[c] for c in rules.COUNTS) for r in rules.text_counts(documents(spark)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(ODD_TEXTS)}


def test_query_counts_whole_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op7_quality_rules"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (*want[:3], want[4], want[5])
        assert r["base_failed"] == (want[0] < 50 or 100 * want[5] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_kept_follows_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality_rules"](spark, folder).collect() if r["doc_id"] in marks and not r["base_failed"]]
    clean, junk = ([r["kept"] for r in rows if marks[r["doc_id"]] == q] for q in (1, 0))
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.1 * len(junk) and junk


def plain_fit(patterns, rounds=100):
    """(prior, bad, good) log odds of one estimation, text by text class by class, without arrays."""
    belief = start = [0.1 if 0 in votes else 0.9 for votes, _ in patterns]
    k = len(patterns[0][0])
    for _ in range(rounds):
        prior = min(max(sum(b * n for b, (_, n) in zip(belief, patterns)) / sum(n for _, n in patterns), 0.5), 1 - 1e-6)
        rate = {}
        for j in range(k):
            for good in (False, True):
                cast = [((b if good else 1 - b) * n, votes[j]) for b, (votes, n) in zip(belief, patterns) if votes[j] is not None]
                rate[j, good] = (sum(w for w, v in cast if v == 1) + 0.0001) / (sum(w for w, _ in cast) + 0.0002)
        new = []
        for votes, _ in patterns:
            odds = prior / (1 - prior)
            for j, v in enumerate(votes):
                if v is not None:
                    odds *= rate[j, True] / rate[j, False] if v else (1 - rate[j, True]) / (1 - rate[j, False])
            new.append(0.9995 * odds / (1 + odds) + 0.0005 * start[len(new)])
        if max(abs(x - y) for x, y in zip(new, belief)) < 1e-9:
            break
        belief = new
    return log(prior / (1 - prior)), [(log((1 - rate[j, True]) / (1 - rate[j, False])), log(rate[j, True] / rate[j, False])) for j in range(k)]


def test_estimation_is_the_plain_one(spark):
    names = [r.name for r in rules.rules()]
    rows = rules.text_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).withColumns({r.name: r.vote() for r in rules.rules()})
    patterns = [(tuple(r[n] for n in names), r["count"]) for r in rows.where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words").groupBy(*names).count().collect()]
    used = list(range(len(names)))
    while True:
        prior, votes = plain_fit([(tuple(p[j] for j in used), n) for p, n in patterns])
        worst = max(range(len(used)), key=lambda i: votes[i][0])
        if votes[worst][0] <= rules.WRONG_SIGN:
            break
        del used[worst]
    found = rules.fit(patterns, names)
    assert found.prior == pytest.approx(prior) and names.index("symbols") in used
    assert all(found.votes[names[j]] == (pytest.approx(min(bad, 0)), pytest.approx(good)) for j, (bad, good) in zip(used, votes))
    assert all(found.votes[names[j]] == (0.0, 0.0) for j in range(len(names)) if j not in used)


def test_no_bad_vote_speaks_for_good():
    # The classes split on the first two rules; bad votes of the third fall on the many good texts.
    patterns = [((1, 1, 0), 500), ((1, 1, 1), 300), ((0, 0, 1), 200), ((0, 1, 1), 40), ((1, 0, 1), 40)]
    found = rules.fit(patterns, ["a", "b", "c"])
    assert found.votes["c"] == (0.0, 0.0) and all(found.votes[r][0] < 0 < found.votes[r][1] for r in "ab")


def test_accuracies_are_found():
    # Three rules that are right in nine of ten cases and one that votes like a coin, of four fifths good texts.
    patterns = []
    for votes in product((0, 1), repeat=4):
        share = sum(prior * prod(0.9 if v == good else 0.1 for v in votes[:3]) * 0.5 for good, prior in ((1, 0.8), (0, 0.2)))
        patterns.append((votes, round(1e6 * share)))
    weights = rules.fit(patterns, ["a", "b", "c", "coin"], rounds=2000)
    assert abs(weights.votes["coin"][0]) < 0.05 and abs(weights.prior - log(4)) < 0.05
    assert all(abs(weights.votes[r][1] - log(9)) < 0.05 and abs(weights.votes[r][0] + log(9)) < 0.05 for r in "abc")
    assert rules.fit([], ["a"]).votes == {"a": (0.0, 0.0)}


@pytest.mark.parametrize("docs", [empty, lambda s: documents(s, [None, None]), documents])
def test_odd_tables(spark, docs):
    table = docs(spark)
    assert rules.judged(table).where("p_good BETWEEN 0 AND 1").count() == table.count()
