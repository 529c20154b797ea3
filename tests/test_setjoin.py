"""The set similarity join against comparing all pairs of sets."""

import random
from itertools import combinations

import pytest

from pairloom.operators import setjoin


def plain(sets, least):
    by_set = {}
    for i in sorted(sets):
        if sets[i]:
            by_set.setdefault(frozenset(sets[i]), []).append(i)
    found = set()
    for (a, xs), (b, ys) in combinations(by_set.items(), 2):
        if len(a & b) >= least * len(a | b) - 1e-12:
            (left, n_left), (right, n_right) = sorted([(xs[0], len(xs)), (ys[0], len(ys))])
            found.add((left, right, n_left, n_right, len(a & b), round(len(a & b) / len(a | b), 9)))
    return found


def table(spark, sets):
    entries = [(i, e) for i, s in sets.items() for e in s]
    return spark.createDataFrame(entries + entries[:20] + [(10**6, None)], "id int, bit int").repartition(3)


def joined(spark, sets, least, **how):
    rows = setjoin.alike(table(spark, sets), "id", "bit", least, **how).collect()
    found = {(r["left"], r["right"], r["n_left"], r["n_right"], r["shared"], round(r["similarity"], 9)) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("least, block", [(0.5, 4096), (0.8, 3), (0.75, 1), (1.0, 4096), (1 / 3, 7)])
def test_all_pairs_are_found(spark, least, block):
    draw = random.Random(8)
    sets = {i: set(draw.choices(range(40), weights=range(40, 0, -1), k=draw.randint(1, 12))) for i in range(60)}
    sets |= {100 + i: sets[i] for i in range(0, 40, 3)} | {200 + i: sets[i] ^ {draw.randint(0, 50)} for i in range(40)}
    assert joined(spark, sets, least, block=block) == plain(sets, least)


def test_hot_elements_and_one_hot_set(spark):
    sets = {i: {1, 2, 3, 10 + i % 50, 70 + i // 50} for i in range(300)} | {1000 + i: {1, 2, 3} for i in range(200)}
    got = joined(spark, sets, 0.6, block=16)
    assert got == plain(sets, 0.6) and any(n == 200 for _, _, _, n, _, _ in got)


def test_odd_input(spark):
    assert joined(spark, {1: {5}, 2: {5}, 3: {6}}, 0.5) == set()
    assert setjoin.alike(table(spark, {1: {5}}).limit(0), "id", "bit", 0.5).count() == 0
    with pytest.raises(ValueError):
        setjoin.alike(table(spark, {1: {5}}), "id", "bit", 0.0)
