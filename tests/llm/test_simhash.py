import random

import numpy as np
import pyarrow as pa
import pytest

from glyphmeter.llm import simhash
from tests.llm.data import clashing, docs, empty, rows_of, words


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = np.random.default_rng(1)
    for _ in range(3000):
        bits = rng.choice(64, rng.integers(0, radius + 1), replace=False)
        assert ((masks & np.uint64(sum(1 << int(b) for b in bits))) == 0).any()


def near(prints, mark, i, j):
    d = min(int(np.bitwise_count(p[i] ^ p[j])) for p in prints)
    return mark[i] == mark[j] or (d <= simhash.RADIUS and int(np.bitwise_count(mark[i] ^ mark[j])) <= simhash.CHECK)


def brute(rows):
    """(row number, kept row number) of every row that another one stands for, by all pairs."""
    prints, mark, has = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if has[i] and has[j] and near(prints, mark, i, j):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        if has[i]:
            groups.setdefault(find(i), []).append(i)
    return [g for g in groups.values() if len(g) > 1]


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(40):
        base = words(rng, rng.randrange(30, 250)).split()
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.06]))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [3, 4])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    got = rows_of(simhash.duplicates(docs(spark, rows)), "doc_id", "duplicate_of")
    want = [(i, min(g)) for g in brute(rows) for i in g if i != min(g)]
    assert len(want) > 20 and got == sorted(want, key=repr)
    kept = rows_of(simhash.dedup(docs(spark, rows)), "doc_id", "text")
    gone = {i for i, _ in want}
    assert kept == sorted(((i, t) for i, t in rows if i not in gone), key=repr)


def test_big_group_of_different_copies(spark):
    rng = random.Random(1)
    base = words(rng, 400).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(400), 4):
            copy[k] = f"other{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    assert simhash.dedup(docs(spark, rows)).count() == len(rows) - sum(len(g) - 1 for g in brute(rows)) == 1


def test_an_entry_costs_the_same_at_any_size():
    costs = [simhash.Layout.of(n, 252) for n in (10**5, 10**6, 10**7, 10**8, 10**9, 10**10)]
    assert max(x.message_bytes() for x in costs) < 1.1 * simhash.ENTRY
    assert all(x.batch * x.step <= 252 * simhash.SPREAD for x in costs)


def test_many_parts_find_the_same(spark, monkeypatch):
    rows = corpus(5)
    want = rows_of(simhash.duplicates(docs(spark, rows)), "doc_id", "duplicate_of")
    monkeypatch.setattr(simhash, "TASK_BYTES", 17 * 20)
    monkeypatch.setattr(simhash, "SPREAD", 50)
    monkeypatch.setattr(simhash, "MOST_BATCH", 70)
    layout = simhash.Layout.of(len(rows), 252)
    assert layout.parts > 3 and layout.step < 252
    assert rows_of(simhash.duplicates(docs(spark, rows)), "doc_id", "duplicate_of") == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


LONG = " ".join(f"t{i % 997}q" for i in range(40000))
ODD = [(1, None), (2, None), (3, ""), (4, "..."), (5, "one"), (6, "one"), (7, "one"), (7, "one"), (None, "one"), (8, LONG), (9, LONG + " end"), (None, "a null id and some words"), (None, "a null id and some words"), (10, "ÉTÉ à midi"), (11, "été, à midi!")]


def test_edges(spark):
    got = rows_of(simhash.duplicates(docs(spark, ODD)), "doc_id", "duplicate_of")
    assert got == sorted([(6, 5), (7, 5), (7, 5), (None, 5), (9, 8), (None, None), (11, 10)], key=repr)
    kept = rows_of(simhash.dedup(docs(spark, ODD)), "doc_id")
    assert kept == sorted([(1,), (2,), (3,), (4,), (5,), (8,), (None,), (10,)], key=repr)
    assert simhash.duplicates(empty(spark)).count() == simhash.dedup(empty(spark)).count() == 0
    odd = clashing(spark, [(2, "same words here"), (1, "same words here"), (1, "same words here")])
    one = simhash.dedup(odd)
    assert one.columns == odd.columns and [r["doc_id"] for r in one.collect()] == [1] and one.first()["__hash_of_row"] == "x"
    assert simhash.duplicates(odd).count() == 2
