import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphmeter.llm import kneser_ney as kn
from glyphmeter.llm import toxicity
from tests.llm.data import clashing, docs, empty, rows_of

ORDER = 3


def grams(text, order=ORDER):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    b = (" " * (order - 1) + "".join(w + " " for w in words)).encode()
    return [b[i : i + order] for i in range(len(b) - order + 1)] if words else []


def brute(toxic, plain, text, order=ORDER):
    """The definition, with dictionaries."""
    n = [Counter(g for t in side for g in grams(t, order)) for side in (toxic, plain)]
    levels = {order - 1: Counter(g[1:] for side in n for g in side)}
    for k in range(order - 2, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def shared(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        total = sum(c for x, c in levels[k].items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in levels[k] if x[:-1] == g[:-1])
        low = shared(g[1:])
        return max(levels[k][g] - kn.DISCOUNT, 0) / total + kn.DISCOUNT * kinds / total * low if total else low

    def p(side, g):
        total = sum(c for x, c in side.items() if x[:-1] == g[:-1])
        kinds = sum(1 for x in side if x[:-1] == g[:-1])
        low = shared(g[1:])
        return max(side[g] - kn.DISCOUNT, 0) / total + kn.DISCOUNT * kinds / total * low if total else low

    gs = grams(text, order)
    return sum(math.log(p(n[0], g) / p(n[1], g)) for g in gs) / max(1, len(gs))


def model(spark, toxic, plain, order=ORDER):
    n = [Counter(kn.keys(pa.array(side), order)[1].tolist()) for side in (toxic, plain)]
    counted = spark.createDataFrame([(g, n[0][g], n[1][g]) for g in n[0] | n[1]], "gram bigint, m_t bigint, m_p bigint")
    return kn.Model.of(order, "m", *(x.toArrow() for x in kn.fit(counted, ["m"], order)))


@pytest.mark.parametrize("seed", range(4))
def test_against_the_definition(spark, seed):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice("abc é") for _ in range(rng.randrange(1, 25)))
    toxic, plain, tests = [make() for _ in range(4)], [make() for _ in range(9)], [make() for _ in range(20)] + ["zz", "", "abc"]
    total, n = model(spark, toxic, plain).ratios(pa.array(tests))
    for t, x, k in zip(tests, total, n):
        assert x / max(1, k) == pytest.approx(brute(toxic, plain, t), abs=1e-4)


def test_lookup():
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    table = kn.Lookup(key, np.arange(len(key)))
    assert np.array_equal(table(key), np.arange(len(key), dtype=np.float32))
    assert np.isnan(table(np.setdiff1d(rng.integers(0, 2**63, 1000, dtype=np.uint64), key))).all()


def corpus(n=400):
    rng = random.Random(8)
    plain = ["the", "of", "and", "river", "stone", "walks", "over", "green", "hills", "evening"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        if bad:
            for _ in range(len(words) // 12 + 1):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dunce"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(bad), 1))
    return rows, labels


LABELS = "doc_id bigint, toxic int, quality int"


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = toxicity.score(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    told = {r["doc_id"]: r["toxic"] for r in got}
    bad = {i for i, t in rows if i % 8 == 0}
    hidden = [i for i, _ in rows if i % 2]
    assert not any(told[i] for i in hidden) and all(told[i] for i in bad)
    planted = []
    for i, t in rows:
        if i % 2:
            words = t.split()
            for k in range(len(words) // 12 + 1):
                words.insert(7 * k % len(words), ["nitwit", "dunce", "blockhead"][k % 3])
            planted.append((1000 + i, " ".join(words)))
    got = toxicity.score(docs(spark, rows + planted), spark.createDataFrame(labels, LABELS)).where("doc_id >= 1000").collect()
    assert sum(r["toxic"] for r in got) >= 0.9 * len(planted)


@pytest.mark.parametrize("local", [toxicity.LOCAL_RUNS, 0])
def test_scores_and_threshold_by_brute_force(spark, local):
    """Halves, cross-scoring, threshold and calls, with dictionaries; by models at hand and by joins."""
    rng = random.Random(3)
    make = lambda bad: " ".join(rng.choice(["ab", "ba c", "b", "cab"] + ["zx", "xz"] * bad) for _ in range(rng.randrange(1, 6)))
    rows = [(i, make(i % 3 == 0)) for i in range(30)] + [(40, None), (41, ""), (5, "ab zx")]
    marks = [(i, int(i % 3 == 0), 1) for i in range(24)]
    docs_, labels = docs(spark, rows), spark.createDataFrame(marks, LABELS)
    half = {r["doc_id"]: r["h"] for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) h").collect()}
    bad = {i for i, toxic, _ in marks if toxic}
    sides = [[[t for i, t in rows if i in half and t is not None and half[i] in halves and (i in bad) == toxic] for toxic in (True, False)] for halves in ((0,), (1,), (0, 1))]
    assert all(s for pair in sides for s in pair)
    crossed = [(brute(*sides[1 - half[i]], t), i in bad) for i, t in rows if i in half and t is not None]
    models = toxicity.fitted(docs_, labels, ORDER)
    cut = toxicity.threshold(docs_, labels, models, local)
    f1 = lambda c: 2 * sum(b for s, b in crossed if s >= c) / (sum(s >= c for s, _ in crossed) + sum(b for _, b in crossed))
    assert f1(cut) == pytest.approx(max(f1(s) for s, _ in crossed), abs=0.02)
    scored = toxicity.scored(docs_.selectExpr("doc_id", "text", "'all' model"), models, ["doc_id"], local)
    got = sorted((r["doc_id"], round(r["score"], 3)) for r in scored.collect())
    assert [g[0] for g in got] == sorted(i for i, _ in rows)
    for (_, a), (_, b) in zip(got, sorted((i, round(brute(*sides[2], t or ""), 3)) for i, t in rows)):
        assert a == pytest.approx(b, abs=0.002)


def test_edges(spark):
    rows, labels = corpus(80)
    odd = [(1, None), (2, ""), (None, rows[0][1]), (900, "..."), (901, "river " * 30000), (0, rows[0][1]), (0, rows[0][1])]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0), (0, 0, 0), (0, 1, 0)], LABELS)
    got = toxicity.score(docs(spark, rows + odd), marks)
    assert got.count() == len(rows) + len(odd)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append((r["score"], r["toxic"]))
    assert (0.0, False) in by[1] and (0.0, False) in by[2] and by[900] == [(0.0, False)] and by[901][0][1] is False
    assert by[None][0][1] and len(set(by[0])) == 1 and len(by[0]) == 3
    none = toxicity.score(docs(spark, rows), spark.createDataFrame([], LABELS))
    assert none.where("toxic").count() == 0 and none.count() == len(rows)
    assert toxicity.score(docs(spark, rows), spark.createDataFrame([(0, 1, 1)], LABELS)).where("toxic").count() == 0
    assert toxicity.score(empty(spark), marks).count() == 0
    same = toxicity.score(clashing(spark, rows), spark.createDataFrame(labels, LABELS))
    assert rows_of(same, "doc_id", "toxic") == rows_of(toxicity.score(docs(spark, rows), spark.createDataFrame(labels, LABELS)), "doc_id", "toxic")
