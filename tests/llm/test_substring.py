import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphmeter.llm import substring
from tests.llm.data import clashing, docs, empty, rows_of, words


def brute(rows, width):
    split = [re.findall(r"[^\W_]+", (t or "").lower()) for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        spans = []
        for i in range(len(w) - width + 1):
            n = count[tuple(w[i : i + width])]
            if n > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1:] = [i + width, max(n, spans[-1][2])]
                else:
                    spans.append([i, i + width, n])
        out += [(doc, *s) for s in spans]
    return sorted(out, key=repr)


def spans(df):
    return rows_of(df, "doc_id", "start_word", "end_word", "occurrences")


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = [words(rng, 70) for _ in range(4)]
    rows = [(i, words(rng, rng.randrange(1, 200), 10**6)) for i in range(n)]
    for k in range(25):
        i = rng.randrange(n)
        rows[i] = (i, f"{rows[i][1]}. {rng.choice(shared).title()}!\n{words(rng, 9)}")
    return rows


@pytest.mark.parametrize("seed,width", [(1, 50), (2, 20), (3, 5)])
def test_against_all_windows(spark, seed, width):
    rows = corpus(seed)
    want = brute(rows, width)
    assert want and spans(substring.repeated_spans(docs(spark, rows), width)) == want


@pytest.mark.parametrize("usual", [1, 3, 100, 5000, 10**6, 10**11])
def test_gaps(usual):
    rng = np.random.default_rng(4)
    at = np.unique(rng.integers(0, usual * 1000, 1000))
    assert np.array_equal(substring.ungaps(substring.gaps(at)), at)
    assert len(substring.ungaps(substring.gaps(at[:0]))) == 0
    assert substring.ungaps(substring.gaps(np.array([0, 255, 510, 511]))).tolist() == [0, 255, 510, 511]


def test_sketch_never_underestimates(spark, monkeypatch):
    """A sketch far too small for its windows lets more through, and loses none."""
    rows = corpus(5)
    monkeypatch.setattr(substring, "shape", lambda estimate: (4, 128, 3000))
    assert spans(substring.repeated_spans(docs(spark, rows), 20)) == brute(rows, 20)


@pytest.mark.parametrize("layout", [(1, 1 << 20, 500), (7, 1 << 12, 2000), (300, 64, 1 << 20)])
def test_slices_and_origins_change_nothing(spark, monkeypatch, layout):
    rows = corpus(6) + [(i, BASE) for i in range(100, 140)] + [(5, BASE)] * 3
    monkeypatch.setattr(substring, "shape", lambda estimate: layout)
    monkeypatch.setattr(substring, "TASK_BYTES", 1 << 12)
    assert spans(substring.repeated_spans(docs(spark, rows).repartition(5), 20)) == brute(rows, 20)


def test_a_task_holds_as_much_at_any_size():
    for estimate in (1, 10**6, 10**9, 10**11, 10**13, 10**14):
        slices, span, origin = substring.shape(estimate)
        assert span <= substring.SLICE and origin <= substring.MOST_ORIGIN_BYTES
        assert slices * span >= substring.LOAD * estimate  # and the estimates stay as good


def test_the_prefilter_filters():
    """Of windows that occur once, few have all their counters raised twice."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    slices, span, _ = substring.shape(len(h))
    keep = np.zeros(len(h), np.int64)
    for _, _, cell, twice, which in substring.raised(h, slices, span):
        keep += twice[which]
    assert (keep == substring.ROWS).mean() < 0.06


def test_windows_do_not_cross_texts():
    first, at, h = substring.windows(pa.array(["a b", None, "", "c d e"]), 2)
    assert first.tolist() == [0, 2, 2, 2, 5] and at.tolist() == [0, 2, 3] and len(set(h.tolist())) == 3


BASE = " ".join(f"base{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, "..."), (4, BASE), (4, BASE), (None, BASE + " x"), (5, BASE + " " + BASE), (6, " ".join(f"n{i}" for i in range(49))), (7, "q " * 30000), (8, BASE.upper().replace(" ", ", "))]


def test_edges(spark):
    assert spans(substring.repeated_spans(docs(spark, ODD))) == brute(ODD, 50)
    assert substring.repeated_spans(empty(spark)).count() == 0
    assert substring.repeated_spans(docs(spark, [(1, None)])).count() == 0
    assert substring.repeated_spans(clashing(spark, [(1, BASE), (2, BASE)])).count() == 2
