import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glyphmeter.llm import decontamination as dc
from glyphmeter.llm import text as tx
from glyphmeter.llm.wu_manber import Searcher
from tests.llm.data import clashing, docs, empty, rows_of, words


@pytest.mark.parametrize("seed", range(6))
def test_search_against_regular_expressions(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = bytes(rng.choice(b"ab ") for _ in range(rng.randrange(4000)))
        least = rng.choice([2, 3, 8, 20])
        patterns = list({bytes(rng.choice(b"ab ") for _ in range(rng.randrange(least, least + 9))) for _ in range(rng.randrange(30))})
        length = np.array([len(p) for p in patterns], np.int64)
        raw = np.frombuffer(b"".join(patterns), np.uint8)
        want = sorted((m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", text))
        assert sorted(Searcher(raw, np.cumsum(length) - length, length).search(np.frombuffer(text, np.uint8))) == want


def test_flat():
    at, raw = tx.flat(pa.array(["A, b", None, "", "É!", "--", "x"]))
    assert [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == [" a b ", " ", " ", " é ", " ", " x "]


def split(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(rows, items, n=dc.WINDOW, least=1):
    out = []
    tests = {}
    for i, t in set(items):
        w = split(t)
        if len(w) >= least:
            k = min(n, len(w))
            tests[i, t] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    for d, t in rows:
        w = split(t)
        for (i, _), own in tests.items():
            k = len(next(iter(own)))
            found = own & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if found:
                out.append((d, i, len(found), len(own)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.randrange(3, 60))) for i in range(30)]
    rows = [(i, words(rng, rng.randrange(1, 150))) for i in range(120)]
    for _ in range(40):
        k, (_, t) = rng.randrange(120), rng.choice(items)
        w = t.split()
        a = rng.randrange(len(w))
        rows[k] = (rows[k][0], f"{rows[k][1]} {'; '.join(w[a : a + rng.randrange(1, 50)]).upper()} {words(rng, 5)}")
    return rows, items


ITEMS = "item_id bigint, text string"


@pytest.mark.parametrize("seed,group", [(1, dc.GROUP_BYTES), (2, 500)])
def test_against_all_windows(spark, seed, group):
    rows, items = corpus(seed)
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(rows, items)
    assert want and rows_of(dc.matches(docs(spark, rows), bench, group_bytes=group), "doc_id", "item_id", "windows_found", "windows_total") == want
    kept = rows_of(dc.decontaminate(docs(spark, rows), bench, group_bytes=group), "doc_id")
    gone = {w[0] for w in brute(rows, items, least=dc.PASSAGE_WORDS)}
    assert kept == sorted(((i,) for i, _ in rows if i not in gone), key=repr)


def test_short_items_and_short_patterns():
    items = ((1, "a b c d e f"), (2, "what is the capital"), (3, "x"), (4, "a b c d e f"))
    found = dc.Finder(items, 3)
    assert found.total == [4, 2, 1, 4]
    got = found.find(pa.array(["a b c d e f", "what is the", "xx y", "x", "f"], pa.string()))
    assert {k: len(v) for k, v in got.items()} == {(0, 0): 4, (0, 3): 4, (1, 1): 1, (3, 2): 1}
    assert dc.Finder((), 3).find(pa.array(["x"])) == dc.Finder(((1, "..."),), 3).find(pa.array(["x"])) == {}


ITEM = " ".join(f"i{k}" for k in range(20))
ODD = [(1, None), (2, ""), (3, ITEM), (3, ITEM), (None, f"x {ITEM}"), (4, "filler " * 30000 + ITEM), (5, " ".join(ITEM.split()[:12])), (6, " ".join(ITEM.split()[3:16])), (7, "five short words are here"), (8, "a b c")]
MARKS = [(1, ITEM), (1, ITEM), (2, ITEM + " more"), (None, "Five short words are here!"), (3, None), (4, ""), (5, "a b c"), (2, "another text of the same item id")]


def test_edges(spark):
    bench = spark.createDataFrame(MARKS, ITEMS)
    got = rows_of(dc.matches(docs(spark, ODD), bench), "doc_id", "item_id", "windows_found", "windows_total")
    assert got == brute(ODD, MARKS) and (None, 1, 8, 8) in got and (7, None, 1, 1) in got
    kept = rows_of(dc.decontaminate(docs(spark, ODD), bench), "doc_id")
    assert kept == [(1,), (2,), (5,), (8,)] and (8, 5, 1, 1) in got
    none = spark.createDataFrame([], ITEMS)
    assert dc.matches(docs(spark, ODD), none).count() == 0 and dc.decontaminate(docs(spark, ODD), none).count() == len(ODD)
    assert dc.matches(empty(spark), bench).count() == dc.decontaminate(empty(spark), bench).count() == 0
    odd = clashing(spark, [(1, ITEM), (2, "clean")])
    assert dc.matches(odd, bench).count() == 2 and dc.decontaminate(odd, bench).columns == odd.columns


def test_items_of_few_words_and_many_characters(spark):
    question, long = "下列哪一个城市是中国的首都，人口最多？", "x" * 40 + " " + "y" * 40
    bench = spark.createDataFrame([(1, question), (2, "中国的首都"), (3, long), (4, "Massachusetts Institute of Technology"), (5, "Московский государственный университет")], ITEMS)
    rows = [(1, f"问题：{question}答案"), (2, "中国的首都"), (3, f"a {long} b"), (4, "at Massachusetts Institute of Technology"), (5, "Московский государственный университет")]
    columns = ("doc_id", "item_id", "windows_found", "windows_total")
    assert rows_of(dc.matches(docs(spark, rows), bench, least_words=dc.PASSAGE_WORDS), *columns) == [(1, 1, 1, 1), (3, 3, 1, 1)]
    assert rows_of(dc.matches(docs(spark, rows), bench), *columns) == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (4, 4, 1, 1), (5, 5, 1, 1)]
    assert rows_of(dc.decontaminate(docs(spark, rows), bench), "doc_id") == [(2,), (4,), (5,)]
