import random

import pytest

from glyphmeter.llm import bpe, token_counts
from tests.llm.data import clashing, docs, empty, rows_of

CODEC = bpe.codec()
ALPHABET = ["a", "b", " ", "  ", "\n", "é", "語", "。", "漢字、", "don't", "'", "'re", "'s", "'", "1", "22", "!", "?!", "\t", "the", " of", "x" * 40, " " * 30, "ab" * 300, "　", "🙂", "́", "\xa0"]


def direct(text):
    return CODEC.split.encode_ordinary(text)


def test_tree_equals_direct_encoding():
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 50)))
        assert CODEC.encode(text, leaf=rng.randrange(1, 40)).tolist() == direct(text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "é" * 2500, " " * 4000 + "x", "abc" * 2000 + " " + "d" * 3000])
def test_long_unsplit_pieces(text):
    assert CODEC.encode(text, leaf=700).tolist() == direct(text)
    assert CODEC.encode_piece(text.encode()).tolist() == CODEC.piece(text.encode()).tolist()
    assert CODEC.decode(CODEC.encode(text)) == text


@pytest.mark.parametrize("text", ["漢" * 9000, "漢字。" * 4000, "1" * 9000, "12.5," * 3000, "語" * 5000 + " " + "é" * 5000])
def test_joins_encode_a_window_only(monkeypatch, text):
    """Without a letter, a space and a letter too: a join reads a window, not its whole left side."""
    half = len(text) // 2
    left, right = text[:half], text[half:]
    parts = left, CODEC.leaf(left), right, CODEC.leaf(right)
    read = []
    piece = CODEC.piece
    monkeypatch.setattr(CODEC, "piece", lambda data: read.append(len(data)) or piece(data))
    assert CODEC.join(*parts).tolist() == direct(text)
    assert sum(read) < len(text.encode()) // 4


ROWS = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "null id"), (4, "long text " * 500), (4, "long text " * 500), (5, "x" * 5000), (6, "long text " * 500 + "!")]


def test_encode_table(spark):
    got = bpe.encode(docs(spark, ROWS), leaf=256).collect()
    want = sorted(((i, None if t is None else direct(t)) for i, t in ROWS), key=repr)
    assert sorted(((r["doc_id"], r["tokens"]) for r in got), key=repr) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in got if r["tokens"] is not None)
    back = bpe.decode(bpe.encode(docs(spark, ROWS), leaf=256))
    assert rows_of(back, "doc_id", "decoded_text") == sorted(ROWS, key=repr)


def test_encode_edges(spark):
    assert bpe.encode(empty(spark)).count() == 0
    assert bpe.encode(clashing(spark, [(1, "a b")])).first()["tokens"] == direct("a b")
    small = spark.createDataFrame([(1, "a b"), (2, "long " * 200)], "doc_id int, text string")
    assert rows_of(bpe.encode(small, leaf=256), "doc_id", "n_tokens") == [(1, 2), (2, len(direct("long " * 200)))]


def histogram(rows):
    out = {}
    for _, t in rows:
        if t is not None:
            out[len(direct(t))] = out.get(len(direct(t)), 0) + 1
    return out


def test_histogram_and_sums(spark):
    hist = token_counts.histogram(docs(spark, ROWS))
    want = histogram(ROWS)
    assert {r["n_tokens"]: r["documents"] for r in hist.collect()} == want
    sums = token_counts.suffix_sums(hist)
    n = sum(want.values())
    for r in sums.collect():
        limit = r["n_tokens"]
        assert r["longer_documents"] == sum(k for x, k in want.items() if x > limit)
        assert r["longer_tokens"] == sum(x * k for x, k in want.items() if x > limit)
        assert r["truncated_tokens"] == sum(min(x, limit) * k for x, k in want.items())
        assert r["total_tokens"] == sum(x * k for x, k in want.items())
        assert r["quantile"] == pytest.approx(sum(k for x, k in want.items() if x <= limit) / n)
    for r in token_counts.answers(sums, [0, 1, 2, 700, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context_limit"]) * k for x, k in want.items())


def test_quantiles_and_long_texts(spark):
    rows = ROWS + [(7, "many words and more " * 1500), (8, "word " * 4000)]  # over one leaf
    sums = token_counts.suffix_sums(token_counts.histogram(docs(spark, rows)))
    lengths = sorted(len(direct(t)) for _, t in rows if t is not None)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for r in token_counts.quantiles(sums, shares).collect():
        want = next(x for x in lengths if sum(y <= x for y in lengths) >= r["share"] * len(lengths))
        assert r["n_tokens"] == want and r["documents"] == lengths.count(want)
    none = token_counts.suffix_sums(token_counts.histogram(empty(spark)))
    assert [tuple(r) for r in token_counts.answers(none, [5, 5]).collect()] == [(5, 0, 0, 0)] * 2
    assert [tuple(r) for r in token_counts.quantiles(none, [0.5]).collect()] == [(0.5, None, None)]


def test_buckets_of_lengths(spark):
    hist = spark.createDataFrame([(i * 1500, i % 3 + 1) for i in range(20)], "n_tokens bigint, documents bigint")
    want = {i * 1500: i % 3 + 1 for i in range(20)}
    for r in token_counts.suffix_sums(hist).collect():
        assert r["longer_tokens"] == sum(x * k for x, k in want.items() if x > r["n_tokens"])


def test_histogram_edges(spark):
    assert token_counts.suffix_sums(token_counts.histogram(empty(spark))).count() == 0
    assert token_counts.histogram(clashing(spark, [(1, None), (1, "a")])).first()["documents"] == 1
