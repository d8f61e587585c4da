import pytest
from pyspark.sql import functions as F

from glyphmeter.functions.text import clean_tokens, strip_punctuation
from glyphmeter.operators import morphology as mo
from glyphmeter.plans.registry import morphology as plans

CASES = [
    ("walking", ["walk", "##ing"], ["walk", "ing"], 1.0, 1.0),
    ("unhappy", ["un@@", "happy"], ["un", "happy"], 1.0, 1.0),
    ("replay", ["Ġre", "pl", "ay"], ["re", "play"], 2 / 3, 1 / 2),
    ("cats", ["Ġcats"], ["cat", "s"], 0.0, 0.0),
    ("Hausboot", ["Ġhaus", "boot"], ["haus", "boot"], 1.0, 1.0),
]


@pytest.mark.parametrize("word,tokens,morphemes,f1,kept", CASES)
def test_scores(spark, word, tokens, morphemes, f1, kept):
    row = spark.createDataFrame([(word, tokens, morphemes)], "word string, tokens array<string>, morphemes array<string>")
    for scored in (mo.direct_scores(row), mo.full_scores(row)):
        r = scored.first()
        assert r["f1"] == pytest.approx(f1) and r["preservation"] == pytest.approx(kept)


def test_fuzzy_and_even_spans():
    assert mo.token_spans("running", ["run", "ing"]) == [(0, 3), (4, 7)]
    assert mo.token_spans("abcdef", ["zzzzzzzz", "q"]) == [(0, 3), (3, 6)]
    assert mo.morpheme_spans("running", ["run", "xx", "ing"]) == [(0, 3), (4, 7)]
    assert mo.morpheme_spans("abcd", ["x"]) == [(0, 4)]


def aligned(spark, text, tokens):
    df = spark.createDataFrame([("t", "en", 1, text, tokens)], "tokenizer string, lang string, doc_id bigint, text string, tokens array<string>")
    return [(r["word"], r["tokens"]) for r in mo.align_words(df).orderBy("word_index").collect()]


def test_alignment(spark):
    assert aligned(spark, "the cat sat", ["the", "Ġcat", "Ġs", "at"]) == [("the", ["the"]), ("cat", ["Ġcat"]), ("sat", ["Ġs", "at"])]
    assert aligned(spark, "Hello, world!", ["Hello", ",", "Ġworld", "Ġ!"]) == [("hello", ["Hello", ","]), ("world", ["Ġworld", "Ġ!"])]
    assert aligned(spark, "one", ["one", "Ġextra"]) == [("one", ["one", "Ġextra"])]
    assert aligned(spark, "one two", ["one"]) == [("one", ["one"])] and aligned(spark, "", ["x"]) == aligned(spark, "x", []) == []
    assert aligned(spark, "a b", ["<|s|>", "a", "Ġ", ".", "Ġb", "[", "##!", "x@@", "</w>"]) == [("a", ["<|s|>", "a", "Ġ", "."]), ("b", ["Ġb", "[", "##!", "x@@", "</w>"])]


def test_options_of_morpheme_scores(spark):
    rows = [("t", "en", "cats", ["cat", "s"], ["cat", "s"], 3, "x"), ("t", "en", "dog", ["dog"], ["dog"], 1, "y"), ("t", "fra_Latn", "ab", ["a", "b"], ["ab"], 1, "x"), ("u", "en", "cats", ["c", "ats"], ["cat", "s"], 1, "x")]
    scored = mo.full_scores(spark.createDataFrame(rows, "tokenizer string, lang string, word string, tokens array<string>, morphemes array<string>, n int, part string"))
    by = lambda df, *k: {tuple(r[c] for c in k): r for r in df.collect()}
    got = by(mo.morph_score(scored, times="n"), "tokenizer", "lang")
    assert got["t", "en"]["morphscore_recall"] == pytest.approx(3 / 4) and got["t", "en"]["num_samples"] == 2
    assert by(mo.morph_score(scored, weighted=False), "tokenizer", "lang")["t", "en"]["morphscore_recall"] == pytest.approx(1 / 2)
    assert set(by(mo.morph_score(scored, split="part"), "tokenizer", "lang", "part")) == {("t", "en", "x"), ("t", "en", "y"), ("t", "fra_Latn", "x"), ("u", "en", "x")}
    assert set(by(mo.morph_score(scored, languages=["fr"]), "lang")) == {("fra_Latn",)}
    summary = by(mo.morph_score_summary(mo.morph_score(scored, times="n")), "tokenizer")
    assert summary["t",]["languages_evaluated"] == 2 and summary["t",]["avg_morphscore_recall"] == pytest.approx(3 / 8)
    assert summary[None,]["avg_morphscore_recall"] == pytest.approx(3 / 16) and summary[None,]["total_samples"] == 4
    codes = spark.createDataFrame([("en",), ("xx",)], "lang string").select(mo.to_long_codes(F.col("lang")).alias("c")).collect()
    assert [r["c"] for r in codes] == ["eng_Latn", "xx"]


@pytest.mark.parametrize("base,derived,expect", [("teach", "teacher", ["teach", "er"]), ("happy", "unhappy", ["un", "happy"]), ("teacher", "teach", ["teach"]), ("happy", "happiness", ["happ", "iness"]), ("go", "went", ["went"]), ("walk", "wabclk", ["bc", "walk"])])
def test_inferred_morphemes(spark, base, derived, expect):
    df = spark.createDataFrame([(base, derived)], "b string, d string")
    assert df.select(mo.infer_morphemes(F.col("b"), F.col("d"), F.lit(None)).alias("m")).first()["m"] == expect


def test_lookup_by_code_and_priority(spark):
    words = spark.createDataFrame([("en", "Cats"), ("de", "hund"), ("xx", "cats")], "lang string, word string")
    lexicon = spark.createDataFrame([("eng", 1, "cats", ["ca", "ts"]), ("eng", 0, "cats", ["cat", "s"]), ("de", 0, "hund", ["hund"])], "lang string, priority int, word string, morphemes array<string>")
    codes = spark.createDataFrame([("en", "eng"), ("de", "deu")], "lang string, other string")
    got = {(r["lang"], r["word"]): r["morphemes"] for r in mo.lookup_morphemes(words, lexicon, codes).collect()}
    assert got == {("en", "Cats"): ["cat", "s"], ("de", "hund"): ["hund"]}


def test_scores_of_batches_are_those_of_single_words(spark):
    """Against plain Python, with marks, tokens that spell the word or don't, repeated and empty parts."""
    import random

    pick = random.Random(3)

    def cut(w, n):
        at = sorted(pick.randrange(len(w) + 1) for _ in range(n))
        return [w[a:b] for a, b in zip([0, *at], [*at, len(w)])]

    rows = []
    for k in range(400):
        w = "".join(pick.choice("abÀéß🙂İ") for _ in range(pick.randrange(1, 9)))
        tokens, morphemes = cut(w, pick.randrange(4)), cut(w, pick.randrange(3))
        tokens = [pick.choice(["", "##", "Ġ"]) + x for x in tokens] + pick.choice([[], [], ["[x|>"], ["[a\nb]"], ["<|a|>\n"], ["zz"], [None]])
        rows.append((k, w, tokens, pick.choice([morphemes, morphemes, [x.upper() for x in morphemes], morphemes[::-1], []])))
    df = spark.createDataFrame(rows, "k int, word string, tokens array<string>, morphemes array<string>")
    cleaned = {r["k"]: r["c"] for r in df.select("k", clean_tokens(F.col("tokens")).alias("c")).collect()}
    got = {r["k"]: r for r in mo.full_scores(df).collect()}
    assert set(got) == {k for k, _, _, m in rows if cleaned[k] and m}
    for k, w, _, m in rows:
        if k in got:
            t, r = cleaned[k], got[k]
            found, true = ({b for _, b in f(w, x)} - {len(w)} for f, x in ((mo.token_spans, t), (mo.morpheme_spans, m)))
            p, c = (len(found & true) / len(x) if x else 0.0 for x in (found, true))
            assert r["tokens"] == t and (r["precision"], r["recall"], r["f1"]) == (p, c, 2 * p * c / (p + c) if p + c else 0.0)
            assert r["preservation"] == sum(x in t for x in m) / len(m) and r["over_segmentation"] == max(len(t) - len(m), 0) / len(m)
    assert "array_intersect" not in plan(mo.full_scores(df))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_split_once(spark):
    assert plan(plans.words(spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 1


def test_stripped_punctuation(spark):
    import re

    values = ["", "a", "...a.b!?", "(([x]))", "?!", ' ".a', "é:", None]
    df = spark.createDataFrame([(v,) for v in values], "w string").select("w", strip_punctuation(F.col("w")).alias("s"))
    cls = r"[.,!?;:\"()\[\]{}]+"
    assert [r["s"] for r in df.collect()] == [None if v is None else re.sub(rf"^{cls}|{cls}\Z", "", v) for v in values]
    assert "regexp" not in plan(df)


def test_summary_of_scores(spark):
    rows = [("t", "en", *(x,) * 5) for x in (0.0, 0.5, 1.0)]
    scored = spark.createDataFrame(rows, "tokenizer string, lang string, " + ", ".join(f"{c} double" for c in mo.SCORES))
    got = mo.summarise(scored)
    assert got.columns == ["tokenizer", "lang", "metric", "count", "mean", "std"] and {(r["metric"], r["count"], r["mean"]) for r in got.collect()} == {(c, 3, 0.5) for c in mo.SCORES}
