import pytest
from pyspark.sql import functions as F

from glyphmeter.functions import text as t

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value", ["", " ", "a", " a  b\tc\n", "x".join(SPACES), "​a\x1bb᠎", f"{SPACES}mid dle{SPACES}", "é🙂 語"])
def test_words_and_strip_are_pythons(spark, value):
    assert one(spark, value, t.split_words) == value.split()
    assert one(spark, value, t.strip) == value.strip()
    assert one(spark, value, t.collapse) == " ".join(value.split())


def test_counts(spark):
    text = "Hé, wörld!  2 x"
    expect = {t.BYTES: 17, t.CHARACTERS: 15, t.LINES: 1, t.WORDS: 4, t.PIECES: 6, t.Normalization(t.Unit.WORDS, keep_empty=True): 5}
    for kind, n in expect.items():
        assert one(spark, text, kind.count) == n
        assert one(spark, None, kind.count) == one(spark, "", kind.count) == 0
    assert one(spark, text, t.MARKED_BYTES.count) == sum(len(p.encode()) + 1 for p in ("Hé", ",", "wörld", "!", "2", "x"))


def test_normalization_rules():
    assert t.Normalization.from_dict(t.PIECES.to_dict()) == t.PIECES
    assert [n.description() for n in (t.LINES, t.BYTES, t.CHARACTERS, t.WORDS)] == ["line", "byte", "char", "word"]
    with pytest.raises(ValueError):
        t.Normalization(t.Unit.WORDS, t.Splitter.CUSTOM)
    with pytest.raises(ValueError):
        t.Normalization(t.Unit.WORDS, marked=True)
    with pytest.raises(ValueError):
        t.split_regex(F.lit("a"), "(a)b")


def test_splitting(spark):
    text = "First block here.\nline two!\n\nSecond  block? Yes it is.\n\nab"
    assert one(spark, text, t.paragraphs) == ["First block here.\nline two!", "Second  block? Yes it is."]
    assert one(spark, "no blank line", t.paragraphs) == []
    assert one(spark, text, t.lines) == ["First block here.", "line two!", "Second  block? Yes it is."]
    assert one(spark, text, t.sentences) == ["First block here", "line two", "Second  block", "Yes it is"]
    assert one(spark, "abcdefgh ij", lambda x: t.chunks(x, 4)) == ["abcd", "efgh", "ij"]
    assert one(spark, "abc", lambda x: t.chunks(x, 4)) == ["abc"]
    assert one(spark, "  a   b \n  c  ", t.tidy) == "a b\nc"


def test_cascade(spark):
    text = "One long line\n\nOther line here\nOne long line"
    assert one(spark, text, lambda x: t.extract_units(x, 9)) == ["One long line", "Other line here\nOne long line", "Other line here", text.replace("\n\n", "\n\n")][:2] + ["Other line here", text]
    assert one(spark, "abcdefghij", lambda x: t.extract_units(x, 1)) == ["abcdefghij"]
    assert one(spark, "ab", lambda x: t.extract_units(x, 5)) == []
    assert one(spark, "ab cd\nef gh", lambda x: t.extract_units(x, 2)) == ["ab cd", "ef gh"]


@pytest.mark.parametrize("token,clean", [("Ġthe", "the"), ("▁a", "a"), (" b", "b"), ("##ing", "ing"), ("end</w>", "end"), ("go@@", "go"), ("<|pad|>", ""), ("[x|>", ""), ("[SEP]", ""), ("plain", "plain"), ("Ġ", "")])
def test_markers(spark, token, clean):
    assert one(spark, token, t.clean_marker) == clean
