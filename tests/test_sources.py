import json

import pytest

from glyphmeter.operators import tokenized as tk
from glyphmeter.sources import lexicons, texts, tokenized
from glyphmeter.sources import tokenizers as tkz
from glyphmeter.streaming import counts as st


def values(df, column="text"):
    return [r[column] for r in df.collect()]


def test_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": " one "}, {"text": ""}, {"other": 1}]))
    (tmp_path / "b.json").write_text('{"text": "two"}\nnot json\n{"text": "three"}\n')
    (tmp_path / "c.txt").write_text("First paragraph.\n\nSecond paragraph.")
    spark.createDataFrame([("four", 1), (None, 2), ("nan", 3)], "content string, n int").coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    assert values(texts.read_json(spark, str(tmp_path / "a.json"))) == ["one"]
    assert sorted(values(texts.read_json(spark, str(tmp_path / "b.json")))) == ["three", "two"]
    assert values(texts.read_parquet(spark, str(tmp_path / "d.parquet"))) == ["four"]
    got = values(texts.read_path(spark, str(tmp_path)).orderBy("text_id"))
    assert got[:3] == ["one", "two", "three"] and "four" in got and "First paragraph." in got
    assert values(texts.read_path(spark, str(tmp_path), most=2).orderBy("text_id")) == ["one", "two"]
    assert texts.read_path(spark, str(tmp_path / "missing")).count() == 0
    both = texts.read_languages(spark, {"en": str(tmp_path / "a.json"), "fr": str(tmp_path / "missing")})
    assert [(r["lang"], r["text"]) for r in both.collect()] == [("en", "one")]
    odd = {'{"text": "hello world one",\n "id": 1}': ["hello world one"], '{\n "meta":\n {"a": 1},\n "text": "x"\n}': ["x"], '\n\n[\n{"text": "p"},\n{"text": "q"}\n]': ["p", "q"], '{"id": 1\n{"text": "after a bad line"}': ["after a bad line"], "": [], "nothing": []}
    for k, (content, want) in enumerate(odd.items()):
        (tmp_path / f"odd{k}.data").write_text(content)
        assert values(texts.read_json(spark, str(tmp_path / f"odd{k}.data"))) == want
    with pytest.raises(ValueError):
        texts.text_column(spark.createDataFrame([(1,)], "n int"))


def test_tokenized_stores(spark, tmp_path):
    rows = [{"tokenizer_name": "t", "language": "en", "tokens": [1, 2], "text": "ab", "metadata": {"k": "v"}}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "k.json").write_text(json.dumps({"named": rows}))
    flat = tokenized.read_records(spark, str(tmp_path / "r.json"))
    assert flat.first()["tokens"] == [1, 2] and flat.first()["metadata"] == {"k": "v"}
    assert tokenized.read_keyed(spark, str(tmp_path / "k.json")).first()["tokenizer"] == "named"
    tokenized.write_records(flat, str(tmp_path / "out"))
    assert tokenized.read_records(spark, str(tmp_path / "out")).first()["text"] == "ab"
    tokenized.write_store(flat, None, str(tmp_path / "store"))
    back, vocab = tokenized.read_store(spark, str(tmp_path / "store"))
    assert back.first()["tokens"] == [1, 2] and sorted(values(vocab, "token")) == ["<token_0>", "<token_1>", "<token_2>"]
    (tmp_path / "v.txt").write_text("a\n\n b \n")
    v = tokenized.read_vocabulary(spark, str(tmp_path / "v.txt"), "t")
    assert [(r["token_id"], r["token"]) for r in v.collect()] == [(0, "a"), (1, "b")]
    assert tokenized.vocabulary_sizes(v).first()["vocab_size"] == 2
    with pytest.raises(ValueError):
        tokenized.read_keyed(spark, "x.pkl")


def test_lexicons(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("# c\nUnhappy\tun-happy\nbroken\n")
    (tmp_path / "s.csv").write_text("Word,MorphoLexSegm\nCats,cat+s\nNone,\n")
    (tmp_path / "d.tsv").write_text("en\tteacher\tteach→teacher:N\n")
    (tmp_path / "j.json").write_text(json.dumps([{"word": "Hund", "morphemes": ["hund"]}]))
    rows = lexicons.read_all(spark, [("h", "hyphenated", str(tmp_path / "h.tsv")), ("s", "segmented", str(tmp_path / "s.csv")), ("d", "derivations", str(tmp_path / "d.tsv")), ("j", "json", str(tmp_path / "j.json"))])
    got = {(r["lang"], r["dataset"], r["priority"], r["word"]): r["morphemes"] for r in rows.collect()}
    assert got == {("en", "h", 0, "unhappy"): ["un", "happy"], ("en", "s", 1, "cats"): ["cat", "s"], ("en", "d", 2, "teacher"): ["teach", "er"], ("de", "j", 3, "hund"): ["hund"]}
    with pytest.raises(ValueError):
        lexicons.read_all(spark, [("x", "y", "z")])


def test_tokenizer_files(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    spec = tkz.load("b", path)
    assert spec.vocab_size == 50257
    texts_ = spark.createDataFrame([("en", 1, "hello world"), ("en", 2, " "), ("en", 3, None)], "lang string, doc_id bigint, text string")
    assert tk.encode_with_file(texts_, path, "b").first()["tokens"] == [31373, 995]
    assert tk.encode_with_file(texts_, path, "b", max_length=1).first()["tokens"] == [31373]
    padded = tk.encode_with_file(texts_, path, "b", pad_to=4, pad_id=7, details=True).first()
    assert padded["tokens"] == [31373, 995, 7, 7] and padded["attention_mask"] == [1, 1, 0, 0]
    assert [tuple(x) for x in padded["offsets"]] == [(0, 5), (5, 11), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        tkz.load("x", "/nowhere")


def test_streams_add_up(spark, tmp_path):
    docs = spark.createDataFrame([("en", i, f"w{i % 3} x") for i in range(20)], "lang string, doc_id bigint, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = st.merge_counts(stream, str(tmp_path / "counts"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = tk.token_counts(tk.tokenize(docs))
    key = lambda df: sorted((r["tokenizer"], r["lang"], r["token"], r["n"]) for r in df.collect())
    assert key(st.merged_counts(spark, str(tmp_path / "counts"))) == key(want)
    totals = st.streaming_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    totals.awaitTermination(120)
    assert spark.table("totals").where("tokenizer = 'whitespace'").first()["tokens"] == 40


def test_quick_encoding_is_the_same(spark, tmp_path):
    """What tiktoken encodes, and what is left to the tokenizers library, against the latter alone; other files are left to it."""
    import json
    import random

    from tokenizers import Tokenizer

    from glyphmeter.operators.tokenized import encode_with_file
    from glyphmeter.sources.tokenizers import alike, byte_ranks

    path, pick = "/opt/tokenizers/byte_bpe_50k.json", random.Random(1)
    spec = open(path, encoding="utf-8").read()
    ranks, added = byte_ranks(spec)
    assert len(ranks) == 50256 and added == ["<|endoftext|>"]
    changed = json.loads(spec)
    changed["model"]["merges"][5:7] = changed["model"]["merges"][6:4:-1]
    assert byte_ranks(json.dumps(changed)) is None and byte_ranks(json.dumps(changed | {"normalizer": {"type": "NFC"}})) is None
    chars = [chr(c) for c in range(0x250)] + list("  \n\t aeinrst'lv") * 20
    texts = ["".join(pick.choice(chars) for _ in range(60)) for _ in range(300)] + ["we'll  go\n\n on", "a<|endoftext|>b", "x" * 5000, " " * 3000 + "a", "漢字 🙂 é"]
    assert [alike(x, added) for x in texts[-5:]] == [True, False, False, False, False] and all(alike(x, added) for x in texts[:300])
    got = {r["doc_id"]: r["tokens"] for r in encode_with_file(spark.createDataFrame([("en", k, x) for k, x in enumerate(texts)], "lang string, doc_id bigint, text string"), path, "b").collect()}
    tok = Tokenizer.from_file(path)
    assert got == {k: tok.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts)}
