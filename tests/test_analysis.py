import json

import pytest

from glyphmeter.__main__ import main
from glyphmeter.operators import analysis as an
from glyphmeter.operators import groups as gr
from glyphmeter.operators import reports as rp
from glyphmeter.sources import tokenizers as tkz

TEXTS = {"en": ["the cats sat here", "unhappy cats walk, slowly"], "fr": "été à midi"}


def inputs(spark):
    texts = an.texts_of(TEXTS, spark)
    rows = spark.createDataFrame([("en", 1, "ab c", [0, 5]), ("fr", 2, "d", [2])], "lang string, doc_id bigint, text string, tokens array<int>")
    return [an.Input("ws", tokenizer="whitespace", texts=texts), an.Input("bpe", tokenizer="/opt/tokenizers/byte_bpe_50k.json", texts=texts), an.Input("done", rows=rows)]


def test_inputs(spark):
    texts = an.texts_of(TEXTS, spark)
    for bad in ({}, {"tokenizer": "whitespace"}, {"texts": texts}, {"tokenizer": "whitespace", "texts": texts, "rows": texts}, {"rows": texts, "vocab_size": 0}):
        with pytest.raises(ValueError):
            an.Input("x", **bad)
    with pytest.raises(ValueError):
        an.Analysis([inputs(spark)[0]] * 2)


def test_whole_analysis(spark, tmp_path):
    lexicon = spark.createDataFrame([("en", "l", 0, "cats", ["cat", "s"]), ("en", "l", 0, "unhappy", ["un", "happy"])], "lang string, dataset string, priority int, word string, morphemes array<string>")
    groups = gr.group_table(spark, {"family": {"a": ["en"], "b": ["fr"]}, "all": {"every": ["en", "fr"]}})
    a = an.Analysis(inputs(spark), groups, lexicon)
    assert {r["tokenizer"]: r["vocab_size"] for r in a.sizes.collect()} == {"ws": 10, "bpe": 50257, "done": 6}
    results = a.run()
    assert not [name for name, df in results.items() if df.isEmpty()]
    assert len(results) == 26
    bpe = {r["metric"]: r["mean"] for r in results["morphology"].where("tokenizer = 'bpe' and lang = 'en'").collect()}
    assert bpe["f1"] > 0  # ids are spelled before they are compared: "unhappy" begins with "un"
    with pytest.raises(ValueError, match="beyond the vocabulary"):
        an.Analysis([an.Input("bad", rows=inputs(spark)[2].rows, vocab_size=3)])
    assert an.Analysis([an.Input("bad", rows=inputs(spark)[2].rows, vocab_size=3)], validate=False).summary().first()["vocab_size"] == 3
    grouped = a.grouped(["family"])
    assert {r["group_name"] for r in grouped["fertility"].collect()} == {"a", "b"}
    assert grouped["morph_score"].count() > 0 and a.grouped(["nothing"])["gini"].count() == 0
    a.save(str(tmp_path / "out"), {n: results[n] for n in ("gini", "lorenz", "fertility", "fertility_per_language", "fertility_pairs")} | {"grouped_fertility": grouped["fertility"]})
    full = json.loads((tmp_path / "out" / "full_results.json").read_text())
    assert set(full["fertility_per_language"]["ws"]) == {"en", "fr"} and "bpe_vs_ws" in full["fertility_pairs"] and full["grouped_fertility"]["ws"]
    drawn = {p.name for p in (tmp_path / "out" / "views").iterdir()}
    assert drawn >= {"fertility_bars", "fertility_by_language", "fertility_facets", "fertility_by_group", "gini_bars", "lorenz"}
    assert {"morph_f1", "morphscore_recall"} <= {r["metric"] for r in a.values().collect()}
    assert any("MorphScore Recall" in line or "MorphScore" in line for line in rp.latex(a.values(), "comprehensive"))
    a.close()
    assert "fertility" in json.loads((tmp_path / "out" / "analysis_results.json").read_text())["ws"]
    assert "ws" in rp.text_report(a.values())
    assert rp.select_tokenizers(a.values(), ["ws"]).count() > 0
    with pytest.raises(ValueError):
        rp.select_tokenizers(a.values(), ["nobody"])
    with pytest.raises(ValueError):
        an.Analysis(inputs(spark)).grouped()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "en.json").write_text(json.dumps([{"text": "hello there world"}, {"text": "one two"}]))
    (tmp_path / "fr.json").write_text(json.dumps([{"text": "bonjour le monde"}]))
    (tmp_path / "t.json").write_text(json.dumps({"ws": "whitespace", "bpe": {"path": "/opt/tokenizers/byte_bpe_50k.json"}}))
    (tmp_path / "l.json").write_text(json.dumps({"languages": {x: {"name": x, "data_path": str(tmp_path / f"{x}.json")} for x in ("en", "fr")}, "analysis_groups": {"k": {"g": ["en"]}}}))
    out = tmp_path / "results"
    main(["--samples", str(tmp_path / "samples")])
    (tmp_path / "lex.tsv").write_text("hello\thel-lo\nworld\tworld\n")
    (tmp_path / "x.json").write_text(json.dumps([["l", "hyphenated", str(tmp_path / "lex.tsv")]]))
    configs = [a for o, f in (("--normalization", "normalization"), ("--morph-score", "morph_score"), ("--latex-config", "tables")) for a in (o, str(tmp_path / "samples" / f"{f}.json"))]
    main(["--tokenizers", str(tmp_path / "t.json"), "--languages", str(tmp_path / "l.json"), "--output", str(out), "--grouped", "--latex", "fertility", "gini", "--save-tokenized", "--no-views", "--lexicons", str(tmp_path / "x.json"), *configs])
    said = capsys.readouterr().out
    assert "Fertility" in said and "MorphScore" in said and (out / "table.tex").exists() and (out / "grouped_gini").exists() and "Cost and fairness" in (out / "short.tex").read_text()
    names = {r["token"] for r in spark.read.parquet(str(out / "tokenized" / "vocabulary")).where("tokenizer = 'ws'").collect()}
    assert names == {"hello", "there", "world", "one", "two", "bonjour", "le", "monde"}  # real tokens
    main(["--tokenized", str(out / "tokenized"), "--output", str(tmp_path / "again"), "--no-views", "--only", "ws", "--unit", "words"])
    first, again = (json.loads((x / "analysis_results.json").read_text())["ws"] for x in (out, tmp_path / "again"))
    assert first["fertility"] == again["fertility"] and first["gini"] == again["gini"]
    with pytest.raises(SystemExit):
        main(["--tokenizers", "x"])


def test_byte_level_directory(tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1, "ab": 2, "Ġ": 3, "<s>": 4, "</s>": 5}))
    (tmp_path / "merges.txt").write_text("#version: 1\na b\n")
    spec = tkz.load("d", str(tmp_path))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec.spec)
    assert tok.encode("ab a", add_special_tokens=False).tokens == ["Ġ", "ab", "Ġ", "a"]
    assert tok.encode("ab").tokens == ["<s>", "Ġ", "ab", "</s>"]
    assert [s.name for s in tkz.load_all({"x": str(tmp_path)})] == ["x"]


def test_ids_spelled_by_a_file(spark, tmp_path):
    import hashlib

    from tokenizers import Tokenizer

    from glyphmeter.plans.registry import QUERIES

    rows = [(1, "Hello wörld"), (2, "x" * 3000 + "é漢"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    want = {}
    for i, text in rows[:2]:
        ids = [(ord(c) * 31 + k + 1) % 50300 for k, c in enumerate(text)]
        tokens = [tok.id_to_token(x) or f"<UNK_{x}>" for x in ids]
        want[i] = (hashlib.md5("␟".join(tokens).encode()).hexdigest(), sum(tok.id_to_token(x) is None for x in ids))
    assert {r["doc_id"]: (r["digest"], r["unknown"]) for r in QUERIES["file_vocabulary"](spark, str(tmp_path)).collect()} == want
    assert any(n for _, n in want.values())
