import math

import pytest
from pyspark.sql import functions as F

from glyphmeter.operators import groups as gr
from glyphmeter.operators import measures as ms
from glyphmeter.operators import reports as rp
from glyphmeter.operators import tokenized as tk
from glyphmeter.operators import validation as va


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("en", 1, "a b c\nd"), ("en", 2, "hello, world"), ("fr", 3, "été à midi"), ("fr", 4, None), ("fr", 5, ""), ("en", 6, " \n ")]
    return spark.createDataFrame(rows, "lang string, doc_id bigint, text string")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blank_texts_are_skipped(texts):
    assert tk.tokenize(texts, ("whitespace",)).count() == 3
    assert tk.text_stats_of(texts).count() == 9


def test_both_ways_to_stats_agree(texts):
    a = tk.text_stats(tk.tokenize(texts)).select(sorted(tk.text_stats_of(texts).columns))
    b = tk.text_stats_of(texts).select(a.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("by", [("tokenizer", "lang"), ("tokenizer",)])
def test_both_ways_to_counts_agree(spark, texts, by):
    more = texts.union(spark.createDataFrame([(None, 7, "no language \x00"), ("de", 8, "äöü🙂"), ("en", 9, "again")], texts.schema))
    for rows in (more, more.where("doc_id = 4")):
        a, b = tk.token_counts(tk.tokenize(rows), by), tk.token_counts_of(rows, by=by)
        assert a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert "regexp_extract_all(hex" not in plan(tk.token_counts_of(more, by=by))
    total = tk.token_counts_of(more, by=("tokenizer",))
    assert by_size(tk.least_sizes(total)) == by_size(tk.vocabulary_of(total).groupBy("tokenizer").agg((F.max("token_id") + 1).alias("vocab_size")))
    assert "Window" not in plan(tk.least_sizes(total))


def by_size(df):
    return {r["tokenizer"]: r["vocab_size"] for r in df.collect()}


def test_groups_move_no_rows(spark, texts):
    """A join by language would bring all rows of one to one task."""
    groups = gr.group_table(spark, {"k": {"g": ["en"]}})
    langs = gr.Languages(spark, {"en": {}}, {"k": {"g": ["en"]}})
    for found in (gr.by_group(texts, groups), gr.in_languages(texts, groups), langs.named(texts), langs.in_group(texts, "k")):
        assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)


def test_fertility(texts):
    got = by(ms.fertility(tk.text_stats_of(texts)), "tokenizer")
    r = got["pieces",]
    values = [4 / 4, 3 / 2, 3 / 3]
    assert r["mean"] == pytest.approx(sum(values) / 3) and r["median"] == 1.0 and r["count"] == 3
    assert ms.fertility(tk.text_stats_of(texts).where("doc_id = 1")).first()["std_err"] is None


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [0.0, 0.0, 5.0, -2.5], [-1.0, -1.5, -0.25, 0.0], [0.1 * k for k in range(101)], [7.0] * 9, [1.0, 1e9, 1e-9, 2.0]])
def test_summaries_against_statistics(spark, values):
    import statistics as st

    rows = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 4.0), (None, 2.0)], "k string, v double")
    got = {r["k"]: r for r in ms.summarise(rows, F.col("v"), ["k"]).collect()}
    r = got["a"]
    assert r["median"] == st.median(values) and r["mean"] == pytest.approx(st.fmean(values), abs=1e-9) and r["count"] == len(values)
    assert r["std"] == pytest.approx(st.pstdev(values), abs=1e-7) and (r["min"], r["max"]) == (min(values), max(values))
    assert r["std_err"] is None if len(values) == 1 else r["std_err"] == pytest.approx(st.stdev(values) / len(values) ** 0.5, abs=1e-7)
    assert got["b"]["median"] == 4.0 and got[None]["median"] == 2.0 and set(got) == {"a", "b", None}


def test_absent_groups_are_zeros(spark):
    values = spark.createDataFrame([("t", "en", 1.5, 2)], "tokenizer string, lang string, mean double, count bigint")
    keys = spark.createDataFrame([("t", "en"), ("t", "fr")], "tokenizer string, lang string")
    assert {r["lang"]: (r["mean"], r["count"]) for r in ms.with_absent(values, keys).collect()} == {"en": (1.5, 2), "fr": (0.0, 0)}


@pytest.mark.parametrize("most", [tk.HELD_BYTES, 0])
def test_ids_by_lookup_and_by_join(spark, most):
    tok = spark.createDataFrame([("a", 1, ["x", "y", "x"], "l"), ("b", 1, ["y"], "m"), ("c", 2, ["x"], "n"), ("a", 3, [], "o")], "tokenizer string, doc_id bigint, tokens array<string>, lang string")
    vocab = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "x", 0)], "tokenizer string, token string, token_id bigint")
    got = {(r["tokenizer"], r["doc_id"]): (r["lang"], r["token_ids"]) for r in tk.encode_ids(tok, vocab, most, keep=("lang",)).collect()}
    assert got == {("a", 1): ("l", [0, 1, 0]), ("b", 1): ("m", [-1]), ("c", 2): ("n", [-1])}
    back = tk.decode_ids(tk.encode_ids(tok, vocab, most), vocab, most)
    assert {(r["tokenizer"], r["doc_id"]): r["tokens"] for r in back.collect()} == {("a", 1): ["x", "y", "x"], ("b", 1): ["<UNK_-1>"], ("c", 2): ["<UNK_-1>"]}


def test_entropy_of_uniform_and_single(spark):
    counts = spark.createDataFrame([("u", str(i), 5) for i in range(4)] + [("s", "x", 9)], "tokenizer string, token string, n bigint")
    for r in ms.renyi(counts).collect():
        assert r["entropy"] == pytest.approx(2.0 if r["tokenizer"] == "u" else 0.0)
    got = by(ms.unigram(counts), "tokenizer")
    assert got["u",]["avg_token_rank"] == 2.5 and got["s",]["avg_token_rank"] == 1.0


def test_entropy_falls_with_order(texts):
    rows = by(ms.renyi(tk.roll_up(tk.token_counts(tk.tokenize(texts)))), "tokenizer", "alpha")
    for name in tk.STANDARD:
        values = [round(rows[name, a]["entropy"], 9) for a in ms.ORDERS]
        assert values == sorted(values, reverse=True)


def test_gini_and_lorenz(spark):
    costs = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 2.0), ("t", "c", 3.0), ("one", "a", 2.0)], "tokenizer string, lang string, cost double")
    got = by(ms.gini(costs), "tokenizer")
    assert got["t",]["gini"] == pytest.approx(8 / 36) and got["t",]["most_efficient"] == "a"
    assert got["one",]["gini"] == 0 and got["one",]["warning"]
    pairs = by(ms.gini_by_pairs(costs), "tokenizer")
    assert pairs["t",]["gini"] == pytest.approx(8 / 36)
    points = [(r["x"], r["y"]) for r in ms.lorenz(costs).where("tokenizer = 't'").orderBy("point").collect()]
    assert points[0] == (0, 0) and points[-1] == pytest.approx((1, 1))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert 1 - 2 * area == pytest.approx(8 / 36)
    assert ms.lorenz(costs).where("tokenizer = 'one'").count() == 0


def test_pairwise(spark):
    values = spark.createDataFrame([("a", 2.0), ("b", 0.0), ("c", 1.0)], "tokenizer string, mean double")
    got = by(ms.pairwise(values), "pair")
    assert len(got) == 3 and got["a_vs_b",]["ratio"] == 1.0 and got["a_vs_c",]["percent_difference"] == pytest.approx(100 / 1.5)


def test_all_languages_as_a_group_are_the_whole(spark, texts):
    stats = tk.text_stats_of(texts)
    whole = gr.group_table(spark, {"all": {"every": ["en", "fr"]}})
    a = by(ms.fertility(gr.by_group(stats, whole), by=("group_name", "tokenizer")), "tokenizer")
    b = by(ms.fertility(stats), "tokenizer")
    assert all(a[k]["mean"] == pytest.approx(b[k]["mean"]) for k in b)


def test_language_metadata(spark, tmp_path):
    config = tmp_path / "l.json"
    config.write_text('{"languages": {"en": {"name": "English"}, "fr": "/x"}, "analysis_groups": {"k": {"g": ["en"]}}}')
    langs = gr.Languages.from_file(spark, str(config))
    assert [r["lang"] for r in langs.select("k", "g").collect()] == ["en"]
    names = {r["lang"]: r["name"] for r in langs.named(spark.createDataFrame([("en",), ("xx",)], "lang string")).collect()}
    assert names == {"en": "English", "xx": "Unknown"}
    with pytest.raises(ValueError):
        gr.Languages(spark, {"en": {}}, {"k": {"g": ["de"]}})
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        gr.Languages.from_file(spark, str(tmp_path / "bad.json"))


def test_ids_round_trip_and_unknown(texts, spark):
    tok = tk.tokenize(texts, ("pieces",))
    vocab = tk.vocabulary(tok)
    ids = sorted(r["token_id"] for r in vocab.collect())
    assert ids == list(range(len(ids)))
    back = by(tk.decode_ids(tk.encode_ids(tok, vocab), vocab), "doc_id")
    assert all(back[k]["tokens"] == r["tokens"] for k, r in by(tok, "doc_id").items())
    lost = tk.decode_ids(tk.encode_ids(tok, vocab.where("token <> 'b'")), vocab)
    assert "<UNK_-1>" in by(lost, "doc_id")[1,]["tokens"]


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    got = df.select(tk.pad(tk.truncate(F.col("t"), 1), 3, F.lit("P")).alias("p"), tk.attention_mask(F.col("t"), 3).alias("m")).collect()
    assert got[0] == (["a", "P", "P"], [1, 1, 0]) and got[1] == (["P"] * 3, [0, 0, 0])


def test_validation(spark):
    rows = [("t", "en", 1, "ab", [0, -1]), ("t", "en", 2, "ab", [9]), ("t", "", 3, "a", [1, 2, 3]), ("t", "en", 4, "x", [])]
    encoded = spark.createDataFrame(rows, "tokenizer string, lang string, doc_id bigint, text string, token_ids array<int>")
    size = spark.createDataFrame([("t", 9)], "tokenizer string, vocab_size bigint")
    found = {(r["doc_id"], r["message"]) for r in va.entries(encoded, size).collect()}
    assert found == {(1, "negative ids: -1"), (2, "ids beyond the vocabulary: 9"), (3, "no language"), (3, "more tokens than characters"), (4, "no tokens")}
    with pytest.raises(ValueError):
        va.require_valid(encoded, size)
    assert va.require_valid(encoded.where("doc_id > 4"), size).count() == 0


def test_validation_moves_no_texts(spark):
    """A join by the tokenizer's name would bring all entries to one task."""
    encoded = spark.createDataFrame([("t", "en", 1, "ab", [0, -1])], "tokenizer string, lang string, doc_id bigint, text string, token_ids array<int>")
    size = spark.createDataFrame([("t", 9)], "tokenizer string, vocab_size bigint")
    for found in (va.entries(encoded, size), va.coverage(encoded, spark.createDataFrame([("en",)], "lang string"))):
        assert "SortMergeJoin" not in plan(found)
    assert "Exchange hashpartitioning" not in plan(va.entries(encoded, size))


def test_report_shows_the_first_of_many(spark):
    found = spark.createDataFrame([("error", f"m{k:03}") for k in range(300)] * 2 + [("warning", "w")], "severity string, message string")
    r = va.report(found).first()
    assert (r["valid"], r["errors"], r["warnings"], r["first_errors"], r["first_warnings"]) == (False, 600, 1, [f"m{k:03}" for k in range(5)], ["w"])
    r = va.report(found.where("false")).first()
    assert (r["valid"], r["errors"], r["first_errors"]) == (True, 0, [])


def test_reports(spark, texts):
    values = rp.all_values(tk.text_stats_of(texts), tk.token_counts(tk.tokenize(texts)))
    lines = rp.latex(values, ["fertility", "nothing", "gini"], caption="C", label="l", errors=True)
    assert lines[0].startswith(r"\begin{table}") and any(r"\textbf" in x for x in lines) and not any("nothing" in x for x in lines)
    assert rp.wrap_title("Vocabulary Utilization (%)") == r"\makecell{Vocabulary \\ Utilization (%)}"
    assert math.isclose(by(values, "tokenizer", "metric")["whitespace", "fertility"]["value"], 1.0)
    with pytest.raises(ValueError):
        rp.union_of(tk.tokenize(texts), tk.tokenize(texts))


def test_reports_measure_texts_once(spark, texts):
    values = rp.all_values(tk.text_stats_of(texts), tk.token_counts_of(texts))
    assert plan(values).count("(text#") > 0 and plan(values).count("explode(sizes") == 1  # twice if Gini measured them anew
    gini = by(ms.gini(ms.language_costs(tk.text_stats_of(texts))), "tokenizer")
    got = by(values.where("metric = 'gini'"), "tokenizer")
    assert set(got) == set(gini) and all(got[k]["value"] == pytest.approx(gini[k]["gini"]) for k in gini)


def test_ids_by_blocks(spark, monkeypatch):
    """Rows with equal keys stay apart, whatever their block; items are asked for once a block, not shuffled one by one."""
    monkeypatch.setattr(tk, "BLOCK_ITEMS", 64)
    rows = [(f"t{k % 2}", k % 40, [f"w{(k * j) % 17}" for j in range(k % 9)] + [None] * (k % 2), "l") for k in range(90)]
    tok = spark.createDataFrame(rows, "tokenizer string, doc_id bigint, tokens array<string>, lang string")
    vocab = tk.vocabulary(tok.where("doc_id < 30")).where("token <> 'w3'")
    both = []
    for most in (tk.HELD_BYTES, 0):
        ids = tk.encode_ids(tok, vocab, most, keep=("lang",))
        back = tk.decode_ids(ids, vocab, most, keep=("lang",))
        both.append([sorted(map(repr, x.collect())) for x in (ids, back)])
    assert both[0] == both[1] and len(both[0][0]) == sum(bool(r[2]) for r in rows)
    assert "collect_list" not in plan(back) and "posexplode" not in plan(back)
    none = tk.encode_ids(tok.where("false"), vocab, 0)
    assert none.collect() == [] and none.dtypes[-1] == ("token_ids", "array<bigint>")
