import random

import pyarrow as pa

import corpus_pipeline as cp
from glyphmeter.llm import bpe, decontamination, language, pii, simhash
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_simhash import brute as groups

LANGS = {"en": "the of and walking stone river", "de": "der und die Straße geht Fluß", "fr": "le et la rivière étoile qui", "es": "el y la río piedra señor"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def corpus(sf_dir, spark):
    rng = random.Random(6)
    item = " ".join(f"bench{k}" for k in range(25))
    rows = []
    for i in range(160):
        lang = rng.choice(list(LANGS))
        text = " ".join(rng.choice(LANGS[lang].split()) + (f"{rng.randrange(300)}x" if rng.random() < 0.3 else "") for _ in range(rng.randrange(20, 120)))
        text += {0: " card 4111 1111 1111 1111", 1: " born 1990-02-01", 2: f" {item}"}.get(i % 11, "")
        rows.append([i, text, lang])
    for k in range(30):
        rows.append([200 + k, rows[k * 3][1] + rng.choice(["", " again"]), rows[k * 3][2]])
    rows += [[300, None, "en"], [301, "", "en"], [302, "漢字かな交じり文", "en"], [0, rows[0][1], rows[0][2]], [None, "the river of stone and walking", "en"]]
    full = [(*r, "src", len(r[1] or ""), "e") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return rows, [(1, item)]


def test_against_brute_force(spark, tmp_path):
    sf_dir = str(tmp_path)
    rows, bench = corpus(sf_dir, spark)
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rejected = model.predict(pa.array([r[1] for r in rows], pa.string()))[3]
    left = [(r[0], r[1]) for r, no in zip(rows, rejected) if not no]
    assert {r[0] for r, no in zip(rows, rejected) if no} >= {300, 301, 302}
    order = lambda k: (left[k][0] is None, left[k][0] or 0, left[k][1])
    gone = {k for g in groups(left) for k in sorted(g, key=order)[1:]}
    assert len(gone) >= 20
    left = [r for k, r in enumerate(left) if k not in gone]
    bad = {d for d, *_ in contaminated(left, bench, least=decontamination.PASSAGE_WORDS)}
    assert bad
    left = [r for r in left if r[0] not in bad]
    codec, p = bpe.codec(), pii.Pseudonyms(pii.KEY)
    want = sorted(((i, codec.split.encode_ordinary(pii.replace(t, p)[0])) for i, t in left), key=repr)
    got = sorted(((r["doc_id"], r["tokens"]) for r in cp.run(spark, sf_dir).collect()), key=repr)
    assert got == want


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    changed = cp.replace_personal_data(spark, docs, str(tmp_path))
    assert changed.where("n_chars <> length(text)").count() == 0


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["language", "near_dedup", "decontamination", "pii", "encode"]
    assert simhash and decontamination
