import random

import numpy as np
import pyarrow as pa
import pytest

from glyphmeter.llm import language
from tests.llm.data import rows_of

SYLLABLES = {"en": "the ing tion an wh er ou th sh ly", "de": "sch ein ung keit der ch zu äu ge ver", "fr": "eau eux tion qui ou è ment elle ais le", "es": "ción os ra ue ñ dad el mente í la"}
SCHEMA = "doc_id bigint, text string, lang string, family string, margin string, language string"


def make(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def corpus(seed, n):
    rng = random.Random(seed)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [(i, make(rng, x, rng.randrange(5, 80)), x) for i, x in enumerate(langs)]


def dense(texts):
    out = np.zeros((len(texts), len(language.RUNS) << language.FEATURE_BITS))
    for row, slots, values in zip(out, *language.frequencies(pa.array(texts, pa.string()))):
        row[slots] = values
    return out


def gram_machine(x, y, cost=language.COST, epochs=400):
    """The hinge loss's dual by coordinate ascent over a dense Gram matrix with a constant 1 for the bias."""
    gram, alpha = x @ x.T + 1, np.zeros(len(y))
    for _ in range(epochs):
        for i in range(len(y)):
            alpha[i] = min(max(alpha[i] + (1 - y[i] * (gram[i] @ (alpha * y))) / gram[i, i], 0), cost)
    return (alpha * y) @ x, float((alpha * y).sum()), alpha


@pytest.fixture(scope="module")
def model():
    rows = corpus(1, 200)
    return language.fit([r[1] for r in rows], [r[2] for r in rows])


def test_held_out_accuracy(model):
    rows = corpus(2, 400)
    families, langs, margin, rejected = model.predict(pa.array([r[1] for r in rows]))
    assert np.mean([a == r[2] for a, r in zip(langs, rows)]) > 0.98 and not rejected.any()
    assert np.mean([a == language.family(r[2]) for a, r in zip(families, rows)]) > 0.98


def test_machines_are_hierarchical(model):
    assert model.families == ["germanic", "romance"] and model.members == [["de", "en"], ["es", "fr"]]
    families, langs, *_ = model.predict(pa.array([r[1] for r in corpus(3, 50)]))
    assert all(language.family(a) == f for a, f in zip(langs, families))


def test_decision_values_are_the_definition(model):
    text = "The sching eau ción"
    x = dense([text])[0]
    assert np.allclose(model.decide(pa.array([text]))[0], x @ model.weights + model.bias, atol=1e-4)
    others = [text, "x", "", text + " more", None, text]
    assert np.array_equal(model.decide(pa.array(others))[[0, 5]], np.repeat(model.decide(pa.array([text])), 2, axis=0))  # whatever is beside it
    long = " ".join([text] * 30000)  # many slices' worth in one row
    assert np.allclose(model.decide(pa.array([long, text]))[1], model.decide(pa.array([text]))[0])


def test_machines_against_a_dense_solver():
    rows = corpus(4, 60)
    texts, langs = [r[1] for r in rows], np.array([r[2] for r in rows])
    x = dense(texts)
    mean = x.mean(axis=0)
    scale = 1 / np.sqrt(mean + 1e-5)
    z = (x - mean) * scale
    norm = np.sqrt((z * z).sum(axis=1).mean())
    z /= norm
    scaling = language.Scaling.of(len(x), x.sum(axis=0), (x * x).sum(axis=0))
    assert np.allclose(scaling.norm, norm) and np.allclose(scaling.scale, scale)
    for plus, minus in language.machines(sorted(set(langs)))[2]:
        own = np.flatnonzero(np.isin(langs, plus + minus))
        y = np.where(np.isin(langs[own], plus), 1.0, -1.0)
        slots, values = language.frequencies(pa.array([texts[i] for i in own], pa.string()))
        w, bias = language.svm(slots, values, y, scaling, epochs=400, tolerance=1e-7)
        v, b, alpha = gram_machine(z[own], y)
        got, want = x @ w + bias, z @ v + b
        assert np.allclose(got, want, atol=0.02) and (np.sign(got) == np.sign(want))[np.abs(want) > 0.02].all()
        # the primal objective equals the dual one: no other machine is better
        primal = (v @ v + b * b) / 2 + language.COST * np.maximum(0, 1 - y * want[own]).sum()
        assert np.isclose(primal, alpha.sum() - (v @ v + b * b) / 2, rtol=0.02)
        u = w / scale * norm
        mine = (u @ u + (bias + w @ mean) ** 2) / 2 + language.COST * np.maximum(0, 1 - y * got[own]).sum()
        assert np.isclose(mine, primal, rtol=0.02)


def test_votes_and_ties():
    names = ["fr", "es", "it"]
    m = language.Model(["romance"], [names], np.zeros((len(language.RUNS) << language.FEATURE_BITS, 5), np.float32), np.zeros(5))
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=(200, 5)), [[0, 1, -1, 1, 1], [0, 0, 0, 0, 1], [0, 2, -3, 1, 1]]])
    values[:, 4] = 1
    m.decide = lambda column: values
    got = m.predict(pa.array(["x"] * len(values)))[1]
    for row, found in zip(values, got):
        votes = dict.fromkeys(names, 0.0)
        for (a, b), d in zip([(0, 1), (0, 2), (1, 2)], row[1:4]):
            votes[names[a] if d > 0 else names[b]] += 1
            votes[names[a]] += np.tanh(d) * 1e-3
            votes[names[b]] -= np.tanh(d) * 1e-3
        assert found == max(names, key=lambda n: (votes[n], -names.index(n)))


def test_training_in_tasks_is_training_at_hand(spark):
    rows = corpus(7, 120) + [(1000, "an id twice", "en"), (1000, "an id twice", "en"), (None, "x", "en"), (5000, None, "en"), (5001, "x", None), (5002, "", "en")]
    known = table(spark, rows)
    sample = sorted((r["lang"], r["h"], r["text"]) for r in language.sample(known, 20).collect())
    assert {n: sum(s[0] == n for s in sample) for n in SYLLABLES} == dict.fromkeys(SYLLABLES, 20)
    here, there = language.fit([s[2] for s in sample], [s[0] for s in sample]), language.train(known, 20)
    texts = pa.array([r[1] for r in corpus(8, 60)] + [None, ""], pa.string())
    assert (here.families, here.members) == (there.families, there.members)
    assert np.allclose(here.decide(texts), there.decide(texts), atol=0.05, equal_nan=True)
    assert language.train(table(spark, [])).families == []


def test_rejections(model):
    *_, rejected = model.predict(pa.array([None, "", "...", "漢字かな交じり文です漢字", "Привет мир как дела", "the thing"]))
    assert rejected.tolist() == [True] * 5 + [False]


def test_table(spark, model):
    rows = [(1, "the thing", "en"), (1, "the thing", "en"), (2, None, None), (3, "", "en"), (None, "eau qui mentelle", "fr"), (4, "漢字 " * 30000, "ja")]
    got = rows_of(language.identify(table(spark, rows), model), "doc_id", "language", "rejected")
    assert got == sorted([(1, "en", False)] * 2 + [(2, None, True), (3, None, True), (None, "fr", False)] + [(4, r[1], True) for r in got if r[0] == 4], key=repr)
    kept = language.keep_identified(table(spark, rows), model)
    assert kept.columns == table(spark, rows).columns and kept.count() == 3


def test_training(spark):
    rows = corpus(4, 120)
    odd = [(None, "no id", "en"), (500, None, "en"), (501, "no lang", None), (502, "blank", ""), *[(7, f"same id {k}", "en") for k in range(300)]]
    trained = language.train(table(spark, rows + odd), rows=20)
    _, langs, *_ = trained.predict(pa.array([r[1] for r in rows]))
    assert np.mean([a == r[2] for a, r in zip(langs, rows)]) > 0.9
    untrained = language.train(table(spark, []))
    assert language.identify(table(spark, rows), untrained).where("rejected").count() == len(rows)
    assert language.keep_identified(table(spark, rows), untrained).count() == 0
    many = corpus(5, 3000)
    assert np.mean([a == r[2] for a, r in zip(language.train(table(spark, many), rows=20).predict(pa.array([r[1] for r in many]))[1], many)]) > 0.9
    one = language.fit(["the thing", "an other"], ["en", "en"])
    assert one.predict(pa.array(["the other"]))[1] == ["en"]
    assert language.identify(table(spark, []), one).count() == 0


def test_pairs_of_a_rare_language_are_familiar():
    rng = random.Random(6)
    greek = lambda n: " ".join(rng.choice("και το της είναι στην από για που δεν".split()) for _ in range(n))
    rows = [(make(rng, x, 20), x) for x in ("en", "fr") for _ in range(800)] + [(greek(60), "el") for _ in range(3)]
    fitted = language.fit(*map(list, zip(*rows)))
    _, langs, _, rejected = fitted.predict(pa.array([greek(30), make(rng, "en", 30), "漢字かな交じり文です漢字"]))
    assert langs[:2] == ["el", "en"] and rejected.tolist() == [False, False, True]


def test_training_with_few_ids(spark):
    rows = [(k % 3, text, lang) for lang in ("en", "fr") for k, (_, text, _) in enumerate([(0, make(random.Random(k), lang, 20), lang) for k in range(2000)])]
    trained = language.train(table(spark, rows), rows=10)
    assert sorted(x for m in trained.members for x in m) == ["en", "fr"]
    _, langs, _, rejected = trained.predict(pa.array([r[1] for r in rows]))
    assert np.mean([a == r[2] for a, r in zip(langs, rows)]) > 0.9 and not rejected.all()
