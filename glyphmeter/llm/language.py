"""Hierarchical language identification.

A text is first given a language family (one linear support vector machine per family against the rest), then
a language of that family by one-versus-one machines between its members.  Features are the relative
frequencies of hashed runs of 2, 3 and 4 bytes of the lower-cased words of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmeter.llm import text as tx
from glyphmeter.llm.shared import folder, read_table, replaced, small

#: Labelled rows per language from which the machines are trained: a bound on the fit, not on what is classified.
TRAIN_ROWS = 400
#: log2 of the features of each run length, and the run lengths.
FEATURE_BITS = 12
RUNS = (2, 3, 4)
#: A text is rejected if the best family's decision value is below this (no family claims it) or if less than
#: this share of its pairs of bytes is familiar from training texts (it is in no script or language that was seen).
REJECT_BELOW = -0.5
REJECT_FAMILIAR = 0.5
FAMILIAR_IN = 500
COST = 10.0
EPOCHS = 40
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it lad oc pt rm ro sc wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa si ur",
    "semitic": "am ar he mt ti",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    """The family of a language code; one that isn't listed is a family of its own."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row bounds and, for each byte of the words, the features of the runs that start there (one column a length)."""
    at, raw = tx.flat(column)
    long = raw.astype(np.uint32)
    packed, out = long.copy(), []
    for n in range(2, max(RUNS) + 1):
        after = np.zeros(len(long), np.uint32)
        after[: max(0, len(long) - n + 1)] = long[n - 1 :]
        for k in range(1, n):  # behind a text there is nothing, whatever text comes next
            tail = at[1:] - k
            after[tail[tail >= at[:-1]]] = 0
        packed = (packed << np.uint32(8)) | after
        if n in RUNS:
            slot = (packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)
            out.append((slot + np.uint32(RUNS.index(n) << FEATURE_BITS)).astype(np.int32))
    return at, np.stack(out, axis=1) if out else np.zeros((0, len(RUNS)), np.int32)


def frequencies(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text: its features, ascending, and their relative frequencies."""
    slots, values = [], []
    for _, part in tx.slices(column):
        at, f = features(part)
        for i in range(len(part)):
            own = f[at[i] : at[i + 1]].ravel()
            slot, n = np.unique(own, return_counts=True)
            slots.append(slot.astype(np.uint16))
            values.append((n / max(1, len(own) // len(RUNS))).astype(np.float32))
    return slots, values


@dataclass
class Scaling:
    """Of all training texts: the features' mean frequencies, their scales, and the mean length of a scaled text."""

    mean: np.ndarray
    scale: np.ndarray
    norm: float

    @classmethod
    def of(cls, n: int, total: np.ndarray, squares: np.ndarray) -> Scaling:
        mean = total / max(1, n)
        scale = 1 / np.sqrt(mean + 1e-5)
        return cls(mean, scale, float(np.sqrt(max(0.0, (scale * scale * (squares / max(1, n) - mean * mean)).sum())) or 1))


def svm(slots: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, scaling: Scaling, cost: float = COST, epochs: int = EPOCHS, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights over frequencies and the bias of a linear machine: dual coordinate descent for the hinge loss.

    Texts stay sparse.  With m the scaled means, a scaled text is its scaled frequencies s less m, and the weights are
    u - g * m, u being a sum of scaled frequencies: a step reads and writes one text's features, and a constant 1
    stands for the bias.
    """
    if len(set(y.tolist())) < 2:
        return np.zeros(len(scaling.mean)), float(y[0]) if len(y) else 0.0
    by = scaling.scale / scaling.norm
    m = scaling.mean * by
    mm = float(m @ m)
    sparse = [v * by[s] for s, v in zip(slots, values)]
    ms = np.array([float(m[s] @ v) for s, v in zip(slots, sparse)])
    size = np.array([float(v @ v) for v in sparse]) - 2 * ms + mm + 1
    rng, alpha = np.random.default_rng(1), np.zeros(len(y))
    u, um, g, bias = np.zeros(len(m)), 0.0, 0.0, 0.0
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            score = float(u[slots[i]] @ sparse[i]) - um - g * (ms[i] - mm) + bias
            new = min(max(alpha[i] + (1 - y[i] * score) / size[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                u[slots[i]] += step * sparse[i]
                um, g, bias = um + step * ms[i], g + step, bias + step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < tolerance * cost:
            break
    w = (u - g * m) * by
    return w, bias - float(w @ scaling.mean)


@dataclass
class Model:
    """Machines as columns of weights over the features, with their biases; the last column marks familiar pairs of bytes."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(RUNS) << FEATURE_BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decide(self, column: pa.Array) -> np.ndarray:
        """Decision values, one row per text; nan where a text has no words."""
        out = np.full((len(column), self.weights.shape[1]), np.nan)
        for first, part in tx.slices(column, 1 << 19):
            at, f = features(part)
            some = np.flatnonzero(np.diff(at) > 1)
            if not len(some):
                continue
            value = self.weights[f[:, 0]]
            for k in range(1, f.shape[1]):
                value += self.weights[f[:, k]]
            total = np.add.reduceat(value, at[:-1], axis=0)[some]
            out[first + some] = total / np.diff(at)[some, None] + self.bias
        return out

    def predict(self, column: pa.Array) -> tuple[list[str | None], list[str | None], np.ndarray, np.ndarray]:
        """Family, language, the family's decision value and whether the text is rejected."""
        value = self.decide(column)
        n, k = len(column), len(self.families)
        if not k or not n:
            return [None] * n, [None] * n, np.full(n, np.nan), np.ones(n, np.bool_)
        known = ~np.isnan(value[:, 0])
        scores = np.where(known[:, None], value[:, :k], -np.inf)
        best = scores.argmax(axis=1)
        margin = np.where(known, scores[np.arange(n), best], np.nan)
        language = np.full(n, None, object)
        column_at = k
        for f, members in enumerate(self.members):
            pairs = list(combinations(range(len(members)), 2))
            own = np.flatnonzero(known & (best == f))
            votes = np.zeros((len(own), len(members)))
            for p, (a, b) in enumerate(pairs):
                d = value[own, column_at + p]
                # a vote for the winner; the bounded decision values break ties
                votes[:, a] += (d > 0) + np.tanh(d) * 1e-3
                votes[:, b] += (d <= 0) - np.tanh(d) * 1e-3
            if len(own):
                language[own] = np.array(members, object)[votes.argmax(axis=1)]
            column_at += len(pairs)
        families = [self.families[b] if k_ else None for b, k_ in zip(best, known)]
        rejected = ~known | (np.nan_to_num(margin, nan=-np.inf) < REJECT_BELOW) | (np.nan_to_num(value[:, -1]) < REJECT_FAMILIAR)
        return families, language.tolist(), margin, rejected


def machines(names: list[str]) -> tuple[list[str], list[list[str]], list[tuple[list[str], list[str]]]]:
    """Families, their languages, and of each machine the languages on its positive and on its negative side."""
    families = sorted({family(x) for x in names})
    members = [[x for x in names if family(x) == f] for f in families]
    sides = [(own, [x for x in names if x not in own]) for own in members]
    return families, members, sides + [([a], [b]) for group in members for a, b in combinations(group, 2)]


def familiar(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which pairs of bytes are familiar, from the texts of each language that have each feature and all its texts.

    In more than one text and in more than one of FAMILIAR_IN, of all texts or of one language's own, however few
    these are: a stray mislabelled text makes nothing familiar.
    """
    seen, rows = np.vstack([seen.sum(axis=0, keepdims=True), seen]), np.append(rows.sum(), rows)
    return np.any(seen > np.maximum(1, rows // FAMILIAR_IN)[:, None], axis=0) & (np.arange(seen.shape[1]) < 1 << FEATURE_BITS)


def assemble(names: list[str], seen: np.ndarray, rows: np.ndarray, solved: list[tuple[np.ndarray, float]]) -> Model:
    families, members, _ = machines(names)
    weights = np.stack([*(w for w, _ in solved), familiar(seen, rows)], axis=1)
    return Model(families, members, weights.astype(np.float32), np.array([*(b for _, b in solved), 0.0]))


def _sums(slots: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: each feature's total frequency, total square and number of texts that have it."""
    size = len(RUNS) << FEATURE_BITS
    slot = np.concatenate([np.zeros(0, np.uint16), *slots]).astype(np.int64)
    value = np.concatenate([np.zeros(0, np.float32), *values]).astype(np.float64)
    return np.bincount(slot, value, size), np.bincount(slot, value * value, size), np.bincount(slot, minlength=size)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Machines for the families and, within each, for every pair of its languages, from texts at hand."""
    names = sorted(set(langs))
    if not names:
        return Model()
    lang = np.array(langs)
    slots, values = frequencies(pa.array(texts, pa.string()))
    parts = [_sums([slots[i] for i in own], [values[i] for i in own]) for own in (np.flatnonzero(lang == n).tolist() for n in names)]
    scaling = Scaling.of(len(texts), sum(p[0] for p in parts), sum(p[1] for p in parts))
    solved = []
    for plus, minus in machines(names)[2]:
        rows = [i for n in plus + minus for i in np.flatnonzero(lang == n).tolist()]
        solved.append(svm([slots[i] for i in rows], [values[i] for i in rows], np.where(np.isin(lang[rows], plus), 1.0, -1.0), scaling))
    return assemble(names, np.stack([p[2] for p in parts]), np.array([(lang == n).sum() for n in names]), solved)


def sample(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, h, text of at most `rows` texts of each language, those with the least hash of doc_id."""
    h = F.xxhash64("doc_id").alias("h")
    known = labelled.where("doc_id is not null and lang is not null and lang <> '' and text is not null")
    # most rows are out by their hash alone, so no more than the rows of a few times `rows` ids of a language are ranked
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size"))  # rows of one id stay or go together
    share = F.least(F.lit(1.0), F.lit(4.0 * rows) / F.col("size"))
    likely = known.select("lang", h, "text").join(small(sizes, sizes.count()), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return likely.withColumn("k", rank).where(F.col("k") <= rows).select("lang", "h", "text")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most `rows` texts of each language (see sample).

    Rows with a null doc_id, lang or text, or an empty lang, don't train; an empty table gives a model that rejects
    every text.  Texts become features where they are read; the driver sees sums by language and finished machines,
    each of which a task of its own fits from the features of its languages.
    """
    spark = labelled.sparkSession
    at = f"{folder(spark, 'language')}/features"

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = frequencies(batch.column("text"))
            data = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (slots, values)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), *data], ["lang", "h", "slots", "values"])

    sample(labelled, rows).mapInArrow(featured, "lang string, h bigint, slots binary, values binary").write.parquet(at)
    features_ = spark.read.schema("lang string, h bigint, slots binary, values binary").parquet(at)

    def summed(group: pa.Table) -> pa.Table:
        sums = _sums(*_unpacked(group))
        data = [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in sums]
        return pa.table([group.column("lang").slice(0, 1), pa.array([group.num_rows], pa.int64()), *data], ["lang", "n", "total", "squares", "seen"])

    found = sorted(features_.groupBy("lang").applyInArrow(summed, "lang string, n bigint, total binary, squares binary, seen binary").collect())
    if not found:
        return Model()
    names, counts = [r["lang"] for r in found], np.array([r["n"] for r in found])
    total, squares, seen = (np.stack([np.frombuffer(r[c]) for r in found]) for c in ("total", "squares", "seen"))
    scaling = Scaling.of(int(counts.sum()), total.sum(axis=0), squares.sum(axis=0))
    sides = machines(names)[2]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("machine").to_pylist():
                plus, minus = sides[k]
                table = read_table(at, "lang", plus + minus).sort_by([("lang", "ascending"), ("h", "ascending"), ("slots", "ascending")])
                slots, values = _unpacked(table)
                w, bias = svm(slots, values, np.where(np.isin(table.column("lang").to_numpy(zero_copy_only=False), plus), 1.0, -1.0), scaling)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["machine", "weights", "bias"])

    work = spark.range(0, len(sides), 1, len(sides)).withColumnRenamed("id", "machine")
    solved = sorted(work.mapInArrow(solve, "machine bigint, weights binary, bias double").collect())
    return assemble(names, seen, counts, [(np.frombuffer(r["weights"], np.float32), r["bias"]) for r in solved])


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return tuple([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("slots", np.uint16), ("values", np.float32)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, family, language, margin, rejected of each row.

    Rejected: no words (null, empty or wordless text; family and language are null), or no family's decision
    value reaches REJECT_BELOW, or too few pairs of its bytes are familiar.  Without a trained model every row is
    rejected.  Of languages with equally many votes the one with the greater sum of bounded decision values is taken,
    of equal sums the first by code.  Texts are read whole.  Repeated rows stay repeated; an empty table gives no rows;
    columns other than doc_id and text play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families, languages, margin, rejected = model.predict(batch.column("text"))
            columns = [
                batch.column("doc_id"),
                pa.array(families, pa.string()),
                pa.array(languages, pa.string()),
                pa.array(margin, pa.float64(), mask=np.isnan(margin)),
                pa.array(rejected, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "family", "language", "margin", "rejected"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, family string, language string, margin double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rejected rows, each with the language that was found in its lang column, if there is one.

    So a wrong or missing label is corrected.  Null, empty and wordless texts are rejected; without a trained model
    every row is; repeated rows stay or go together; an empty table stays empty; other columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, languages, _, rejected = model.predict(batch.column("text"))
            if "lang" in batch.schema.names:
                batch = replaced(batch, "lang", pa.array(languages, pa.string()))
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
