"""Toxicity by class-conditional Kneser-Ney models.

Two models over runs of ORDER bytes, one of toxic and one of ordinary labelled documents, share their backoff
counts (see kneser_ney).  A document's score is its toxic minus its ordinary log-likelihood, divided by its
length.  The threshold comes from all labelled documents, each scored by models that its half hasn't trained.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glyphmeter.llm import kneser_ney as kn
from glyphmeter.llm import text as tx
from glyphmeter.llm.shared import checkpoint, folder, read_table, small

ORDER = 5
#: Scores are binned this finely to find the threshold; beyond LIMIT they share the last bin.
BIN = 0.0005
LIMIT = 2.0
#: Known runs up to which every worker holds the models (about 40 bytes a run and model).
LOCAL_RUNS = 1 << 22
MODELS = ("m0", "m1", "all")
_COUNTS = [f"n{half}{cls}" for half in (0, 1) for cls in ("t", "p")]


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row per id; toxic if any of its rows says so.  Null ids and null labels say nothing."""
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg((F.max("toxic") > 0).alias("is_toxic"))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels_of(labels)
    half = F.pmod(F.xxhash64("label_id"), F.lit(2)).cast("int").alias("half")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    return narrow.join(small(known, labels.count(), 16), F.col("doc_id") == F.col("label_id")).select("text", "is_toxic", half)


def counts(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """key (a packed run) and how often each half and class of the labelled documents has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = 2 * batch.column("half").to_numpy() + (~batch.column("is_toxic").to_numpy(zero_copy_only=False)).astype(np.int64)
            seen: list[list[tuple]] = [[] for _ in _COUNTS]
            for at, part in tx.slices(batch.column("text")):
                first, key = kn.keys(part, order)
                of = np.repeat(kind[at : at + len(part)], np.diff(first))
                for c in range(4):
                    seen[c].append(np.unique(key[of == c], return_counts=True))
            key = np.concatenate([np.zeros(0, np.uint64), *(k for s in seen for k, _ in s)])
            n = np.zeros((4, len(key)), np.int64)
            at = 0
            for c in range(4):
                for k, m in seen[c]:
                    n[c, at : at + len(k)] = m
                    at += len(k)
            key, *n = kn.tally(key, *n)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(x) for x in n)], ["key", *_COUNTS])

    partial = _labelled(docs, labels).mapInArrow(run, "key bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return partial.groupBy("key").agg(*(F.sum(c).alias(c) for c in _COUNTS))


@dataclass(frozen=True)
class Fitted:
    """The folder with the tables of all models, and how many runs they know."""

    uri: str
    runs: int
    order: int


def fitted(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> Fitted:
    """Models of half 0, of half 1 and of both, from all labelled documents."""
    spark = docs.sparkSession
    uri = folder(spark, "toxicity")
    counted = checkpoint(counts(docs, labels, order))
    runs, *sums = counted.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in _COUNTS)).first()
    # without both classes nothing tells them apart: such a model knows nothing
    t, p = [(sums[0], sums[2], sums[0] + sums[2]), (sums[1], sums[3], sums[1] + sums[3])]
    n = {f"{m}_{side}": x if t[k] and p[k] else F.lit(0) for side in "tp" for k, (m, x) in enumerate(zip(MODELS, (F.col(f"n0{side}"), F.col(f"n1{side}"), F.col(f"n0{side}") + F.col(f"n1{side}"))))}
    wide = counted.select(F.col("key").alias("gram"), *(x.cast("bigint").alias(name) for name, x in n.items()))
    for name, table in zip(("grams", "contexts"), kn.fit(wide, MODELS, order)):
        table.write.parquet(f"{uri}/{name}")
    return Fitted(uri, runs, order)


@lru_cache(3)
def load_model(uri: str, name: str, order: int) -> kn.Model:
    """Read once per Python worker."""
    return kn.Model.of(order, name, *(read_table(f"{uri}/{x}", columns=["gram", name]) for x in ("grams", "contexts")))


def _ratios(model: kn.Model, column: pa.Array) -> np.ndarray:
    out = [np.zeros(0)]
    for _, part in tx.slices(column):
        total, n = model.ratios(part)
        out.append(total / np.maximum(n, 1))
    return np.concatenate(out)


def scored(rows: DataFrame, models: Fitted, keep: Sequence[str], local_runs: int = LOCAL_RUNS) -> DataFrame:
    """The columns `keep` of rows, and the score of each row's text by the model that its column `model` names.

    Up to local_runs known runs, the models are held by every worker: their size is known from the fit.  Beyond, they
    stay where they are and each text's distinct runs are joined with them; the scores are the same.
    """
    if models.runs <= local_runs:
        names = [rows.schema[c] for c in keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value, which = np.zeros(batch.num_rows), batch.column("model").to_numpy(zero_copy_only=False)
                for name in np.unique(which).tolist():
                    own = which == name
                    value[own] = _ratios(load_model(models.uri, name, models.order), batch.column("text").filter(pa.array(own)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(value)], [*keep, "score"])

        return rows.select(*keep, "model", "text").mapInArrow(run, StructType([*names, StructField("score", DoubleType())]))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in tx.slices(batch.column("text")):
                first, key = kn.keys(part, models.order)
                row = np.repeat(np.arange(len(part)), np.diff(first))
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.zeros(0, np.int64)
                of = pa.array(at + row[heads])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("h1", "h2", "model")), pa.array(key[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(key))))], ["h1", "h2", "model", "gram", "n"])

    spark, named = rows.sparkSession, ("h1", "h2", "model")
    marked = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64("text", F.lit(1))})
    each = marked.select(*named, "text").where("text is not null").mapInArrow(grams, "h1 bigint, h2 bigint, model string, gram bigint, n bigint")

    def long(name: str, value: str) -> DataFrame:
        table = spark.read.parquet(f"{models.uri}/{name}")
        pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias(value)) for m in MODELS))).alias("x")
        return table.select(F.col("gram").alias(name), pairs).select(name, F.col("x.model").alias("model"), f"x.{value}").where(f"{value} is not null")

    known = each.withColumn("grams", F.col("gram")).join(long("grams", "log"), ["grams", "model"], "left")
    known = known.withColumn("contexts", F.shiftright("gram", 8)).join(long("contexts", "back"), ["contexts", "model"], "left")
    value = F.coalesce(F.col("log").cast("double"), F.col("back").cast("double"), F.lit(0.0))
    # equal texts have their runs several times, which changes no mean
    means = known.groupBy(*named).agg((F.sum(F.col("n") * value) / F.sum("n")).alias("score"))
    return marked.join(means, list(named), "left").select(*keep, F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold(docs: DataFrame, labels: DataFrame, models: Fitted, local_runs: int = LOCAL_RUNS) -> float:
    """The score from which calling a document toxic agrees best (in F1) with all labels; inf without toxic ones.

    Each labelled document is scored by the model of the other half.  The threshold lies midway between the bins of the
    lowest score that is called toxic and of the highest that isn't; of thresholds that agree equally well, the highest.
    """
    rows = _labelled(docs, labels).select("text", "is_toxic", F.when(F.col("half") == 0, MODELS[1]).otherwise(MODELS[0]).alias("model"))
    at = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "score")) / F.lit(BIN)).alias("bin")
    binned = scored(rows, models, ["is_toxic"], local_runs).select(at, "is_toxic")
    found = binned.groupBy("bin").agg(F.sum(F.col("is_toxic").cast("bigint")).alias("t"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect()  # as many rows as bins at most
    toxic = sum(r["t"] for r in found)
    best, cut, hit, called = 0.0, float("inf"), 0, 0
    for r, after in zip(found, [*found[1:], None]):
        hit, called = hit + r["t"], called + r["n"]
        if toxic and (f1 := 2 * hit / (called + toxic)) > best:
            best, cut = f1, (r["bin"] + (after["bin"] + 1 if after else r["bin"])) / 2 * BIN
    return cut


def score(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, score, threshold, toxic of each row of docs.

    Whole texts are scored.  Null, empty and wordless texts score 0 and aren't toxic; without labels of both
    classes nothing is; a score equal to the threshold is toxic; an empty table gives no rows.  Repeated rows stay repeated; ids that repeat share their label.  Columns other than
    doc_id, text and the labels' toxic play no part.
    """
    models = fitted(docs, labels, order)
    cut = F.lit(threshold(docs, labels, models)).cast("double")
    rows = scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(MODELS[2]).alias("model")), models, ["doc_id"])
    return rows.select("doc_id", "score", cut.alias("threshold"), ((F.col("score") >= cut) & (F.col("score") != 0)).alias("toxic"))
