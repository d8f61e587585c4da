"""Morpheme lexicons: lang, dataset, priority, word, morphemes.  The order of datasets is their priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.operators.morphology import infer_morphemes

COLUMNS = ("lang", "dataset", "priority", "word", "morphemes")


def read_hyphenated(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Lines of word, tab, morphemes with hyphens; lines that begin with # are comments."""
    parts = spark.read.text(path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("p")).where("size(p) >= 2")
    return parts.select(F.lit(lang).alias("lang"), F.lower(F.trim(F.element_at("p", 1))).alias("word"), F.split(F.trim(F.element_at("p", 2)), "-").alias("morphemes"))


def read_segmented_csv(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """A CSV with Word or word, and MorphoLexSegm or morphemes, split at . - and +; rows without either are dropped."""
    df = spark.read.csv(path, header=True)
    word = next((c for c in ("Word", "word") if c in df.columns), None)
    segments = next((c for c in ("MorphoLexSegm", "morphemes") if c in df.columns), None)
    if word is None or segments is None:
        raise ValueError(f"no word and morphemes among {df.columns}")
    parts = F.filter(F.transform(F.split(F.col(segments), r"[.\-+]"), lambda x: F.trim(x)), lambda x: x != "")
    rows = df.where(F.col(word).isNotNull() & F.col(segments).isNotNull())
    return rows.select(F.lit(lang).alias("lang"), F.lower(F.trim(F.col(word))).alias("word"), parts.alias("morphemes")).where("size(morphemes) > 0")


def read_derivations(spark: SparkSession, path: str) -> DataFrame:
    """Lines of lang, tab, word, tab, base→derived:kind; morphemes are inferred from the derivation."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p")).where("size(p) >= 3")
    body = F.regexp_replace(F.element_at("p", 3), r":[^:]*\z", "")
    pair = F.split(body, "→", 2)
    rows = p.select(F.trim(F.element_at("p", 1)).alias("lang"), F.lower(F.trim(F.element_at("p", 2))).alias("word"), pair.alias("pair")).where("size(pair) = 2")
    return rows.select("lang", "word", infer_morphemes(F.trim(F.col("pair")[0]), F.trim(F.col("pair")[1]), F.lit(None)).alias("morphemes"))


def read_json(spark: SparkSession, path: str, lang: str = "de") -> DataFrame:
    """A JSON list of word, morphemes and, if it isn't the usual one, language."""
    df = spark.read.schema("word string, morphemes array<string>, language string").json(path, multiLine=True)
    return df.where("word is not null and morphemes is not null").select(F.coalesce("language", F.lit(lang)).alias("lang"), F.lower("word").alias("word"), "morphemes")


READERS = {"hyphenated": read_hyphenated, "segmented": read_segmented_csv, "derivations": read_derivations, "json": read_json}


def read_all(spark: SparkSession, datasets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """All of (name, kind, path), the first before the second."""
    out = spark.createDataFrame([], "lang string, dataset string, priority int, word string, morphemes array<string>")
    for k, (name, kind, path) in enumerate(datasets):
        if kind not in READERS:
            raise ValueError(f"unknown kind {kind!r}")
        out = out.unionByName(READERS[kind](spark, path).select("lang", F.lit(name).alias("dataset"), F.lit(k).alias("priority"), "word", "morphemes"))
    return out
