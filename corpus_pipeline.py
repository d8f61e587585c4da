"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, PII, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs.  All but the last keep docs' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.llm import bpe, decontamination, language, pii, simhash
from glyphmeter.llm.shared import folder, table
from glyphmeter.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose language can't be told; lang becomes the language that was found.

    The machines train on docs' own lang labels.  Null, empty and wordless texts are rejected; of repeated rows all stay
    or none; an empty table stays empty.
    """
    ship(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the least doc_id (nulls last).

    Null, empty and wordless texts all stay; of repeated rows one does.
    """
    ship(spark)
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold a passage of the benchmark.  Null and empty texts stay; without a benchmark all do."""
    ship(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with pseudonyms in their texts; n_chars, if there is one, counts the new text (null for a null one)."""
    ship(spark)
    changed = pii.pseudonymise(docs, count=None)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens, n_bytes, round_trip of each text: all null for a null text, no tokens for an empty one."""
    ship(spark)
    return bpe.encode(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("encode", encode),
]

#: Trained machines and fingerprints of floating-point votes are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
