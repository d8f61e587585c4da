"""One query per operator, with production parameters and over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmeter.llm import bpe, decontamination, language, media, pii, simhash, substring, token_counts, toxicity, warc
from glyphmeter.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded-length histogram of documents with its suffix sums."""
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their personal numbers, dates and addresses pseudonymised."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and decision of each document, from models of all labelled documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True types and carved embedded media of a media column: the tables have none, so it is made of the documents."""
    return media.inspect(media.packed(table(spark, sf_dir, "documents")), carved=True)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents repeat."""
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seekable bundles of all pages."""
    return warc.bundles(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among documents."""
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in documents."""
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language family and language of each document, from machines trained on a bounded sample of its lang labels."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_pii, op3_toxicity, op4_media, op5_substring, op6_warc, op7_simhash, op8_decontamination, op9_bpe, op10_language)}
ORACLES: dict[str, str] = {"op8_decontamination": decontamination.ORACLE}
