"""Inputs that several plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.operators import tokenized as tk
from glyphmeter.plans.registry import documents, spread

STAT_NAMES = ("mean", "median", "std", "std_err", "min", "max", "count", "sum")
GROUPS = {"family": {"germanic": ["en", "de"], "romance": ["fr", "es"]}, "size": {"large": ["en"], "medium": ["fr", "de", "es"]}}


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, own.get(c, digits)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def stats_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, sum=4)


def tokens(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tk.STANDARD) -> DataFrame:
    return tk.tokenize(spread(documents(spark, sf_dir)), names)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.text_stats_of(spread(documents(spark, sf_dir)))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.token_counts_of(spread(documents(spark, sf_dir)))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each token over all languages, in one aggregate of the tokens."""
    return tk.token_counts_of(spread(documents(spark, sf_dir)), by=("tokenizer",))


def digest(tokens: Column) -> Column:
    """One string for a list, in the same form in SQL."""
    return F.md5(F.array_join(tokens, "␟"))
