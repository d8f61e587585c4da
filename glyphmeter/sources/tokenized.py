"""Stores of tokenized tables and vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.sources import files

SCHEMA = "tokenizer_name string, language string, tokens array<int>, text string, metadata map<string,string>"


def _table(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("tokenizer_name").alias("tokenizer"), F.col("language").alias("lang"), "tokens", "text", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """tokenizer, lang, tokens, text, metadata from a JSON list of records, or from JSON lines of them."""
    return _table(spark.read.schema(SCHEMA).json(path, multiLine=path.endswith(".json") and files.is_file(spark, path)))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The same from one object of tokenizer -> list of records; the key is the tokenizer's name."""
    if not path.endswith(".json"):
        raise ValueError("keyed records are JSON")
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,array<struct<{SCHEMA.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>>>").alias("m"))
    each = raw.select(F.explode("m").alias("name", "records")).select("name", F.explode("records").alias("r")).select("name", "r.*")
    return _table(each.withColumn("tokenizer_name", F.col("name")).drop("name"))


def write_records(tokenized: DataFrame, path: str) -> None:
    """JSON lines of records."""
    meta = F.col("metadata") if "metadata" in tokenized.columns else F.create_map().cast("map<string,string>")
    tokenized.select(F.col("tokenizer").alias("tokenizer_name"), F.col("lang").alias("language"), "tokens", "text", meta.alias("metadata")).write.mode("overwrite").json(path)


def write_store(tokenized: DataFrame, vocab: DataFrame | None, path: str) -> None:
    """Parquet by tokenizer, one vocabulary file per tokenizer in the order of ids, and a manifest.

    Without a vocabulary, ids stand for tokens as <token_i>.  The data are never pickled.
    """
    tokenized.write.mode("overwrite").partitionBy("tokenizer").parquet(f"{path}/tokens")
    if vocab is None:
        top = tokenized.groupBy("tokenizer").agg(F.max(F.array_max("tokens")).alias("top"))
        vocab = top.select("tokenizer", F.explode(F.sequence(F.lit(0), "top")).alias("token_id")).withColumn("token", F.concat(F.lit("<token_"), F.col("token_id").cast("string"), F.lit(">")))
    vocab.select("tokenizer", "token_id", "token").repartitionByRange("tokenizer", "token_id").sortWithinPartitions("token_id").write.mode("overwrite").partitionBy("tokenizer").parquet(f"{path}/vocabulary")
    names = sorted(r[0] for r in vocab.select("tokenizer").distinct().collect())
    manifest = {"tokens": "tokens", "vocabulary": "vocabulary", "tokenizers": names}
    files.write_text(tokenized.sparkSession, f"{path}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tokenized table and the vocabulary of a store; places are relative to the manifest."""
    manifest = json.loads(files.read_text(spark, f"{path}/manifest.json"))
    return spark.read.parquet(f"{path}/{manifest['tokens']}"), spark.read.parquet(f"{path}/{manifest['vocabulary']}")


def read_vocabulary(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """tokenizer, token_id, token from a file of one token per line; blank lines don't count."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("tokens"))
    return lines.select(F.lit(tokenizer).alias("tokenizer"), F.posexplode("tokens").alias("token_id", "token"))


def vocabulary_sizes(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("tokenizer").agg(F.count("*").alias("vocab_size"))
