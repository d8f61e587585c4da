"""Validation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.operators import tokenized as tk
from glyphmeter.operators import validation as va
from glyphmeter.plans import sql
from glyphmeter.plans.common import rounded, stats, tokens
from glyphmeter.plans.registry import documents, query


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte tokens with their own values as ids; every 97th document's are shifted out of the vocabulary."""
    tok = tk.tokenize(documents(spark, sf_dir), ("bytes",))
    shift = F.when(F.col("doc_id") % 97 == 0, 100).when(F.col("doc_id") % 89 == 0, -70).otherwise(0)
    return tok.withColumn("token_ids", F.transform("tokens", lambda x: F.conv(x, 16, 10).cast("int") + shift))


_IDS = f"""WITH tok AS ({sql.tokens(("bytes",))}), e AS (SELECT tokenizer, lang, doc_id, text,
 list_transform(tokens, lambda x: ('0x' || x)::INT + CASE WHEN doc_id % 97 = 0 THEN 100 WHEN doc_id % 89 = 0 THEN -70 ELSE 0 END) AS ids FROM tok)"""


@query(
    f"""{_IDS} SELECT tokenizer, count(*) AS entries, sum(len(ids))::BIGINT AS tokens, count(DISTINCT lang) AS languages, min(list_min(ids))::BIGINT AS min_id, max(list_max(ids))::BIGINT AS max_id,
 sum(len(list_filter(ids, lambda x: x < 0)))::BIGINT AS negative_ids, sum(CASE WHEN len(ids) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty_entries FROM e GROUP BY tokenizer"""
)
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.summary(_bytes(spark, sf_dir))


@query(
    f"""{_IDS}, m AS (SELECT tokenizer, doc_id, 'error' AS severity, 'negative ids: ' || array_to_string((list_filter(ids, lambda x: x < 0))[1:5], ',') AS message FROM e WHERE len(list_filter(ids, lambda x: x < 0)) > 0
 UNION ALL SELECT tokenizer, doc_id, 'error', 'ids beyond the vocabulary: ' || array_to_string((list_filter(ids, lambda x: x >= 256))[1:5], ',') FROM e WHERE len(list_filter(ids, lambda x: x >= 256)) > 0
 UNION ALL SELECT tokenizer, doc_id, 'warning', 'more tokens than characters' FROM e WHERE len(ids) > length(text)) SELECT * FROM m"""
)
def validate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for every entry of which something is wrong."""
    size = spark.createDataFrame([("bytes", 256)], "tokenizer string, vocab_size bigint")
    return va.entries(_bytes(spark, sf_dir), size)


@query("WITH want AS (SELECT unnest(['en', 'de', 'it', 'nl']) AS lang), have AS (SELECT DISTINCT lang FROM documents) SELECT 'missing' AS status, lang FROM want WHERE lang NOT IN (SELECT lang FROM have) UNION ALL SELECT 'extra', lang FROM have WHERE lang NOT IN (SELECT lang FROM want)")
def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared languages without texts, and languages that nobody declared."""
    want = spark.createDataFrame([("en",), ("de",), ("it",), ("nl",)], "lang string")
    return va.set_differences(documents(spark, sf_dir), want, "lang")


@query(f"WITH {sql.STATS}, l AS (SELECT unnest(['en', 'de', 'it', 'nl', 'pl']) AS lang) SELECT tokenizer, count(DISTINCT s.lang) AS covered, 5::BIGINT AS expected, round(count(DISTINCT s.lang)::DOUBLE / 5, 6) AS ratio, count(DISTINCT s.lang)::DOUBLE / 5 < 0.5 AS warning FROM stats s JOIN l ON l.lang = s.lang GROUP BY tokenizer")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = spark.createDataFrame([(x,) for x in ("en", "de", "it", "nl", "pl")], "lang string")
    return rounded(va.coverage(stats(spark, sf_dir), languages))


@query("SELECT true AS same_tokenizer, bool_and(lang IN ('en', 'fr', 'de')) AS known_languages, true AS has_tokens FROM documents")
def provider_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.consistent(tokens(spark, sf_dir, ("whitespace",)), "whitespace", ["en", "fr", "de"])


@query(f"WITH tok AS ({sql.tokens(('whitespace',))}) SELECT 'given' AS tokenizer, lang, count(*) AS texts FROM tok GROUP BY lang")
def corrected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the name of their specification."""
    return va.renamed(tokens(spark, sf_dir, ("whitespace",)), "given").groupBy("tokenizer", "lang").agg(F.count("*").alias("texts"))
