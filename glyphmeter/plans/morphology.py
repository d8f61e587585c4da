"""Words, tokens and morphemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.functions import text as t
from glyphmeter.operators import morphology as mo
from glyphmeter.plans import sql
from glyphmeter.plans.common import digest, rounded
from glyphmeter.plans.registry import documents, query, spread

_STRIP = r"regexp_replace(regexp_replace({}, '^[.,!?;:\"()\[\]{{}}]+', ''), '[.,!?;:\"()\[\]{{}}]+$', '')"


def _strip_sql(x: str) -> str:
    return _STRIP.replace("{}", x, 1).replace("{{}}", "{}")


_WORDS = f"words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, {_strip_sql('w')} AS word FROM (SELECT lang, unnest({sql.words('lower(text)')}) AS w FROM documents)) WHERE length(word) >= 2 GROUP BY ALL)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, word, n: the lower-cased words of at least two characters, without punctuation at their ends."""
    # (outer: else Spark tests that there are words, and splits every text once more for that)
    each = spread(documents(spark, sf_dir)).select("lang", F.explode_outer(t.split_words(F.lower("text"))).alias("w"))
    return each.select("lang", t.strip_punctuation(F.col("w")).alias("word")).where(F.length("word") >= mo.LEAST_WORD).groupBy("lang", "word").agg(F.count("*").alias("n"))


def _thirds(word: Column) -> Column:
    """Tokens of three characters, the first with a start mark, the others with a continuation mark."""
    return F.transform(t.trigrams(word), lambda x, i: F.concat(F.when(i == 0, F.lit("Ġ")).otherwise(F.lit("##")), x))


def _morphemes(word: Column) -> Column:
    """A stem of four characters and the rest."""
    return F.filter(F.array(F.substring(word, 1, 4), F.substring(word, 5, 1 << 30)), lambda x: x != "")


def _tokenized_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return words(spark, sf_dir).select(F.lit("thirds").alias("tokenizer"), "lang", "word", "n", _thirds(w).alias("tokens"), _morphemes(w).alias("morphemes"))


_THIRDS = "regexp_extract_all(word, '(?s).{1,3}')"
_SCORED = f"""WITH {_WORDS}, b AS (SELECT lang, word, n, {_THIRDS} AS tokens, list_filter([substr(word, 1, 4), substr(word, 5)], lambda x: x <> '') AS morphemes FROM words),
 c AS (SELECT *, list_transform(range(1, len(tokens)), lambda i: 3 * i) AS found, CASE WHEN length(word) > 4 THEN [4]::BIGINT[] ELSE []::BIGINT[] END AS truth FROM b),
 d AS (SELECT *, len(list_intersect(found, truth))::DOUBLE AS tp, len(list_filter(morphemes, lambda m: list_contains(tokens, m)))::DOUBLE / len(morphemes) AS preservation,
  greatest(len(tokens) - len(morphemes), 0)::DOUBLE / len(morphemes) AS over_segmentation FROM c),
 e AS (SELECT *, CASE WHEN len(found) > 0 THEN tp / len(found) ELSE 0.0 END AS precision, CASE WHEN len(truth) > 0 THEN tp / len(truth) ELSE 0.0 END AS recall FROM d),
 s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM e)"""


@query(f"{_SCORED} SELECT lang, word, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(preservation, 6) AS preservation, round(over_segmentation, 6) AS over_segmentation FROM s")
def morph_boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = mo.full_scores(_tokenized_words(spark, sf_dir))
    return rounded(scored.select("lang", "word", "precision", "recall", "f1", "preservation", "over_segmentation"))


_SUMMARY = " UNION ALL ".join(f"SELECT 'thirds' AS tokenizer, lang, '{m}' AS metric, count(*) AS count, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM s GROUP BY lang" for m in ("precision", "recall", "f1", "preservation", "over_segmentation"))


@query(f"{_SCORED} {_SUMMARY}")
def morph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all scores by the general path, which also takes tokens that don't spell the word."""
    return rounded(mo.summarise(mo.full_scores(_tokenized_words(spark, sf_dir))))


@query(
    f"""{_SCORED}, p AS (SELECT lang, sum(n * precision)::DOUBLE / sum(n) AS p, sum(n * recall)::DOUBLE / sum(n) AS r, sum(n * f1)::DOUBLE / sum(n) AS f, count(*) AS k FROM s WHERE len(tokens) > 1 GROUP BY lang)
 SELECT 'thirds' AS tokenizer, lang, round(r, 6) AS morphscore_recall, round(p, 6) AS morphscore_precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS micro_f1, round(f, 6) AS macro_f1, k AS num_samples FROM p"""
)
def morph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary scores weighted by word frequency, single-token words left out."""
    return rounded(mo.morph_score(mo.full_scores(_tokenized_words(spark, sf_dir)), exclude_single=True, times="n"))


@query(f"WITH {_WORDS}, x AS (SELECT lang, word, {_THIRDS} AS tokens FROM words) SELECT lang, word, array_to_string(list_transform(range(1, len(tokens) + 1), lambda i: least(3 * i, length(word))), ',') AS ends FROM x")
def token_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each token of each word ends."""
    cleaned = t.clean_tokens(F.col("tokens"))
    return _tokenized_words(spark, sf_dir).select("lang", "word", F.array_join(F.transform(mo.ends(cleaned), lambda x: x.cast("string")), ",").alias("ends"))


_MARKS = "[chr(288) || word, '##' || word, word || '</w>', word || '@@', '<|' || word || '|>', '[' || word || '|>', word, chr(9601) || word, ' ' || word]"


@query(f"WITH {_WORDS} SELECT lang, word, array_to_string(list_concat(list_resize([]::VARCHAR[], 4, word), list_resize([]::VARCHAR[], 3, word)), '|') AS cleaned FROM words")
def clean_token_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word under every mark: special tokens vanish, the others give the word back."""
    w = F.col("word")
    marked = F.array(F.concat(F.lit("Ġ"), w), F.concat(F.lit("##"), w), F.concat(w, F.lit("</w>")), F.concat(w, F.lit("@@")), F.concat(F.lit("<|"), w, F.lit("|>")), F.concat(F.lit("["), w, F.lit("|>")), w, F.concat(F.lit("▁"), w), F.concat(F.lit(" "), w))
    return words(spark, sf_dir).select("lang", "word", F.array_join(t.clean_tokens(marked), "|").alias("cleaned"))


@query(
    f"""WITH {_WORDS}, l AS (SELECT DISTINCT word, 2 AS priority, substr(word, 1, 3) AS m FROM words WHERE lang = 'en' UNION ALL SELECT DISTINCT word, 1, substr(word, 1, 2) FROM words WHERE lang = 'en' AND length(word) % 2 = 0)
 SELECT w.lang AS lang, w.word AS word, arg_min(l.m, l.priority) AS first FROM words w JOIN l ON l.word = w.word WHERE w.lang = 'en' GROUP BY ALL"""
)
def morpheme_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphemes from two lexicons under another language code, the first dataset before the second."""
    own = words(spark, sf_dir)
    english = own.where("lang = 'en'").select(F.lit("eng").alias("lang"), "word")
    second = english.select("lang", "word", F.lit(2).alias("priority"), F.array(F.substring("word", 1, 3)).alias("morphemes"))
    first = english.where(F.length("word") % 2 == 0).select("lang", "word", F.lit(1).alias("priority"), F.array(F.substring("word", 1, 2)).alias("morphemes"))
    codes = spark.createDataFrame([("en", "eng"), ("de", "deu")], "lang string, other string")
    found = mo.lookup_morphemes(own.select("lang", "word"), first.unionByName(second), codes)
    return found.select("lang", "word", F.element_at("morphemes", 1).alias("first"))


@query(
    f"""WITH {_WORDS}, x AS (SELECT DISTINCT word, substr(word, 1, length(word) // 2) AS base FROM words WHERE length(word) >= 4),
 y AS (SELECT word || 'ung' AS derived, word AS base FROM x UNION ALL SELECT base, word FROM x UNION ALL SELECT 'un' || word, word FROM x UNION ALL SELECT substr(word, 1, 2) || '0' || substr(word, 3), word FROM x UNION ALL SELECT base || '0x', base || '9yz' FROM x),
 z AS (SELECT base, derived, length(base) AS b, length(derived) AS d, len(list_filter(range(1, least(length(base), length(derived)) + 1), lambda i: substr(base, 1, i) = substr(derived, 1, i))) AS n FROM (SELECT DISTINCT base, derived FROM y))
 SELECT base, derived, array_to_string(CASE WHEN n = b AND d > b THEN [base, substr(derived, b + 1)] WHEN n = d THEN [derived] WHEN ends_with(derived, base) THEN [substr(derived, 1, d - b), base]
  WHEN n > 0 AND d > b AND ends_with(substr(derived, n + 1), substr(base, n + 1)) THEN [substr(derived, n + 1, d - b), base] WHEN n > 0 THEN [substr(derived, 1, n), substr(derived, n + 1)] ELSE [derived] END, '|') AS morphemes FROM z"""
)
def infer_morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivations by suffix, truncation, prefix, insertion and change of ending."""
    x = words(spark, sf_dir).where(F.length("word") >= 4).select("word", F.expr("substr(word, 1, length(word) div 2)").alias("base")).distinct()
    made = F.array(
        *(F.struct(b.alias("base"), d.alias("derived")) for b, d in ((F.col("word"), F.concat("word", F.lit("ung"))), (F.col("word"), F.col("base")), (F.col("word"), F.concat(F.lit("un"), "word")), (F.col("word"), F.concat(F.substring("word", 1, 2), F.lit("0"), F.substring("word", 3, 1 << 30))), (F.concat("base", F.lit("9yz")), F.concat("base", F.lit("0x")))))
    )
    y = x.select(F.explode(made).alias("y")).select("y.*").distinct()
    return y.select("base", "derived", F.array_join(mo.infer_morphemes(F.col("base"), F.col("derived"), F.lit(None)), "|").alias("morphemes"))


_SPACED = r"regexp_extract_all(text, ' ?[\p{L}\p{N}_]+| ?[^\p{L}\p{N}_\s]+')"


@query(
    f"""WITH d AS (SELECT lang, doc_id, list_transform({sql.words("lower(text)")}, lambda w: {_strip_sql("w")}) AS words, {_SPACED} AS tokens FROM documents WHERE {sql.strip("text")} <> ''),
 e AS (SELECT lang, doc_id, len(words) AS nw, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM d),
 g AS (SELECT *, sum(CASE WHEN pos > 0 AND starts_with(token, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM e),
 h AS (SELECT lang, doc_id, nw, g, list(token ORDER BY pos) AS toks FROM g GROUP BY ALL),
 i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS rn, {_strip_sql("array_to_string(list_filter(list_transform(toks, lambda x: CASE WHEN starts_with(x, ' ') THEN substr(x, 2) WHEN starts_with(x, '##') THEN substr(x, 3) WHEN ends_with(x, '@@') THEN substr(x, 1, length(x) - 2) ELSE x END), lambda x: x <> ''), '')")} AS txt FROM h),
 j AS (SELECT *, sum(CASE WHEN rn = 1 OR txt <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) - 1 AS k FROM i),
 k AS (SELECT lang, doc_id, least(k, nw - 1) AS word_index, flatten(list(toks ORDER BY g)) AS tokens FROM j WHERE nw > 0 GROUP BY ALL),
 n AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS word_index FROM d)
 SELECT k.doc_id AS doc_id, k.word_index::BIGINT AS word_index, n.word AS word, md5(array_to_string(k.tokens, '␟')) AS digest FROM k JOIN n ON n.doc_id = k.doc_id AND n.word_index = k.word_index"""
)
def align_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each word of each text; tokens carry the space before them."""
    tokens = F.regexp_extract_all("text", F.lit(r"(?U) ?\w+| ?[^\w\s]+"), F.lit(0))
    tok = spread(documents(spark, sf_dir)).where(t.not_blank(F.col("text"))).select(F.lit("spaced").alias("tokenizer"), "lang", "doc_id", "text", tokens.alias("tokens"))
    return mo.align_words(tok).select("doc_id", F.col("word_index").cast("bigint").alias("word_index"), "word", digest(F.col("tokens")).alias("digest"))
