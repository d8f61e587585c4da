"""Measures by tokenizer and by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.operators import measures as ms
from glyphmeter.operators import tokenized as tk
from glyphmeter.plans import sql
from glyphmeter.plans.common import counts, rounded, stats, stats_rounded, totals
from glyphmeter.plans.registry import ORACLES, QUERIES, documents, query, spread


def _fertility(unit: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats_rounded(ms.fertility(stats(spark, sf_dir), unit))

    QUERIES[f"fertility_{unit}"] = run
    ORACLES[f"fertility_{unit}"] = f"WITH {sql.STATS} SELECT tokenizer, {sql.stats_of(f'(n_tokens::DOUBLE / {column})')} FROM stats WHERE {column} > 0 GROUP BY tokenizer"


for _unit, _column in ms.UNITS.items():
    _fertility(_unit, _column)


def _by_language(x: str, where: str = "n_tokens > 0") -> str:
    return f"WITH {sql.STATS} SELECT tokenizer, lang, {sql.stats_of(x)} FROM stats WHERE {where} GROUP BY tokenizer, lang"


@query(_by_language("(n_tokens::DOUBLE / n_words)", "n_words > 0"))
def fertility_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_rounded(ms.fertility(stats(spark, sf_dir), by=ms.LANGUAGE))


@query(f"WITH {sql.STATS} SELECT tokenizer, {sql.stats_of('(n_chars::DOUBLE / n_tokens)')} FROM stats WHERE n_tokens > 0 GROUP BY tokenizer")
def token_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_rounded(ms.token_length(stats(spark, sf_dir)))


@query(f"WITH {sql.STATS} SELECT tokenizer, {sql.stats_of('(n_tokens::DOUBLE / n_lines)')}, sum(n_lines)::BIGINT AS total_lines FROM stats GROUP BY tokenizer")
def tokens_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_rounded(ms.tokens_per_line(stats(spark, sf_dir)))


@query(f"WITH {sql.STATS} SELECT tokenizer, {sql.stats_of('(1.0::DOUBLE / n_tokens)')} FROM stats WHERE n_tokens > 0 GROUP BY tokenizer")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_rounded(ms.compression(stats(spark, sf_dir)))


@query(_by_language("(1.0::DOUBLE / n_tokens)"))
def compression_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_rounded(ms.compression(stats(spark, sf_dir), by=ms.LANGUAGE))


@query(_by_language("(n_bytes::DOUBLE / n_tokens)"))
def compression_bytes_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With bytes as the unit, as a normalisation asks for."""
    return stats_rounded(ms.compression(stats(spark, sf_dir), "bytes", by=ms.LANGUAGE))


_USE = "count(DISTINCT token)::BIGINT AS used_tokens"


def _use_sql(by: str) -> str:
    return f"""WITH {sql.COUNTS}, u AS (SELECT {by}, {_USE} FROM counts GROUP BY {by}) SELECT {", ".join(f"u.{x}" for x in by.split(", "))}, used_tokens, vocab_size,
 vocab_size - used_tokens AS unused_tokens, round(used_tokens::DOUBLE / vocab_size, 6) AS utilization FROM u JOIN ({sql.SIZES}) s ON s.tokenizer = u.tokenizer"""


@query(_use_sql("tokenizer"))
def vocab_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = totals(spark, sf_dir)
    return rounded(ms.vocabulary_use(total, tk.vocabulary_sizes(total)))


@query(_use_sql("tokenizer, lang"))
def vocab_utilization_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = counts(spark, sf_dir)
    return rounded(ms.vocabulary_use(own, tk.vocabulary_sizes(tk.roll_up(own)), ms.LANGUAGE))


def _ttr_sql(by: str) -> str:
    return f"WITH {sql.COUNTS} SELECT {by}, count(DISTINCT token)::BIGINT AS types, sum(n)::BIGINT AS tokens, round(count(DISTINCT token)::DOUBLE / sum(n), 6) AS ttr FROM counts GROUP BY {by}"


@query(_ttr_sql("tokenizer"))
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.type_token_ratio(totals(spark, sf_dir)))


@query(_ttr_sql("tokenizer, lang"))
def type_token_ratio_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.type_token_ratio(counts(spark, sf_dir), ms.LANGUAGE))


def _entropies(source: str, by: str) -> str:
    keys = by.split(", ")
    return f"""p AS (SELECT {by}, n::DOUBLE / sum(n) OVER (PARTITION BY {by}) AS p FROM {source}), e AS (
 SELECT {by}, -sum(p * log2(p)) AS e1, log2(sum(pow(p, 2.0::DOUBLE))) / (1.0::DOUBLE - 2.0::DOUBLE) AS e2, log2(sum(pow(p, 2.5::DOUBLE))) / (1.0::DOUBLE - 2.5::DOUBLE) AS e25, log2(sum(pow(p, 3.0::DOUBLE))) / (1.0::DOUBLE - 3.0::DOUBLE) AS e3 FROM p GROUP BY {by})
 SELECT {", ".join(keys)}, 1.0::DOUBLE AS alpha, round(e1, 6) AS entropy FROM e UNION ALL SELECT {by}, 2.0::DOUBLE, round(e2, 6) FROM e UNION ALL SELECT {by}, 2.5::DOUBLE, round(e25, 6) FROM e UNION ALL SELECT {by}, 3.0::DOUBLE, round(e3, 6) FROM e"""


@query(f"WITH {sql.TOTALS}, {_entropies('total', 'tokenizer')}")
def renyi_entropy_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.renyi(totals(spark, sf_dir)))


@query(f"WITH {sql.COUNTS}, {_entropies('counts', 'tokenizer, lang')}")
def renyi_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.renyi(counts(spark, sf_dir), ms.LANGUAGE))


def _unigram_sql(source: str, by: str) -> str:
    return f"""r AS (SELECT {by}, n, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, token) AS rank, n::DOUBLE / sum(n) OVER (PARTITION BY {by}) AS p FROM {source})
 SELECT {by}, round(-sum(p * log2(p)), 6) AS entropy, round(sum(n * rank)::DOUBLE / sum(n), 6) AS avg_token_rank, count(*)::BIGINT AS unique_tokens, sum(n)::BIGINT AS total_tokens FROM r GROUP BY {by}"""


@query(f"WITH {sql.TOTALS}, {_unigram_sql('total', 'tokenizer')}")
def unigram_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.unigram(totals(spark, sf_dir)))


@query(f"WITH {sql.COUNTS}, {_unigram_sql('counts', 'tokenizer, lang')}")
def avg_token_rank_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.unigram(counts(spark, sf_dir), ms.LANGUAGE))


@query(f"WITH {sql.COUNTS} SELECT tokenizer, lang, token, n::BIGINT AS n FROM counts")
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


def _pair(name: str, cte: str, value: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(ms.pairwise(*build(spark, sf_dir)))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {cte}, vals AS ({value}) {sql.PAIRS}"


_pair("pairwise_fertility", sql.STATS, "SELECT tokenizer, avg(n_tokens::DOUBLE / n_words) AS v FROM stats WHERE n_words > 0 GROUP BY tokenizer", lambda s, d: (ms.fertility(stats(s, d)), "mean"))
_pair("pairwise_compression", sql.STATS, "SELECT tokenizer, avg(1.0::DOUBLE / n_tokens) AS v FROM stats WHERE n_tokens > 0 GROUP BY tokenizer", lambda s, d: (ms.compression(stats(s, d)), "mean"))
_P = "SELECT tokenizer, n, n::DOUBLE / sum(n) OVER (PARTITION BY tokenizer) AS p, row_number() OVER (PARTITION BY tokenizer ORDER BY n DESC, token) AS r FROM total"
_pair("pairwise_entropy", sql.TOTALS, f"SELECT tokenizer, -sum(p * log2(p)) AS v FROM ({_P}) GROUP BY tokenizer", lambda s, d: (ms.unigram(totals(s, d)), "entropy"))
_pair("pairwise_token_rank", sql.TOTALS, f"SELECT tokenizer, sum(n * r)::DOUBLE / sum(n) AS v FROM ({_P}) GROUP BY tokenizer", lambda s, d: (ms.unigram(totals(s, d)), "avg_token_rank"))


@query(f"WITH {sql.STATS}, f AS (SELECT tokenizer, lang, avg(n_tokens::DOUBLE / n_words) AS m FROM stats WHERE n_words > 0 GROUP BY ALL) SELECT tokenizer, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(stddev_pop(m) / sqrt(count(m)), 6) AS std_err, count(m) AS count FROM f GROUP BY tokenizer")
def macro_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over languages of their means."""
    return rounded(ms.macro(ms.fertility(stats(spark, sf_dir), by=ms.LANGUAGE), "mean"))


@query(f"""WITH {sql.STATS} SELECT tokenizer, lang, count(*) AS texts, sum(n_tokens)::BIGINT AS tokens, sum(n_chars)::BIGINT AS characters, sum(n_bytes)::BIGINT AS bytes, sum(n_words)::BIGINT AS words, sum(n_lines)::BIGINT AS lines
 FROM stats GROUP BY GROUPING SETS ((tokenizer, lang), (tokenizer), ())""")
def totals_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by tokenizer and language, by tokenizer, and of all, in one pass."""
    names = {"n_tokens": "tokens", "n_chars": "characters", "n_bytes": "bytes", "n_words": "words", "n_lines": "lines"}
    return stats(spark, sf_dir).rollup("tokenizer", "lang").agg(F.count("*").alias("texts"), *(F.sum(c).alias(n) for c, n in names.items()))


@query(None)
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fertility of a public BPE tokenizer file."""
    encoded = tk.encode_with_file(spread(documents(spark, sf_dir)), "/opt/tokenizers/byte_bpe_50k.json", "byte_bpe_50k")
    return stats_rounded(ms.fertility(tk.text_stats(encoded), by=ms.LANGUAGE))
