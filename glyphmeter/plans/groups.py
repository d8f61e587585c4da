"""Measures by groups of languages, filters, samples, unions and plot and table views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmeter.operators import groups as gr
from glyphmeter.operators import measures as ms
from glyphmeter.operators import reports as rp
from glyphmeter.operators import tokenized as tk
from glyphmeter.plans import sql
from glyphmeter.plans.common import GROUPS, counts, rounded, stats, stats_rounded
from glyphmeter.plans.registry import documents, query, spread

GROUP = ("group_type", "group_name", "tokenizer")


def _grouped(rows: DataFrame) -> DataFrame:
    return gr.by_group(rows, gr.group_table(rows.sparkSession, GROUPS))


@query(f"WITH {sql.STATS} SELECT group_type, group_name, tokenizer, {sql.stats_of('(n_tokens::DOUBLE / n_words)')} FROM stats JOIN {sql.GROUPS} ON g.lang = stats.lang WHERE n_words > 0 GROUP BY ALL")
def grouped_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_rounded(ms.fertility(_grouped(stats(spark, sf_dir)), by=GROUP))


@query(
    f"""WITH {sql.COUNTS}, gc AS (SELECT group_type, group_name, tokenizer, token, sum(n) AS n FROM counts JOIN {sql.GROUPS} ON g.lang = counts.lang GROUP BY ALL),
 p AS (SELECT group_type, group_name, tokenizer, n::DOUBLE / sum(n) OVER (PARTITION BY group_type, group_name, tokenizer) AS p FROM gc)
 SELECT group_type, group_name, tokenizer, round(-sum(p * log2(p)), 6) AS entropy, round(log2(sum(p * p)) / -1.0::DOUBLE, 6) AS collision_entropy, count(*) AS types FROM p GROUP BY ALL"""
)
def grouped_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon and order-2 entropy of each group's token distribution."""
    merged = _grouped(counts(spark, sf_dir)).groupBy(*GROUP, "token").agg(F.sum("n").alias("n"))
    first, second = ms.entropies((1.0, 2.0))
    return rounded(merged.groupBy(*GROUP).agg(first.alias("entropy"), second.alias("collision_entropy"), F.count("*").alias("types")))


@query(
    f"""WITH {sql.COSTS}, gc AS (SELECT group_type, group_name, tokenizer, costs.lang, cost FROM costs JOIN {sql.GROUPS} ON g.lang = costs.lang),
 pairs AS (SELECT a.group_type, a.group_name, a.tokenizer, sum(abs(a.cost - b.cost)) AS spread FROM gc a JOIN gc b ON a.group_type = b.group_type AND a.group_name = b.group_name AND a.tokenizer = b.tokenizer GROUP BY ALL)
 SELECT gc.group_type, gc.group_name, gc.tokenizer, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE any_value(spread) / (2 * count(*) * count(*) * avg(cost)) END, 6) AS gini, count(*) AS languages
 FROM gc JOIN pairs p ON p.group_type = gc.group_type AND p.group_name = gc.group_name AND p.tokenizer = gc.tokenizer GROUP BY ALL"""
)
def grouped_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = ms.language_costs(stats(spark, sf_dir))
    return rounded(ms.gini(_grouped(costs), GROUP).select(*GROUP, "gini", "languages"))


@query(f"WITH {sql.COUNTS}, gc AS (SELECT group_type, group_name, tokenizer, token, sum(n) AS n FROM counts JOIN {sql.GROUPS} ON g.lang = counts.lang GROUP BY ALL) SELECT group_type, group_name, tokenizer, count(DISTINCT token)::BIGINT AS types, sum(n)::BIGINT AS tokens, round(count(DISTINCT token)::DOUBLE / sum(n), 6) AS ttr FROM gc GROUP BY ALL")
def grouped_type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _grouped(counts(spark, sf_dir)).groupBy(*GROUP, "token").agg(F.sum("n").alias("n"))
    return rounded(ms.type_token_ratio(merged, GROUP))


@query(f"WITH {sql.STATS} SELECT tokenizer, count(*) AS texts, sum(n_tokens)::BIGINT AS tokens FROM stats WHERE lang IN (SELECT lang FROM {sql.GROUPS} WHERE group_name = 'romance') GROUP BY tokenizer")
def filter_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = gr.group_table(spark, GROUPS).where("group_name = 'romance'").select("lang").distinct()
    return gr.in_languages(stats(spark, sf_dir), chosen).groupBy("tokenizer").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))


@query("SELECT lang, doc_id, position FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS position FROM documents) WHERE position <= 50")
def sample_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 texts of each language: a head, as a sampling operator."""
    position = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return documents(spark, sf_dir).select("lang", "doc_id", position.alias("position")).where("position <= 50")


@query(f"SELECT group_type, group_name, count(*) AS languages, string_agg(lang, ',' ORDER BY lang) AS members FROM {sql.GROUPS} GROUP BY ALL")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.group_statistics(gr.group_table(spark, GROUPS))


_VALUES = f"""WITH {sql.TOTALS}, {sql.STATS.partition("stats AS")[1]}{sql.STATS.partition("stats AS")[2]}, costs AS (SELECT tokenizer, lang, sum(n_tokens)::DOUBLE / count(*) AS cost FROM stats GROUP BY ALL),
 pr AS (SELECT tokenizer, n, n::DOUBLE / sum(n) OVER (PARTITION BY tokenizer) AS p, row_number() OVER (PARTITION BY tokenizer ORDER BY n DESC, token) AS r FROM total),
 vals AS (SELECT tokenizer, 'fertility' AS metric, avg(n_tokens::DOUBLE / n_words) AS value FROM stats WHERE n_words > 0 GROUP BY tokenizer
 UNION ALL SELECT tokenizer, 'token_length', avg(n_chars::DOUBLE / n_tokens) FROM stats GROUP BY tokenizer
 UNION ALL SELECT tokenizer, 'avg_tokens_per_line', avg(n_tokens::DOUBLE / n_lines) FROM stats GROUP BY tokenizer
 UNION ALL SELECT tokenizer, 'compression_rate', avg(1.0::DOUBLE / n_tokens) FROM stats GROUP BY tokenizer
 UNION ALL SELECT t.tokenizer, 'vocabulary_utilization', count(*)::DOUBLE / any_value(vocab_size) FROM total t JOIN ({sql.SIZES}) s ON s.tokenizer = t.tokenizer GROUP BY t.tokenizer
 UNION ALL SELECT tokenizer, 'type_token_ratio', count(*)::DOUBLE / sum(n) FROM total GROUP BY tokenizer
 UNION ALL SELECT tokenizer, 'renyi_1.0', -sum(p * log2(p)) FROM pr GROUP BY tokenizer
 UNION ALL SELECT tokenizer, 'renyi_2.5', log2(sum(pow(p, 2.5::DOUBLE))) / -1.5::DOUBLE FROM pr GROUP BY tokenizer
 UNION ALL SELECT tokenizer, 'avg_token_rank', sum(n * r)::DOUBLE / sum(n) FROM pr GROUP BY tokenizer
 UNION ALL SELECT a.tokenizer, 'gini', sum(abs(a.cost - b.cost)) / (2.0 * count(*) * (SELECT avg(cost) FROM costs c WHERE c.tokenizer = a.tokenizer)) FROM costs a JOIN costs b ON a.tokenizer = b.tokenizer GROUP BY a.tokenizer)"""
_CATALOG = "(VALUES " + ", ".join(f"('{m.name}', {m.lower_is_better})" for m in rp.CATALOG) + ") AS k(metric, lower_is_better)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.all_values(stats(spark, sf_dir), counts(spark, sf_dir))


@query(f"{_VALUES} SELECT tokenizer, metric, round(value, 6) AS value FROM vals")
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of the report as a tidy table."""
    return rounded(_values(spark, sf_dir).select("tokenizer", "metric", "value"))


@query(f"{_VALUES} SELECT vals.metric AS metric, tokenizer AS best FROM vals JOIN {_CATALOG} ON k.metric = vals.metric QUALIFY row_number() OVER (PARTITION BY vals.metric ORDER BY CASE WHEN lower_is_better THEN value ELSE -value END, tokenizer) = 1")
def best_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.best(_values(spark, sf_dir))


@query(f"{_VALUES} SELECT tokenizer, " + ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN value END), 6) AS {m}" for m in ("fertility", "token_length", "type_token_ratio", "gini")) + " FROM vals GROUP BY tokenizer")
def metrics_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenizers by measures."""
    return rounded(rp.pivot(_values(spark, sf_dir), ["fertility", "token_length", "type_token_ratio", "gini"]))


@query(f"WITH {sql.STATS}, m AS (SELECT tokenizer, avg(n_tokens::DOUBLE / n_words) AS value FROM stats WHERE n_words > 0 GROUP BY tokenizer) SELECT tokenizer, round(value, 6) AS value, round((SELECT avg(value) FROM m), 6) AS reference FROM m")
def plot_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a measure with the mean of all tokenizers as reference line."""
    return rounded(rp.with_reference(ms.fertility(stats(spark, sf_dir)).select("tokenizer", F.col("mean").alias("value"))))


@query(f"WITH {sql.STATS}, m AS (SELECT lang, tokenizer, avg(n_tokens::DOUBLE / n_words) AS v FROM stats WHERE n_words > 0 GROUP BY ALL) SELECT lang, " + ", ".join(f"round(coalesce(max(CASE WHEN tokenizer = '{n}' THEN v END), 0), 6) AS {n}" for n in tk.STANDARD) + " FROM m GROUP BY lang")
def plot_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by tokenizers; 0 where one is missing."""
    return rounded(ms.fertility(stats(spark, sf_dir), by=ms.LANGUAGE).groupBy("lang").pivot("tokenizer", list(tk.STANDARD)).agg(F.first("mean")).na.fill(0.0))


@query(f"WITH {sql.COSTS}, r AS (SELECT tokenizer, lang, cost, row_number() OVER (PARTITION BY tokenizer ORDER BY cost, lang) - 1 AS pos, count(*) OVER (PARTITION BY tokenizer) AS n FROM costs) SELECT tokenizer, lang, round(cost, 6) AS cost FROM r WHERE n <= 100 OR pos % greatest(1, n // 50) = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series thinned to about 50 points for the slim report."""
    return rounded(rp.thin(ms.language_costs(stats(spark, sf_dir)), "tokenizer", ("cost", "lang")))


@query(f"WITH {sql.STATS} SELECT count(DISTINCT tokenizer) AS tokenizers, count(DISTINCT lang) AS languages, count(*) AS texts, sum(n_tokens)::BIGINT AS tokens FROM stats")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).agg(F.countDistinct("tokenizer").alias("tokenizers"), F.countDistinct("lang").alias("languages"), F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))


#: Of each measure of the basic table: its title, factor, digits, and the sign that makes less better.
_SHOWN = [("fertility", "Fertility", 1, 3, 1), ("vocabulary_utilization", r"\makecell{Vocabulary \\ Utilization (%)}", 100, 1, -1), ("type_token_ratio", r"\makecell{Type-Token \\ Ratio}", 1, 4, -1), ("gini", "Fairness Gini", 1, 3, 1)]
_CELLS = " || ' & ' || ".join(f"(SELECT CASE WHEN value = (SELECT {'min' if sign > 0 else 'max'}(value) FROM vals WHERE metric = '{m}') THEN '\\textbf{{' || printf('%.{digits}f', value * {factor}) || '}}' ELSE printf('%.{digits}f', value * {factor}) END FROM vals WHERE metric = '{m}' AND vals.tokenizer = t.tokenizer)" for m, _, factor, digits, sign in _SHOWN)
_HEAD = [r"\begin{table}[htbp]", r"\centering", r"\begin{tabular}{lcccc}", r"\toprule", " & ".join(["Tokenizer", *(x[1] for x in _SHOWN)]) + r" \\", r"\midrule"]
_TAIL = [r"\bottomrule", r"\end{tabular}", r"\caption{Basic measures}", r"\label{tab:basic}", r"\end{table}"]


@query(
    f"""{_VALUES} SELECT line::INT AS line, text FROM (SELECT unnest(range(0, {len(_HEAD)})) AS line, unnest([{", ".join(f"'{x}'" for x in _HEAD)}]) AS text
 UNION ALL SELECT {len(_HEAD)} + row_number() OVER (ORDER BY tokenizer) - 1, tokenizer || ' & ' || {_CELLS} || ' \\\\' FROM (SELECT DISTINCT tokenizer FROM vals) t
 UNION ALL SELECT {len(_HEAD)} + (SELECT count(DISTINCT tokenizer) FROM vals) + unnest(range(0, {len(_TAIL)})), unnest([{", ".join(f"'{x}'" for x in _TAIL)}]))"""
)
def latex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the LaTeX table of basic measures."""
    return rp.latex_rows(_values(spark, sf_dir), "basic", caption="Basic measures", label="tab:basic")


@query(f"""{_VALUES} SELECT tokenizer, '{{' || string_agg('"' || metric || '":' || CAST(round(value, 6) AS DECIMAL(38, 6))::VARCHAR, ',' ORDER BY metric) || '}}' AS json FROM vals GROUP BY tokenizer""")
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object of all measures per tokenizer."""
    return rp.to_json(_values(spark, sf_dir))


_CONV = "UNION ALL ".join(f"SELECT '{n}' AS tokenizer, role AS lang, text, {sql.TOKENS[n]} AS tokens FROM conversations WHERE {sql.strip('text')} <> '' " for n in ("whitespace",))


@query(f"WITH {sql.TOK}, a AS (SELECT tokenizer, lang, len(tokens) AS k FROM tok UNION ALL SELECT 'conversation_' || tokenizer, lang, len(tokens) FROM ({_CONV})) SELECT tokenizer, lang, count(*) AS texts, sum(k)::BIGINT AS tokens FROM a GROUP BY ALL")
def union_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenized tables of several providers in one; names must not clash."""
    first = tk.tokenize(spread(documents(spark, sf_dir)))
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("role").alias("lang"), F.col("conv_id").alias("doc_id"), "text")
    second = tk.tokenize(talk, ("whitespace",)).withColumn("tokenizer", F.concat(F.lit("conversation_"), "tokenizer"))
    both = rp.union_of(first, second, names=[tk.STANDARD, ["conversation_whitespace"]])
    return both.groupBy("tokenizer", "lang").agg(F.count("*").alias("texts"), F.sum(F.size("tokens")).alias("tokens"))
