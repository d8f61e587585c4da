"""Fairness across languages: costs, Gini coefficient, Lorenz curve, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.operators import measures as ms
from glyphmeter.plans import sql
from glyphmeter.plans.common import rounded, stats
from glyphmeter.plans.registry import query


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.language_costs(stats(spark, sf_dir))


@query(f"WITH {sql.COSTS} SELECT tokenizer, lang, round(cost, 6) AS cost FROM costs")
def language_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(costs(spark, sf_dir))


@query(f"WITH {sql.STATS} SELECT tokenizer, lang, round(sum(n_tokens)::DOUBLE / sum(n_bytes), 6) AS cost FROM stats GROUP BY tokenizer, lang")
def language_costs_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.language_costs(stats(spark, sf_dir), "bytes"))


_GINI = """SELECT tokenizer, round((SELECT sum(abs(a.cost - b.cost)) FROM costs a, costs b WHERE a.tokenizer = c.tokenizer AND b.tokenizer = c.tokenizer) / (2 * count(*) * count(*) * avg(cost)), 6) AS gini"""


@query(
    f"""WITH {sql.COSTS}, pairs AS (SELECT a.tokenizer, sum(abs(a.cost - b.cost)) AS spread FROM costs a JOIN costs b ON a.tokenizer = b.tokenizer GROUP BY a.tokenizer)
 SELECT c.tokenizer, round(any_value(spread) / (2 * count(*) * count(*) * avg(cost)), 6) AS gini, round(avg(cost), 6) AS mean_cost, round(stddev_pop(cost), 6) AS std_cost, round(min(cost), 6) AS min_cost,
 round(max(cost), 6) AS max_cost, round(max(cost) / min(cost), 6) AS cost_ratio, arg_min(lang, cost) AS most_efficient, arg_max(lang, cost) AS least_efficient, count(*) AS languages, CAST(NULL AS VARCHAR) AS warning
 FROM costs c JOIN pairs p ON p.tokenizer = c.tokenizer GROUP BY c.tokenizer"""
)
def fairness_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.gini(costs(spark, sf_dir)))


@query(
    f"""WITH {sql.COSTS}, pairs AS (SELECT a.tokenizer, sum(abs(a.cost - b.cost)) AS spread FROM costs a JOIN costs b ON a.tokenizer = b.tokenizer GROUP BY a.tokenizer)
 SELECT c.tokenizer, round(any_value(spread) / (2 * count(*) * count(*) * avg(cost)), 6) AS gini FROM costs c JOIN pairs p ON p.tokenizer = c.tokenizer GROUP BY c.tokenizer"""
)
def gini_pairwise_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.gini_by_pairs(costs(spark, sf_dir)))


@query(
    f"""WITH {sql.COSTS}, r AS (SELECT tokenizer, lang, row_number() OVER (PARTITION BY tokenizer ORDER BY cost, lang) AS point, count(*) OVER (PARTITION BY tokenizer) AS n,
 sum(cost) OVER (PARTITION BY tokenizer) AS total, sum(cost) OVER (PARTITION BY tokenizer ORDER BY cost, lang ROWS UNBOUNDED PRECEDING) AS run FROM costs)
 SELECT tokenizer, point::INT AS point, lang, round(point::DOUBLE / n, 6) AS x, round(run / total, 6) AS y, round(point::DOUBLE / n, 6) AS equality FROM r
 UNION ALL SELECT DISTINCT tokenizer, 0, CAST(NULL AS VARCHAR), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM r"""
)
def lorenz_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ms.lorenz(costs(spark, sf_dir)))


@query(f"WITH {sql.COSTS} SELECT tokenizer, arg_min(lang, cost) AS best, arg_max(lang, cost) AS worst, round(max(cost) - min(cost), 6) AS spread FROM costs GROUP BY tokenizer")
def cost_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("cost", "lang")
    return rounded(costs(spark, sf_dir).groupBy("tokenizer").agg(F.min_by("lang", key).alias("best"), F.max_by("lang", key).alias("worst"), (F.max("cost") - F.min("cost")).alias("spread")))


@query(f"WITH {sql.COSTS} SELECT tokenizer, array_to_string(list(lang ORDER BY cost, lang), ',') AS languages FROM costs GROUP BY tokenizer")
def languages_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages from the cheapest to the dearest."""
    listed = F.array_sort(F.collect_list(F.struct("cost", "lang"))).getField("lang")
    return costs(spark, sf_dir).groupBy("tokenizer").agg(F.array_join(listed, ",").alias("languages"))
