"""Sources over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.plans import sql
from glyphmeter.plans.common import rounded
from glyphmeter.plans.registry import documents, query, table
from glyphmeter.sources import texts as tx
from glyphmeter.streaming.counts import windowed_events


@query(f"SELECT 'documents' AS source, count(*) AS texts, sum(length({sql.strip('text')}))::BIGINT AS characters FROM documents WHERE {sql.strip('text')} NOT IN ('', 'nan') UNION ALL SELECT 'pages', count(*), sum(length({sql.strip('url')}))::BIGINT FROM pages WHERE {sql.strip('url')} NOT IN ('', 'nan')")
def parquet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns found by name, else the first string column."""
    out = None
    for name in ("documents", "pages"):
        rows = tx.read_parquet(spark, f"{sf_dir}/{name}.parquet").agg(F.lit(name).alias("source"), F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT lang, count(*) AS texts, sum(length(text))::BIGINT AS characters FROM documents WHERE text <> '' AND lang IN ('fr', 'es') GROUP BY lang")
def texts_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the languages of a group; the filter reaches the scan."""
    return documents(spark, sf_dir).where(F.col("lang").isin("fr", "es") & (F.col("text") != "")).groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate run as a batch: events by hour and type."""
    out = windowed_events(table(spark, sf_dir, "events"))
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)
