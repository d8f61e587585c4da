"""Structured Streaming: token counts and text statistics of arriving texts, and windowed event measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmeter.operators import tokenized as tk


def streaming_totals(texts: DataFrame, names: tuple[str, ...] = tk.STANDARD) -> DataFrame:
    """Running texts, tokens and words by tokenizer and language: use in complete or update mode."""
    s = tk.text_stats_of(texts, names)
    return s.groupBy("tokenizer", "lang").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"))


def streaming_counts(texts: DataFrame, names: tuple[str, ...] = tk.STANDARD) -> DataFrame:
    """Running token counts: use in complete or update mode."""
    return tk.token_counts(tk.tokenize(texts, names))


def merge_counts(texts: DataFrame, path: str, checkpoint: str, names: tuple[str, ...] = tk.STANDARD) -> StreamingQuery:
    """Each micro-batch's counts under its own number: a batch that runs twice replaces itself.  Sum them to read."""

    def write(batch: DataFrame, number: int) -> None:
        tk.token_counts(tk.tokenize(batch, names)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("tokenizer", "lang", "token").agg(F.sum("n").alias("n"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type, late ones within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
