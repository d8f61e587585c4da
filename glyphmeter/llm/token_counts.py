"""Exact histogram of encoded lengths, with suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmeter.llm import bpe
from glyphmeter.llm.shared import checkpoint

#: Lengths a bucket of the two-level suffix sums holds.
BUCKET = 4096


def histogram(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """n_tokens, documents: how many texts have each encoded length.

    Texts are encoded whole.  A null text is no document; an empty text has 0 tokens; repeated rows count
    each; an empty table gives no rows; columns other than text play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen = bpe.codec(path), []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = batch.column("text").slice(at, 1024).to_pylist()
                seen.append(np.array([len(codec.encode(t)) for t in texts if t is not None], np.int64))
        length, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(length, pa.int64()), pa.array(n, pa.int64())], ["n_tokens", "documents"])

    partial = docs.select("text").mapInArrow(run, "n_tokens bigint, documents bigint")
    return checkpoint(partial.groupBy("n_tokens").agg(F.sum("documents").alias("documents")))  # so that texts are encoded once


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    n_tokens (L), documents (of this length), longer_documents and longer_tokens (of texts over L),
    total_tokens, truncated_tokens (the sum of min(length, L)), quantile (the share of texts of at most L).
    A histogram without rows gives none.  Sums run inside buckets of BUCKET lengths and over the buckets, so no task sees more than one bucket or
    the list of buckets.
    """
    bucket = F.floor(F.col("n_tokens") / BUCKET).alias("bucket")
    rows = lengths.select(bucket, "n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    totals = rows.groupBy("bucket").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    above = totals.select(
        "bucket",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer_d = F.coalesce(F.sum("documents").over(inside), F.lit(0)) + F.col("d_above")
    longer_t = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_above")
    joined = rows.join(above, "bucket").select("n_tokens", "documents", longer_d.alias("longer_documents"), longer_t.alias("longer_tokens"), "d_all", "t_all")
    return joined.select(
        "n_tokens",
        "documents",
        "longer_documents",
        "longer_tokens",
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("longer_tokens") + F.col("n_tokens") * F.col("longer_documents")).alias("truncated_tokens"),
        ((F.col("d_all") - F.col("longer_documents")) / F.col("d_all")).alias("quantile"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens, documents: for each share the least length that at least so many of the texts don't exceed.

    shares lie in 0 to 1; 0 gives the least length of all.  Without texts both are null.
    """
    asked = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("quantile") >= F.lit(float(q)), F.struct("n_tokens", "documents"))).alias("at")) for q in shares]
    return sums.agg(F.array(*asked).alias("x")).select(F.explode("x").alias("x")).select("x.share", "x.at.n_tokens", "x.at.documents")


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, longer_documents, longer_tokens, truncated_tokens for any limits, not only lengths that occur.

    What is over a limit is over the greatest length that doesn't exceed it.  One pass over the sums, without a join; a
    limit that is asked twice is answered twice; without texts all are 0.
    """
    asked = [F.struct(F.lit(int(x)).cast("bigint").alias("context_limit"), F.max(F.when(F.col("n_tokens") <= int(x), F.struct("n_tokens", "longer_documents", "longer_tokens"))).alias("at")) for x in limits]
    every = sums.agg(F.array(*asked).alias("x"), F.coalesce(F.sum("documents"), F.lit(0)).alias("d_all"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("t_all"))
    longer_d, longer_t = F.coalesce("x.at.longer_documents", "d_all"), F.coalesce("x.at.longer_tokens", "t_all")
    return every.select(F.explode("x").alias("x"), "d_all", "t_all").select(
        "x.context_limit",
        longer_d.alias("longer_documents"),
        longer_t.alias("longer_tokens"),
        (F.col("t_all") - longer_t + F.col("x.context_limit") * longer_d).alias("truncated_tokens"),
    )
