"""Measures of tokenizers: fertility, lengths, vocabulary use, type-token ratio, compression, entropy, fairness.

All are aggregates of text_stats or token_counts (see tokenized) by tokenizer, by tokenizer and language, or
by tokenizer and group of languages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmeter.functions.text import safe_divide

TOKENIZER, LANGUAGE = ("tokenizer",), ("tokenizer", "lang")
ORDERS = (1.0, 2.0, 2.5, 3.0)


#: Buckets of values per power of two, from which a median is found.
BUCKETS = 4096


def summarise(rows: DataFrame, value: Column, by: Sequence[str], *extra: str, known: bool = False) -> DataFrame:
    """mean, median, population std, standard error (null for one value), min, max, count and sum; and the sums of `extra`.

    Rows with a null value don't count; known: there are none, and nothing is tested, so that an expensive value isn't
    computed once more for the test.  The median is exact, though no task sees all values of a group: values are
    counted, equal ones as one before anything moves; the counts go into buckets of nearly equal values; running sums
    over the buckets tell which ones hold the middle, and only the values of those are sorted.  All figures come from
    the counts, so the rows are read once.
    """
    v = F.col("value")
    counts = rows.select(*by, value.cast("double").alias("value"), *extra).where("true" if known else "value is not null").groupBy(*by, "value").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in extra))
    bucket = F.when(v > 0, F.floor(F.log2(v) * BUCKETS)).when(v < 0, -F.floor(F.log2(-v) * BUCKETS) - F.lit(1 << 40)).otherwise(F.lit(-(1 << 20) * BUCKETS)).alias("bucket")
    placed = counts.select(*by, bucket, "value", "n", *extra)
    sums = [F.sum("n").alias("n"), F.sum(v * F.col("n")).alias("s"), F.min("value").alias("low"), F.max("value").alias("high")]
    buckets = placed.groupBy(*by, "bucket").agg(*sums, (F.sum(v * v * F.col("n")) - F.sum(v * F.col("n")) * F.sum(v * F.col("n")) / F.sum("n")).alias("m2"), *(F.sum(c).alias(c) for c in extra))
    every, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bucket")
    ranked = buckets.select("*", F.sum("n").over(every).alias("all"), (F.sum("n").over(order) - F.col("n")).alias("before"), (F.sum("s").over(every) / F.sum("n").over(every)).alias("mean_of_all"))
    # the middle are the values number (all - 1) div 2 and all div 2, counted from 0
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    first, second = F.expr("(all - 1) div 2"), F.expr("all div 2")
    middle = ranked.where(holds(first) | holds(second)).select(*by, "bucket", "before", "all")
    own = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "bucket")]
    condition = own[0]
    for x in own[1:]:
        condition = condition & x
    inside = placed.alias("a").join(middle.alias("b"), condition).select(*(F.col(f"a.{c}").alias(c) for c in by), "a.value", "a.n", "b.before", "b.all", "b.bucket")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bucket").orderBy("value"))
    sought = inside.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    at = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("upto")), F.col("value")))
    medians = sought.groupBy(*by).agg(((at(first) + at(second)) / 2).alias("median"))
    n, total = F.sum("n"), F.sum("s")
    spread = F.greatest(F.lit(0.0), F.sum("m2") + F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mean_of_all"), 2)))
    moments = ranked.groupBy(*by).agg(
        (total / n).alias("mean"),
        F.sqrt(spread / n).alias("std"),
        F.when(n > 1, F.sqrt(spread / (n - 1)) / F.sqrt(n.cast("double"))).alias("std_err"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        n.alias("count"),
        total.alias("sum"),
        *(F.sum(c).alias(c) for c in extra),
    )
    both = moments.alias("a").join(medians.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    return both.select(*(F.col(f"a.{c}").alias(c) for c in by), "mean", "median", "std", "std_err", "min", "max", "count", "sum", *extra)


UNITS = {"words": "n_words", "characters": "n_chars", "bytes": "n_bytes", "lines": "n_lines"}


def fertility(stats: DataFrame, unit: str = "words", by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Tokens per unit of each text (texts without units are left out), summarised."""
    n = F.col(UNITS[unit])
    has_units = F.col("not_blank") if unit == "words" else n > 0  # the same, but the words are split once
    return summarise(stats.where(has_units), F.col("n_tokens") / n, by, known=True)


def token_length(stats: DataFrame, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Characters per token of each text, summarised."""
    return summarise(stats.where("n_tokens > 0"), F.col("n_chars") / F.col("n_tokens"), by, known=True)


def tokens_per_line(stats: DataFrame, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Tokens per line of each text, summarised, and all lines."""
    return summarise(stats.where("n_lines > 0"), F.col("n_tokens") / F.col("n_lines"), by, "n_lines", known=True).withColumnRenamed("n_lines", "total_lines")


def compression(stats: DataFrame, unit: str | None = None, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Units per token of each text that isn't blank, summarised; without a unit a text counts as one."""
    n = F.lit(1) if unit is None else F.col(UNITS[unit])
    return summarise(stats.where("not_blank and n_tokens > 0"), n / F.col("n_tokens"), by, known=True)


def with_absent(values: DataFrame, keys: DataFrame) -> DataFrame:
    """values with a row of zeros for each of keys (some columns of values) that has none."""
    zero = {c: 0.0 if kind == "double" else 0 for c, kind in values.dtypes if c not in keys.columns and kind in ("double", "float", "int", "bigint")}
    absent = keys.distinct().join(values, list(keys.columns), "left_anti")
    return values.unionByName(absent.select("*", *(F.lit(z).cast(values.schema[c].dataType).alias(c) for c, z in zero.items())), allowMissingColumns=True)


def vocabulary_use(counts: DataFrame, sizes: DataFrame, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Distinct tokens against the size of the vocabulary.  counts has one row per token and `by`."""
    used = counts.groupBy(*by).agg(F.count("*").alias("used_tokens")).join(sizes, "tokenizer")
    return used.select(*by, "used_tokens", "vocab_size", (F.col("vocab_size") - F.col("used_tokens")).alias("unused_tokens"), safe_divide(F.col("used_tokens"), F.col("vocab_size")).alias("utilization"))


def type_token_ratio(counts: DataFrame, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Distinct tokens, all tokens, and their ratio.  counts has one row per token and `by`."""
    n = counts.groupBy(*by).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
    return n.select("*", safe_divide(F.col("types"), F.col("tokens")).alias("ttr"))


def entropies(orders: Sequence[float]) -> list[Column]:
    """Aggregates of the counts n: the entropy in bits of each order; order 1 is Shannon's.

    With N the sum of the counts n, H_1 = log2 N - sum(n log2 n) / N and, of any other order a,
    H_a = (log2 sum(n**a) - a log2 N) / (1 - a).
    """
    n = F.col("n").cast("double")
    total = F.sum(n)
    values = []
    for a in orders:
        value = F.log2(total) - F.sum(n * F.log2(n)) / total if a == 1.0 else (F.log2(F.sum(F.pow(n, F.lit(float(a))))) - F.lit(float(a)) * F.log2(total)) / F.lit(1.0 - a)
        values.append(value)
    return values


def renyi(counts: DataFrame, by: Sequence[str] = TOKENIZER, orders: Sequence[float] = ORDERS) -> DataFrame:
    """Entropy of each order of the token distribution, in one aggregate.  counts has one row per token and `by`."""
    values = [F.struct(F.lit(float(a)).alias("alpha"), x.alias("entropy")) for a, x in zip(orders, entropies(orders))]
    return counts.groupBy(*by).agg(F.array(*values).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.alpha", "x.entropy")


def unigram(counts: DataFrame, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Shannon entropy, mean frequency rank of a token occurrence, and totals.

    Ranks come from the histogram of counts: tokens with equal counts share the mean of their ranks, which
    gives the same average as any order among them, and only distinct counts are sorted.
    """
    levels = counts.groupBy(*by, "n").agg(F.count("*").alias("k"))
    above = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    ranked = levels.select(*by, "n", "k", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("before"), F.sum(F.col("n") * F.col("k")).over(every).alias("total"))
    p = F.col("n") / F.col("total")
    rank = F.col("before") + (F.col("k") + 1) / 2
    return ranked.groupBy(*by).agg(
        (-F.sum(F.col("k") * p * F.log2(p))).alias("entropy"),
        (F.sum(F.col("n") * F.col("k") * rank) / F.first("total")).alias("avg_token_rank"),
        F.sum("k").alias("unique_tokens"),
        F.first("total").alias("total_tokens"),
    )


def pairwise(values: DataFrame, value: str = "mean") -> DataFrame:
    """Each pair of tokenizers once, in order of name: difference, ratio and percent difference of a value."""
    v = values.select("tokenizer", F.col(value).alias("v"))
    a, b = v.select(F.col("tokenizer").alias("first"), F.col("v").alias("value_1")), v.select(F.col("tokenizer").alias("second"), F.col("v").alias("value_2"))
    mean = (F.col("value_1") + F.col("value_2")) / 2
    return a.join(b, F.col("first") < F.col("second")).select(
        F.concat("first", F.lit("_vs_"), "second").alias("pair"),
        "value_1",
        "value_2",
        (F.col("value_1") - F.col("value_2")).alias("difference"),
        F.when(F.col("value_2") == 0, 1.0).otherwise(F.col("value_1") / F.col("value_2")).alias("ratio"),
        F.when(mean == 0, 0.0).otherwise(F.abs(F.col("value_1") - F.col("value_2")) / mean * 100).alias("percent_difference"),
    )


def language_costs(stats: DataFrame, unit: str | None = None, by: Sequence[str] = LANGUAGE) -> DataFrame:
    """All tokens against all units of each language; without a unit a text counts as one."""
    n = F.lit(1) if unit is None else F.col(UNITS[unit])
    return stats.where("not_blank").groupBy(*by).agg((F.sum("n_tokens") / F.sum(n)).alias("cost"))


def gini_value(n: Column) -> Column:
    """The aggregate of gini() over costs that have their rank i among n."""
    total = F.sum("cost")
    return F.when((n < 2) | (total <= 0), 0.0).otherwise(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("cost")) / (n * total))


def gini(costs: DataFrame, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Fairness of the costs of a tokenizer's languages: 0 if all are equal.

    The closed form over sorted costs stands for the sum over all pairs.  Under two languages: 0 and a warning.
    """
    w = Window.partitionBy(*by)
    ranked = costs.select("*", F.row_number().over(w.orderBy("cost", "lang")).alias("i"), F.count("*").over(w).alias("n"))
    n = F.first("n")
    few = n < 2
    return ranked.groupBy(*by).agg(
        gini_value(n).alias("gini"),
        F.when(few, 0.0).otherwise(F.avg("cost")).alias("mean_cost"),
        F.when(few, 0.0).otherwise(F.stddev_pop("cost")).alias("std_cost"),
        F.min("cost").alias("min_cost"),
        F.max("cost").alias("max_cost"),
        F.when(F.min("cost") == 0, F.lit(float("inf"))).otherwise(F.max("cost") / F.min("cost")).alias("cost_ratio"),
        F.min_by("lang", F.struct("cost", "lang")).alias("most_efficient"),
        F.max_by("lang", F.struct("cost", "lang")).alias("least_efficient"),
        n.alias("languages"),
        F.when(few, F.lit("fewer than two languages")).alias("warning"),
    )


def gini_by_pairs(costs: DataFrame) -> DataFrame:
    """The same coefficient from all pairs of languages, as it is defined; for a few hundred languages."""
    a = costs.select("tokenizer", F.col("cost").alias("a"))
    b = costs.select("tokenizer", F.col("cost").alias("b"))
    spread = a.join(b, "tokenizer").groupBy("tokenizer").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("spread"))
    mean = costs.groupBy("tokenizer").agg(F.avg("cost").alias("mean"), F.count("*").alias("n"))
    return spread.join(mean, "tokenizer").select("tokenizer", F.when(F.col("mean") <= 0, 0.0).otherwise(F.col("spread") / (2 * F.col("n") * F.col("n") * F.col("mean"))).alias("gini"))


def lorenz(costs: DataFrame) -> DataFrame:
    """Points of the curve of each tokenizer, from (0, 0) to (1, 1), languages by rising cost; two languages at least."""
    w = Window.partitionBy("tokenizer")
    order = w.orderBy("cost", "lang")
    ranked = costs.select("*", F.row_number().over(order).alias("point"), F.count("*").over(w).alias("n"), F.sum("cost").over(w).alias("total"), F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run")).where("n > 1")
    points = ranked.select("tokenizer", "point", "lang", (F.col("point") / F.col("n")).alias("x"), (F.col("run") / F.col("total")).alias("y"))
    origin = ranked.select("tokenizer").distinct().select("tokenizer", F.lit(0).alias("point"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return points.unionByName(origin).withColumn("equality", F.col("x"))


def macro(values: DataFrame, value: str, by: Sequence[str] = TOKENIZER) -> DataFrame:
    """Mean over languages, population std and std / sqrt(n)."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.stddev_pop(value) / F.sqrt(F.count(value).cast("double"))).alias("std_err"), F.count(value).alias("count"))
