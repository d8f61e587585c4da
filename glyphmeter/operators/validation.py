"""Checks of tokenized tables: messages as rows, in one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERAGE_WARNING = 0.5
#: Parts by hash in which the first messages are sought.
PARTS = 1024


def summary(encoded: DataFrame) -> DataFrame:
    """tokenizer, entries, tokens, languages, min_id, max_id, negative_ids, empty_entries of (tokenizer, lang, token_ids)."""
    ids = F.col("token_ids")
    return encoded.groupBy("tokenizer").agg(
        F.count("*").alias("entries"),
        F.sum(F.size(ids)).alias("tokens"),
        F.countDistinct("lang").alias("languages"),
        F.min(F.array_min(ids)).cast("bigint").alias("min_id"),
        F.max(F.array_max(ids)).cast("bigint").alias("max_id"),
        F.sum(F.size(F.filter(ids, lambda x: x < 0))).alias("negative_ids"),
        F.sum((F.size(ids) == 0).cast("int")).alias("empty_entries"),
    )


def _message(test: Column, severity: str, text: Column) -> Column:
    return F.when(test, F.struct(F.lit(severity).alias("severity"), text.alias("message")))


def entries(encoded: DataFrame, vocab_sizes: DataFrame) -> DataFrame:
    """tokenizer, doc_id, severity, message for each thing that is wrong with an entry; offenders are shown five at most.

    vocab_sizes has a row per tokenizer and goes to every worker: a join by so few names would bring all texts of one to one task.
    """
    ids, rows = F.col("token_ids"), encoded.join(F.broadcast(vocab_sizes), "tokenizer", "left")
    show = lambda x: F.array_join(F.slice(x, 1, 5), ",")
    negative, over = F.filter(ids, lambda x: x < 0), F.filter(ids, lambda x: x >= F.col("vocab_size"))
    tests = [
        _message(F.col("tokenizer").isNull() | (F.col("tokenizer") == ""), "error", F.lit("no tokenizer name")),
        _message(F.col("lang").isNull() | (F.col("lang") == ""), "error", F.lit("no language")),
        _message(ids.isNull() | (F.size(ids) == 0), "error", F.lit("no tokens")),
        _message(F.size(negative) > 0, "error", F.concat(F.lit("negative ids: "), show(negative))),
        _message(F.size(over) > 0, "error", F.concat(F.lit("ids beyond the vocabulary: "), show(over))),
        _message(F.size(ids) > F.length("text"), "warning", F.lit("more tokens than characters")),
    ]
    # (outer: else Spark tests that the array isn't empty, and looks through the ids once more for that)
    found = rows.select("tokenizer", "doc_id", F.explode_outer(F.array(*tests)).alias("x")).where("x is not null")
    return found.select("tokenizer", "doc_id", "x.severity", "x.message")


def batch(encoded: DataFrame, vocab_sizes: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """severity, message of a whole batch: what entries() says of each, and what only all of them show.

    An empty batch, several tokenizers in it (warnings), languages that nobody expected (an error).
    """
    own = entries(encoded, vocab_sizes).select("severity", F.concat_ws(": ", F.concat_ws("/", "tokenizer", F.col("doc_id").cast("string")), "message").alias("message"))
    names, langs = F.array_sort(F.collect_set("tokenizer")), F.array_sort(F.collect_set("lang"))
    every = encoded.agg(F.count("*").alias("n"), names.alias("names"), langs.alias("langs"))
    odd = F.array_except("langs", F.array(*map(F.lit, languages)).cast("array<string>")) if languages is not None else F.array().cast("array<string>")
    tests = [
        _message(F.col("n") == 0, "warning", F.lit("an empty batch")),
        _message(F.size("names") > 1, "warning", F.concat(F.lit("several tokenizers: "), F.array_join("names", ","))),
        _message(F.size(odd) > 0, "error", F.concat(F.lit("unexpected languages: "), F.array_join(odd, ","))),
    ]
    return own.unionByName(every.select(F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")).select("x.severity", "x.message"))


def merge(*found: DataFrame) -> DataFrame:
    """severity, message of several validations as one."""
    out = found[0].select("severity", "message")
    for x in found[1:]:
        out = out.unionByName(x.select("severity", "message"))
    return out


def report(found: DataFrame) -> DataFrame:
    """One row: valid (no error), how many errors and warnings, and the first five of each by their text.

    The first five are taken in PARTS parts by hash, then of all parts: no task sorts all messages of a severity.
    """
    by = found.groupBy("severity", "message").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.hash("message"), F.lit(PARTS)))
    ranked = by.withColumn("k", F.row_number().over(Window.partitionBy("severity", "part").orderBy("message")))
    parts = ranked.groupBy("severity", "part").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("k") <= 5, F.col("message"))).alias("first"))
    of = lambda s, x: F.coalesce(F.sum(F.when(F.col("severity") == s, x)), F.lit(0))
    shown = lambda s: F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.col("severity") == s, F.col("first"))))), 1, 5)
    return parts.agg((of("error", F.col("n")) == 0).alias("valid"), of("error", F.col("n")).alias("errors"), of("warning", F.col("n")).alias("warnings"), shown("error").alias("first_errors"), shown("warning").alias("first_warnings"))


def require_valid(encoded: DataFrame, vocab_sizes: DataFrame) -> DataFrame:
    """encoded as it is, or ValueError with the first errors."""
    errors = entries(encoded, vocab_sizes).where("severity = 'error'").orderBy("tokenizer", "doc_id", "message").limit(5).collect()
    if errors:
        raise ValueError("; ".join(f"{r['tokenizer']}/{r['doc_id']}: {r['message']}" for r in errors))
    return encoded


def set_differences(have: DataFrame, want: DataFrame, column: str) -> DataFrame:
    """status (missing or extra) and value: what one side lacks."""
    missing = want.select(column).distinct().join(have, column, "left_anti").select(F.lit("missing").alias("status"), column)
    extra = have.select(column).distinct().join(want, column, "left_anti").select(F.lit("extra").alias("status"), column)
    return missing.unionByName(extra)


def coverage(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """tokenizer, covered, expected, ratio, warning: how many of the declared languages it has texts in."""
    expected = languages.agg(F.countDistinct("lang").alias("expected"))
    have = rows.join(F.broadcast(languages.select("lang").distinct()), "lang", "left_semi").groupBy("tokenizer").agg(F.countDistinct("lang").alias("covered"))
    ratio = F.col("covered") / F.col("expected")
    return have.crossJoin(expected).select("tokenizer", "covered", "expected", ratio.alias("ratio"), (ratio < COVERAGE_WARNING).alias("warning"))


def consistent(rows: DataFrame, name: str, languages: list[str]) -> DataFrame:
    """One row: whether all rows are of this tokenizer and of these languages, and none has null tokens."""
    return rows.agg(
        F.coalesce(F.every(F.col("tokenizer") == name), F.lit(True)).alias("same_tokenizer"),
        F.coalesce(F.every(F.col("lang").isin(languages)), F.lit(True)).alias("known_languages"),
        F.coalesce(F.every(F.col("tokens").isNotNull()), F.lit(True)).alias("has_tokens"),
    )


def renamed(rows: DataFrame, name: str) -> DataFrame:
    """Rows under the name they were given, whatever they call themselves."""
    return rows.withColumn("tokenizer", F.lit(name))
