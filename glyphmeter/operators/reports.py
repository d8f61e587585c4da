"""Reports: the catalogue of measures, tidy values, pivots, best tokenizers, LaTeX and JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmeter.operators import measures as ms
from glyphmeter.operators.tokenized import CLOSED, roll_up
from glyphmeter.sources.files import write_text


@dataclass(frozen=True)
class Metric:
    name: str
    title: str
    lower_is_better: bool = False
    digits: int = 3
    factor: float = 1.0


CATALOG = (
    Metric("fertility", "Fertility", True),
    Metric("vocabulary_utilization", "Vocabulary Utilization (%)", factor=100.0, digits=1),
    Metric("type_token_ratio", "Type-Token Ratio", digits=4),
    Metric("renyi_1.0", "Shannon Entropy"),
    Metric("renyi_2.5", "Renyi Entropy (2.5)"),
    Metric("gini", "Fairness Gini", True),
    Metric("morph_f1", "Morpheme Boundary F1"),
    Metric("morphscore_recall", "MorphScore Recall"),
    Metric("morphscore_precision", "MorphScore Precision"),
    Metric("avg_token_rank", "Average Token Rank", True, 1),
    Metric("token_length", "Token Length"),
    Metric("avg_tokens_per_line", "Tokens per Line", digits=2),
    Metric("compression_rate", "Compression Rate", digits=4),
)
_BY_NAME = {m.name: m for m in CATALOG}


def _long(wide: DataFrame, values: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """tokenizer, metric, value, error from one column, or two, a metric."""
    cells = (F.struct(F.lit(n).alias("metric"), x.cast("double").alias("value"), (F.lit(None) if e is None else e).cast("double").alias("error")) for n, (x, e) in values.items())
    return wide.select("tokenizer", F.explode(F.array(*cells)).alias("x")).select("tokenizer", "x.*")


def all_values(stats: DataFrame, counts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """tokenizer, metric, value, error: every measure that needs no lexicon.

    The texts are measured once: sums by language give the means of all texts and the costs of languages.  Their tokens
    are counted once: the histogram of counts gives all measures of the distribution.  Without sizes, vocabularies are
    as tokenized.vocabulary_sizes has them.
    """
    n = F.col("n_words") > 0
    ratios = {"fertility": F.col("n_tokens") / F.col("n_words"), "token_length": F.col("n_chars") / F.col("n_tokens"), "avg_tokens_per_line": F.col("n_tokens") / F.col("n_lines"), "compression_rate": F.lit(1.0) / F.col("n_tokens")}
    parts = [x for m, r in ratios.items() for x in (F.count(F.when(n, r)).alias(f"{m}_n"), F.sum(F.when(n, r)).alias(f"{m}_s"), F.sum(F.when(n, r * r)).alias(f"{m}_q"))]
    by_language = stats.groupBy("tokenizer", "lang").agg(*parts, (F.sum(F.when(F.col("not_blank"), F.col("n_tokens"))) / F.count(F.when(F.col("not_blank"), 1))).alias("cost"))
    # one chain for both, the ranks of the costs beside the sums: else the texts would be measured for each
    own = Window.partitionBy("tokenizer")
    ranked = by_language.select("*", F.row_number().over(own.orderBy(F.asc_nulls_last("cost"), "lang")).alias("i"), F.count("cost").over(own).alias("n"))
    languages = F.first("n")
    sums = [F.sum(c).alias(c) for c in by_language.columns if c[-2:] in ("_n", "_s", "_q")]
    per_text = ranked.groupBy("tokenizer").agg(*sums, F.when(languages > 0, ms.gini_value(languages)).alias("gini"))

    def mean(m: str) -> tuple[Column, Column]:
        k, s, q = (F.col(f"{m}_{x}") for x in "nsq")
        return s / k, F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / k) / (k - 1))) / F.sqrt(k.cast("double")))

    texts = _long(per_text, {m: mean(m) for m in ratios} | {"gini": (F.col("gini"), None)}).where("metric <> 'gini' or value is not null")
    # all measures of the token distribution from one aggregate of its histogram of counts
    total = roll_up(counts)
    levels = total.groupBy("tokenizer", "n").agg(F.count("*").alias("k"))
    above = Window.partitionBy("tokenizer").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("tokenizer")
    r = levels.select("tokenizer", "n", "k", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("before"), F.sum(F.col("n") * F.col("k")).over(every).alias("total"))
    p = F.col("n") / F.col("total")
    spread = r.groupBy("tokenizer").agg(
        F.first("total").alias("tokens"),
        F.sum("k").alias("types"),
        (-F.sum(F.col("k") * p * F.log2(p))).alias("h1"),
        (F.log2(F.sum(F.col("k") * F.pow(p, F.lit(2.5)))) / F.lit(-1.5)).alias("h25"),
        (F.sum(F.col("n") * F.col("k") * (F.col("before") + (F.col("k") + 1) / 2)) / F.first("total")).alias("rank"),
    )
    if sizes is None:
        closed = F.coalesce(*(F.when(F.col("tokenizer") == name, F.lit(size)) for name, size in CLOSED.items()), F.col("types"))
        spread = spread.withColumn("vocab_size", closed)
    else:
        spread = spread.join(sizes, "tokenizer")
    of_spread = {"renyi_1.0": F.col("h1"), "renyi_2.5": F.col("h25"), "avg_token_rank": F.col("rank"), "type_token_ratio": F.col("types") / F.col("tokens"), "vocabulary_utilization": F.col("types") / F.col("vocab_size")}
    tokens = _long(spread, {m: (x, None) for m, x in of_spread.items()})
    return texts.unionByName(tokens)


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame([(m.name, m.title, m.lower_is_better, m.digits, m.factor) for m in CATALOG], "metric string, title string, lower_is_better boolean, digits int, factor double")


def best(values: DataFrame) -> DataFrame:
    """metric, best: the tokenizer with the best value, the first by name among equals."""
    known = values.join(catalogue(values.sparkSession), "metric")
    signed = F.when(F.col("lower_is_better"), F.col("value")).otherwise(-F.col("value"))
    return known.groupBy("metric").agg(F.min_by("tokenizer", F.struct(signed, F.col("tokenizer"))).alias("best"))


#: Measures of the usual tables; `comprehensive` has every one that has a value.
TABLES = {
    "basic": ("fertility", "vocabulary_utilization", "type_token_ratio", "gini"),
    "information": ("renyi_1.0", "avg_token_rank"),
    "morphological": ("morph_f1", "morphscore_recall", "morphscore_precision"),
    "comprehensive": tuple(_BY_NAME),
}


def by_language_view(values: DataFrame, value: str, tokenizers: Sequence[str]) -> DataFrame:
    """lang and a column per tokenizer; 0 where one has no value."""
    return values.groupBy("lang").pivot("tokenizer", list(tokenizers)).agg(F.first(value)).na.fill(0.0, list(tokenizers))


def grouped_view(values: DataFrame, value: str, tokenizers: Sequence[str]) -> DataFrame:
    """group_type, group_name and a column per tokenizer: grouped bars; 0 where one has no value."""
    return values.groupBy("group_type", "group_name").pivot("tokenizer", list(tokenizers)).agg(F.first(value)).na.fill(0.0, list(tokenizers))


def faceted_view(values: DataFrame, value: str) -> DataFrame:
    """tokenizer, position, lang, value: a facet per tokenizer, its languages in order of name."""
    position = F.row_number().over(Window.partitionBy("tokenizer").orderBy("lang")) - 1
    return values.select("tokenizer", position.alias("position"), "lang", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))


def views(results: Mapping[str, DataFrame], tokenizers: Sequence[str]) -> dict[str, DataFrame]:
    """The tables that the usual plots draw, of those results that there are: bars, by language, faceted, by group."""
    bars = {"fertility": "mean", "token_length": "mean", "compression": "mean", "vocabulary_utilization": "utilization", "type_token_ratio": "ttr", "gini": "gini"}
    out = {f"{m}_bars": with_reference(results[m].select("tokenizer", F.col(c).alias("value"))) for m, c in bars.items() if m in results}
    if "lorenz" in results:
        out["lorenz"] = thin(results["lorenz"], "tokenizer", ("point",))
    for m, c in bars.items():
        if f"{m}_per_language" in results:
            out[f"{m}_by_language"] = by_language_view(results[f"{m}_per_language"], c, tokenizers)
            out[f"{m}_facets"] = faceted_view(results[f"{m}_per_language"], c)
        if f"grouped_{m}" in results:
            out[f"{m}_by_group"] = grouped_view(results[f"grouped_{m}"], c, tokenizers)
    if "language_costs" in results:
        out["costs_by_language"] = by_language_view(results["language_costs"], "cost", tokenizers)
    return out


def show(items: Column, total: Column | None = None, most: int = 5) -> Column:
    """The first items of a list, with how many there are if that is more."""
    n = F.size(items) if total is None else total
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(n > most, F.concat(head, F.lit(f"... (showing {most}/"), n.cast("string"), F.lit(")"))).otherwise(head)


def pivot(values: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return values.groupBy("tokenizer").pivot("metric", list(metrics)).agg(F.first("value"))


def with_reference(values: DataFrame, positive_only: bool = False) -> DataFrame:
    mean = values.where("value > 0") if positive_only else values
    return values.crossJoin(mean.agg(F.avg("value").alias("reference")))  # one row


def thin(rows: DataFrame, by: str, order: Sequence[str], most: int = 100, points: int = 50) -> DataFrame:
    """Series of more than `most` rows reduced to every (n / points)-th."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("__pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / points))
    return numbered.where((F.col("__n") <= most) | (F.col("__pos") % step == 0)).drop("__pos", "__n")


def union_of(*tables: DataFrame, names: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Tokenized tables as one; a tokenizer may be in one of them only.

    names: the tokenizers of each table, where they are known; else they are read from it.
    """
    seen: set[str] = set()
    for k, t in enumerate(tables):
        own = set(names[k]) if names is not None else {r[0] for r in t.select("tokenizer").distinct().collect()}
        if seen & own:
            raise ValueError(f"several tables have the tokenizers {sorted(seen & own)}")
        seen |= own
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def wrap_title(title: str, width: int = 15) -> str:
    lines, line = [], ""
    for word in title.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    lines.append(line)
    return lines[0] if len(lines) == 1 else r"\makecell{" + r" \\ ".join(lines) + "}"


def latex_rows(values: DataFrame, metrics: Sequence[str], caption: str | None = None, label: str | None = None) -> DataFrame:
    """line, text: the table of latex(), one row a line, with the best value bold and without errors."""
    lines = latex(values, metrics, caption, label)
    return values.sparkSession.createDataFrame(list(enumerate(lines)), "line int, text string")


def latex(values: DataFrame, metrics: Sequence[str], caption: str | None = None, label: str | None = None, errors: bool = False, bold: bool = True) -> list[str]:
    """The table's lines; unknown measures are left out, missing values are dashes, the best is bold.

    metrics: names, or the name of one of TABLES.  Measures that no tokenizer has are left out of `comprehensive`.
    """
    every = metrics == "comprehensive"
    shown = [_BY_NAME[m] for m in (TABLES[metrics] if isinstance(metrics, str) else metrics) if m in _BY_NAME]
    got = {(r["tokenizer"], r["metric"]): (r["value"], r["error"]) for r in values.where(F.col("metric").isin([m.name for m in shown])).collect()}
    names = sorted({t for t, _ in got})
    if every:
        shown = [m for m in shown if any(got.get((t, m.name), (None,))[0] is not None for t in names)]
    top = {m.name: (min if m.lower_is_better else max)((got[t, m.name][0], t) for t in names if (t, m.name) in got and got[t, m.name][0] is not None)[0] for m in shown if any((t, m.name) in got for t in names)}

    def cell(t: str, m: Metric) -> str:
        value, error = got.get((t, m.name), (None, None))
        if value is None:
            return "---"
        text = f"{value * m.factor:.{m.digits}f}"
        if errors and error is not None:
            text += rf" {{\footnotesize $\pm$ {error:.{m.digits}f}}}"
        return rf"\textbf{{{text}}}" if bold and value == top[m.name] else text

    body = [r"\begin{tabular}{l" + "c" * len(shown) + "}", r"\toprule", " & ".join(["Tokenizer", *(wrap_title(m.title) for m in shown)]) + r" \\", r"\midrule"]
    body += [" & ".join([t.replace("_", r"\_"), *(cell(t, m) for m in shown)]) + r" \\" for t in names]
    body += [r"\bottomrule", r"\end{tabular}"]
    if caption or label:
        body = [r"\begin{table}[htbp]", r"\centering", *body, *([rf"\caption{{{caption}}}"] if caption else []), *([rf"\label{{{label}}}"] if label else []), r"\end{table}"]
    return body


def to_json(values: DataFrame) -> DataFrame:
    """tokenizer, json: its measures as one object."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.col("value").cast("decimal(38,6)").alias("value")))))
    return values.groupBy("tokenizer").agg(F.to_json(pairs).alias("json"))


def nested(results: Mapping[str, DataFrame]) -> dict:
    """All results as one object: result -> tokenizer (or pair) -> language, group or point -> figures.

    Results are aggregates, of tokenizers by languages or groups.  Lorenz curves of over 100 points are thinned to about 50.
    """
    out: dict = {}
    for name, df in results.items():
        kept = thin(df, "tokenizer", ("point",)) if "point" in df.columns else df
        keys = [c for c in ("pair", "tokenizer", "group_type", "group_name", "lang", "metric", "alpha", "point") if c in kept.columns]
        for row in kept.orderBy(*keys).collect():
            at = out.setdefault(name, {})
            for c in keys:
                at = at.setdefault("all" if row[c] is None else str(row[c]), {})
            at.update({c: row[c] for c in kept.columns if c not in keys})
    return out


def save_json(data: object, path: str, spark) -> None:
    write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=1, default=str))


def save_table(lines: Sequence[str], path: str, spark=None) -> None:
    write_text(spark, path, "\n".join(lines) + "\n")


def select_tokenizers(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values of these tokenizers only; ValueError for one that there isn't."""
    known = {r[0] for r in values.select("tokenizer").distinct().collect()}
    if set(names) - known:
        raise ValueError(f"unknown tokenizers: {sorted(set(names) - known)}")
    return values.where(F.col("tokenizer").isin(list(names)))


def text_table(df: DataFrame, title: str) -> str:
    """A small result as plain text, in columns, sorted by its own."""
    rows = sorted((tuple("---" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()))
    widths = [max(map(len, c)) for c in zip(df.columns, *rows)]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in (df.columns, *rows)]
    return "\n".join([title, "-" * len(title), *lines])


def text_report(values: DataFrame) -> str:
    """All values as plain text, a tokenizer after the other."""
    rows = sorted((r["tokenizer"], r["metric"], r["value"]) for r in values.collect())
    out, last = [], None
    for tokenizer, metric, value in rows:
        if tokenizer != last:
            out += ["" if last is None else "", tokenizer, "-" * len(tokenizer)]
            last = tokenizer
        out.append(f"{_BY_NAME[metric].title if metric in _BY_NAME else metric:<28} " + ("---" if value is None else f"{value:.4f}"))
    return "\n".join(out).lstrip("\n")
