"""A whole comparison: inputs to one tokenized table, every family of measures, groups, tables and results.

Nothing runs until a result is asked for; measures that share an intermediate share its plan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.functions import text as t
from glyphmeter.operators import groups as gr
from glyphmeter.operators import measures as ms
from glyphmeter.operators import morphology as mo
from glyphmeter.operators import reports as rp
from glyphmeter.operators import tokenized as tk
from glyphmeter.operators import validation as va


@dataclass(frozen=True)
class Input:
    """One tokenizer: either a tokenizer (the name of an expression, or a file) and texts, or tokenized rows.

    texts: lang, doc_id, text.  rows: lang, doc_id, text, tokens; a tokenizer column is overwritten by name.
    vocabulary: token_id, token, for rows whose tokens are ids.
    """

    name: str
    tokenizer: str | None = None
    texts: DataFrame | None = None
    rows: DataFrame | None = None
    vocab_size: int | None = None
    vocabulary: DataFrame | None = None

    def __post_init__(self) -> None:
        raw, done = self.tokenizer is not None and self.texts is not None, self.rows is not None
        if raw == done:
            raise ValueError(f"{self.name}: either a tokenizer and texts, or tokenized rows")
        if self.vocab_size is not None and self.vocab_size <= 0:
            raise ValueError(f"{self.name}: the size of the vocabulary must be positive")

    def tokenized(self) -> DataFrame:
        columns = ("tokenizer", "lang", "doc_id", "text", "tokens")
        if self.rows is not None:
            rows = va.renamed(self.rows, self.name)
        elif self.tokenizer in tk.TOKENIZERS:
            rows = va.renamed(tk.tokenize(self.texts, (self.tokenizer,)), self.name)
        else:
            rows = tk.encode_with_file(self.texts, self.tokenizer, self.name)
        return rows.select(*columns[:-1], F.col("tokens").cast("array<string>").alias("tokens"))

    def vocab(self, spark: SparkSession) -> DataFrame | None:
        """tokenizer, token_id, token: the strings of the ids, of a tokenizer file or as given; None if tokens are strings."""
        if self.vocabulary is not None:
            return self.vocabulary.select(F.lit(self.name).alias("tokenizer"), F.col("token_id").cast("bigint").alias("token_id"), "token")
        if self.tokenizer is None or self.tokenizer in tk.TOKENIZERS:
            return None
        from glyphmeter.sources.tokenizers import load

        return spark.createDataFrame([(self.name, i, x) for x, i in load(self.name, self.tokenizer).vocabulary().items()], "tokenizer string, token_id bigint, token string")

    def spelled(self) -> DataFrame:
        """tokenized() with the strings of the tokens, which words and morphemes are compared with; unknown ids are <UNK_id>."""
        rows = self.tokenized()
        vocab = self.vocab(rows.sparkSession)
        if vocab is None:
            return rows
        return tk.decode_ids(rows.withColumn("token_ids", numbers(F.col("tokens"))), vocab, keep=("lang", "text")).select("tokenizer", "lang", "doc_id", "text", "tokens")

    def size(self, tokenized: DataFrame) -> int | None:
        """The size as given, of the file, or one more than the greatest id; None if it is what the texts have."""
        if self.vocab_size is not None:
            return self.vocab_size
        if self.tokenizer in tk.TOKENIZERS:
            return tk.CLOSED.get(self.tokenizer)
        if self.tokenizer is not None:
            from glyphmeter.sources.tokenizers import load

            return load(self.name, self.tokenizer).vocab_size
        top = tokenized.select(F.max(F.array_max(numbers(F.col("tokens"))))).first()[0]
        return None if top is None else top + 1


class Analysis:
    """The measures of several inputs.  groups: group_type, group_name, lang; lexicon: see sources.lexicons.

    Entries with errors (see operators.validation) raise ValueError, unless validate is off.  Texts are tokenized once:
    statistics and counts are kept, in spark.checkpoint.dir if the session has one, until close().
    """

    def __init__(self, inputs: Sequence[Input], groups: DataFrame | None = None, lexicon: DataFrame | None = None, codes: DataFrame | None = None, unit: str | None = None, validate: bool = True, morph_score: Mapping[str, object] | None = None) -> None:
        names = [i.name for i in inputs]
        if not names or len(set(names)) != len(names):
            raise ValueError("inputs need different names")
        self.inputs, self.groups, self.lexicon, self.codes, self.unit = inputs, groups, lexicon, codes, unit
        self.options = dict(morph_score or {})
        self.tokenized = inputs[0].tokenized()
        for i in inputs[1:]:
            self.tokenized = self.tokenized.unionByName(i.tokenized())
        self.spark: SparkSession = self.tokenized.sparkSession
        given = self.spark.createDataFrame([(i.name, i.size(i.tokenized())) for i in inputs], "tokenizer string, vocab_size bigint")
        if validate:
            for i in inputs:
                if i.rows is not None:  # what was tokenized here is valid
                    ids = i.tokenized().withColumn("token_ids", numbers(F.col("tokens")))
                    va.require_valid(ids, given)
        self.stats = kept(tk.text_stats(self.tokenized))
        self.counts = kept(tk.token_counts(self.tokenized))
        self.total = tk.roll_up(self.counts)
        self.sizes = given.join(tk.vocabulary_sizes(self.total, {"": 0}).withColumnRenamed("vocab_size", "found"), "tokenizer", "left").select("tokenizer", F.coalesce("vocab_size", "found", F.lit(0)).alias("vocab_size"))

    def close(self) -> None:
        """Lets go of what was kept."""
        for df in (self.stats, self.counts):
            df.unpersist()

    def basic(self, fertility_unit: str = "words") -> dict[str, DataFrame]:
        return {
            "fertility": ms.fertility(self.stats, fertility_unit),
            "fertility_per_language": ms.fertility(self.stats, fertility_unit, ms.LANGUAGE),
            "fertility_pairs": ms.pairwise(ms.fertility(self.stats, fertility_unit)),
            "token_length": ms.token_length(self.stats),
            "vocabulary_utilization": ms.vocabulary_use(self.total, self.sizes),
            "vocabulary_utilization_per_language": ms.vocabulary_use(self.counts, self.sizes, ms.LANGUAGE),
            "type_token_ratio": ms.type_token_ratio(self.total),
            "type_token_ratio_per_language": ms.type_token_ratio(self.counts, ms.LANGUAGE),
            "tokens_per_line": ms.tokens_per_line(self.stats),
        }

    def information(self) -> dict[str, DataFrame]:
        unigram = ms.unigram(self.total)
        return {
            "compression": ms.compression(self.stats, self.unit),
            "compression_per_language": ms.compression(self.stats, self.unit, ms.LANGUAGE),
            "compression_pairs": ms.pairwise(ms.compression(self.stats, self.unit)),
            "renyi": ms.renyi(self.total),
            "renyi_per_language": ms.renyi(self.counts, ms.LANGUAGE),
            "unigram": unigram,
            "unigram_per_language": ms.unigram(self.counts, ms.LANGUAGE),
            "entropy_pairs": ms.pairwise(unigram, "entropy"),
            "token_rank_pairs": ms.pairwise(unigram, "avg_token_rank"),
        }

    def fairness(self) -> dict[str, DataFrame]:
        costs = ms.language_costs(self.stats, self.unit)
        return {"language_costs": costs, "gini": ms.gini(costs), "lorenz": ms.lorenz(costs)}

    def morphology(self) -> dict[str, DataFrame]:
        """Scores of words that the lexicon knows; none without one."""
        if self.lexicon is None:
            return {}
        spelled = self.inputs[0].spelled()
        for i in self.inputs[1:]:
            spelled = spelled.unionByName(i.spelled())
        words = mo.align_words(spelled).where(F.length("word") >= mo.LEAST_WORD)
        codes = self.codes if self.codes is not None else self.spark.createDataFrame([], "lang string, other string")
        scored = mo.full_scores(mo.lookup_morphemes(words.select("tokenizer", "lang", "word", "tokens"), self.lexicon, codes))
        summary = mo.summarise(scored)
        o = self.options
        split = "dataset" if o.get("by_split") and "dataset" in scored.columns else None
        score = mo.morph_score(scored, o.get("freq_scale", True), o.get("exclude_single_tok", False), split=split, languages=o.get("language_subset"))
        return {"morphology": summary, "morphology_macro": ms.macro(summary, "mean", ("tokenizer", "metric")), "morph_score": score, "morph_score_summary": mo.morph_score_summary(score)}

    def grouped(self, types: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """Every family by group of languages, all groups of all types in one job each; unknown types give nothing."""
        if self.groups is None:
            raise ValueError("grouped measures need groups of languages")
        groups = self.groups if types is None else self.groups.where(F.col("group_type").isin(list(types)))
        key = ("group_type", "group_name", "tokenizer")
        stats = gr.by_group(self.stats, groups)
        counts = gr.by_group(self.counts, groups).groupBy(*key, "token").agg(F.sum("n").alias("n"))
        out = {
            "fertility": ms.fertility(stats, by=key),
            "token_length": ms.token_length(stats, key),
            "tokens_per_line": ms.tokens_per_line(stats, key),
            "compression": ms.compression(stats, self.unit, key),
            "vocabulary_utilization": ms.vocabulary_use(counts, self.sizes, key),
            "type_token_ratio": ms.type_token_ratio(counts, key),
            "renyi": ms.renyi(counts, key),
            "unigram": ms.unigram(counts, key),
            "gini": ms.gini(gr.by_group(ms.language_costs(self.stats, self.unit), groups), key),
        }
        scores = self.morphology()
        if scores:
            by_language = gr.by_group(scores["morphology"], groups)
            out["morphology"] = ms.macro(by_language, "mean", (*key, "metric"))
            out["morph_score"] = gr.by_group(scores["morph_score"], groups).groupBy(*key).agg(*(F.avg(c).alias(c) for c in ("morphscore_recall", "morphscore_precision", "micro_f1", "macro_f1")))
        return out

    def encoded(self) -> tuple[DataFrame, DataFrame]:
        """All tokenized rows with ids for tokens, and the vocabularies: of files or as given, else of the tokens found."""
        rows, vocabs = [], []
        for i in self.inputs:
            own, vocab = i.tokenized(), i.vocab(self.spark)
            if vocab is None and i.rows is None:
                vocab = kept(tk.vocabulary(own))
                own = tk.encode_ids(own, vocab, keep=("lang", "text")).withColumnRenamed("token_ids", "tokens")
            else:
                own = own.withColumn("tokens", numbers(F.col("tokens")))
                top = own.agg(F.max(F.array_max("tokens"))).first()[0] if vocab is None else None
                vocab = vocab if vocab is not None else self.spark.range((top if top is not None else -1) + 1).select(F.lit(i.name).alias("tokenizer"), F.col("id").alias("token_id"), F.format_string("<token_%d>", "id").alias("token"))
            rows.append(own.select("tokenizer", "lang", "doc_id", "text", F.col("tokens").cast("array<int>").alias("tokens")))
            vocabs.append(vocab.select("tokenizer", F.col("token_id").cast("int").alias("token_id"), "token"))
        return rp.union_of(*rows, names=[[i.name] for i in self.inputs]), rp.union_of(*vocabs, names=[[i.name] for i in self.inputs])

    def summary(self) -> DataFrame:
        """tokenizer, vocab_size, languages, texts, tokens."""
        own = self.stats.groupBy("tokenizer").agg(F.countDistinct("lang").alias("languages"), F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
        return self.sizes.join(own, "tokenizer", "left").na.fill(0)

    def run(self) -> dict[str, DataFrame]:
        return {"summary": self.summary()} | self.basic() | self.information() | self.fairness() | self.morphology()

    def values(self) -> DataFrame:
        """Every measure as a tidy table, those of morphology too if there is a lexicon: means over languages."""
        out = rp.all_values(self.stats, self.counts, self.sizes)
        scores = self.morphology()
        if scores:
            f1 = scores["morphology_macro"].where("metric = 'f1'").select("tokenizer", F.lit("morph_f1").alias("metric"), F.col("mean").alias("value"), F.col("std_err").alias("error"))
            own = mo.morph_score_summary(scores["morph_score"]).where("tokenizer is not null")
            for name in ("morphscore_recall", "morphscore_precision"):
                f1 = f1.unionByName(own.select("tokenizer", F.lit(name).alias("metric"), F.col(f"avg_{name}").alias("value"), F.col(f"std_err_{name}").alias("error")))
            out = out.unionByName(f1)
        return out

    def save(self, folder: str, results: Mapping[str, DataFrame] | None = None, views: bool = True) -> None:
        """Each result and each view as Parquet; all measures per tokenizer, and all results by language and pair, as JSON."""
        results = self.run() if results is None else results
        drawn = rp.views(results, [i.name for i in self.inputs]) if views else {}
        for name, df in (results | {f"views/{n}": v for n, v in drawn.items()}).items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rp.save_json({r["tokenizer"]: json.loads(r["json"]) for r in rp.to_json(self.values()).collect()}, f"{folder}/analysis_results.json", self.spark)
        rp.save_json(rp.nested({n: self.spark.read.parquet(f"{folder}/{n}") for n in results}), f"{folder}/full_results.json", self.spark)


def numbers(tokens: Column) -> Column:
    """The tokens as ids; null for what is none."""
    return F.transform(tokens, lambda x: x.try_cast("bigint"))


def kept(df: DataFrame) -> DataFrame:
    """df computed once: in the session's checkpoint folder, which outlives executors, or in the executors' storage."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist()
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def texts_of(texts: Mapping[str, str | Sequence[str]], spark: SparkSession) -> DataFrame:
    """lang, doc_id, text from a mapping of language to one text or several."""
    rows = [(lang, text) for lang in sorted(texts) for text in ([texts[lang]] if isinstance(texts[lang], str) else texts[lang])]
    return spark.createDataFrame([(lang, i, text) for i, (lang, text) in enumerate(rows)], "lang string, doc_id bigint, text string").where(t.not_blank(F.col("text")))
