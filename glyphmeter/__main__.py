"""python -m glyphmeter: compares tokenizers over texts by language and writes the results.

    python -m glyphmeter --tokenizers tokenizers.json --languages languages.json --output results
    python -m glyphmeter --tokenized store --output results

tokenizers.json: {name: path, or the name of an expression tokenizer, or {"path": ...}}.
languages.json: {"languages": {code: path or {"name", "data_path"}}, "analysis_groups": {type: {group: [codes]}}}.
normalization.json: the fields of functions.text.Normalization.  morph_score.json: {"by_split", "freq_scale",
"exclude_single_tok", "language_subset"}.  tables.json: {name: {"metrics": [..], "caption", "label"}}.
--samples FOLDER writes an example of each file.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from glyphmeter.functions.text import Normalization
from glyphmeter.operators.analysis import Analysis, Input
from glyphmeter.operators.groups import Languages
from glyphmeter.operators.reports import TABLES, latex, save_table, text_report, text_table
from glyphmeter.session import session
from glyphmeter.sources import lexicons, tokenized
from glyphmeter.sources.files import read_text, write_text
from glyphmeter.sources.texts import read_languages


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="glyphmeter", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--tokenizers", help="JSON file of tokenizers")
    p.add_argument("--languages", help="JSON file of languages and groups")
    p.add_argument("--tokenized", help="a store of tokenized texts instead of both")
    p.add_argument("--samples-per-language", type=int, default=2000)
    p.add_argument("--group", metavar="TYPE=NAME", help="only the languages of this group")
    p.add_argument("--only", nargs="+", help="only these tokenizers")
    p.add_argument("--unit", choices=["bytes", "characters", "words", "lines"], help="unit of costs and compression; a text counts as one without it")
    p.add_argument("--lexicons", help='JSON list of [name, kind, path]')
    p.add_argument("--grouped", action="store_true", help="measures by group of languages, too")
    p.add_argument("--latex", nargs="+", metavar="METRIC", help="a LaTeX table of these measures")
    p.add_argument("--latex-config", help="JSON file of more tables")
    p.add_argument("--normalization", help="JSON file: what a unit of text is, instead of --unit")
    p.add_argument("--morph-score", help="JSON file of options of the morpheme scores")
    p.add_argument("--samples", metavar="FOLDER", help="write sample files and stop")
    p.add_argument("--no-views", action="store_true", help="without the tables that plots draw")
    p.add_argument("--no-validation", action="store_true")
    p.add_argument("--save-tokenized", action="store_true")
    p.add_argument("--output", default="results")
    a = p.parse_args(argv)
    if a.samples:
        return write_samples(session(), a.samples)
    if bool(a.tokenized) == bool(a.tokenizers and a.languages):
        p.error("give --tokenized, or --tokenizers and --languages")
    spark = session()
    config = lambda path: json.loads(read_text(spark, path)) if path else {}
    unit = Normalization.from_dict(config(a.normalization)).unit.value if a.normalization else a.unit
    groups = None
    if a.tokenized:
        rows, vocab = tokenized.read_store(spark, a.tokenized)
        sizes = {r["tokenizer"]: r["vocab_size"] for r in tokenized.vocabulary_sizes(vocab).collect()}
        names = sorted(sizes)
        rows = rows if "doc_id" in rows.columns else rows.withColumn("doc_id", F.lit(None).cast("bigint"))
        inputs = [Input(n, rows=rows.where(F.col("tokenizer") == n), vocab_size=sizes[n], vocabulary=vocab.where(F.col("tokenizer") == n)) for n in names]
    else:
        langs = Languages.from_file(spark, a.languages)
        groups = langs.groups
        chosen = langs.select(*a.group.split("=", 1)) if a.group else None
        paths = {r["lang"]: r["data_path"] for r in langs.languages.where("data_path is not null").collect()}
        texts = read_languages(spark, paths, a.samples_per_language, chosen).select("lang", F.xxhash64("lang", "text_id").alias("doc_id"), "text")
        inputs = [Input(n, tokenizer=c if isinstance(c, str) else c["path"], texts=texts) for n, c in config(a.tokenizers).items()]
    if a.only:
        unknown = set(a.only) - {i.name for i in inputs}
        if unknown:
            p.error(f"unknown tokenizers: {sorted(unknown)}")
        inputs = [i for i in inputs if i.name in a.only]
    lexicon = lexicons.read_all(spark, [tuple(x) for x in config(a.lexicons)]) if a.lexicons else None
    analysis = Analysis(inputs, groups, lexicon, unit=unit, validate=not a.no_validation, morph_score=config(a.morph_score))
    analysis.save(a.output, views=not a.no_views)
    if a.grouped:
        for name, df in analysis.grouped().items():
            df.write.mode("overwrite").parquet(f"{a.output}/grouped_{name}")
    values = analysis.values().cache()
    if a.latex:
        save_table(latex(values, a.latex[0] if a.latex[0] in TABLES else a.latex), f"{a.output}/table.tex", spark)
    for name, table in config(a.latex_config).items():
        save_table(latex(values, table["metrics"], table.get("caption"), table.get("label")), f"{a.output}/{name}.tex", spark)
    if a.save_tokenized:
        tokenized.write_store(*analysis.encoded(), f"{a.output}/tokenized")
    print(text_report(values))
    if lexicon is not None:
        for title, result in (("Morphemes", "morphology_macro"), ("MorphScore", "morph_score_summary")):
            print("\n" + text_table(spark.read.parquet(f"{a.output}/{result}"), title))
    analysis.close()


def write_samples(spark, folder: str) -> None:
    """An example of each configuration file."""
    samples = {
        "tokenizers": {"words": "whitespace", "bpe": {"path": "tokenizers/bpe.json"}},
        "languages": {
            "languages": {"en": {"name": "English", "iso_code": "en", "data_path": "texts/en.txt"}, "fr": {"name": "French", "iso_code": "fr", "data_path": "texts/fr.jsonl"}},
            "analysis_groups": {"script": {"latin": ["en", "fr"]}, "size": {"large": ["en"], "medium": ["fr"]}},
        },
        "lexicons": [["first", "hyphenated", "lexicons/en.tsv"], ["second", "json", "lexicons/de.json"]],
        "normalization": {"unit": "words", "splitter": "pieces"},
        "morph_score": {"by_split": False, "freq_scale": True, "exclude_single_tok": False, "language_subset": None},
        "tables": {"short": {"metrics": ["fertility", "gini"], "caption": "Cost and fairness", "label": "tab:short"}},
    }
    for name, sample in samples.items():
        write_text(spark, f"{folder}/{name}.json", json.dumps(sample, indent=1) + "\n")


if __name__ == "__main__":
    main()
