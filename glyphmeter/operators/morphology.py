"""Tokens against words and morphemes.

Positions and folds inside one word are array expressions; the rare word whose tokens don't spell it is
aligned by an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from glyphmeter.functions.text import clean_tokens, split_words, strip_punctuation

WORD_STARTS = ("Ġ", " ")
NO_PUNCTUATION = r'[^.,!?;:"()\[\]{}]'
LEAST_WORD = 2
#: Special tokens as clean_marker knows them: Java's . is no line end, and its $ may be before one.
_ENDS = r"\n\r\x{85}\x{2028}\x{2029}"
SPECIAL = rf"^(?:<\||\[)[^{_ENDS}]*(?:\|>|\])(?:\r\n|[{_ENDS}])?$"
SCORES = ("precision", "recall", "f1", "preservation", "over_segmentation")


def ends(parts: Column) -> Column:
    """The end position of each part in their concatenation."""
    add = lambda found, x: F.concat(found, F.array(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0)) + F.length(x)))
    return F.aggregate(parts, F.array().cast("array<int>"), add)


def spans(parts: Column) -> Column:
    """start and end of each part."""
    return F.arrays_zip(F.transform(parts, lambda x, i: x).alias("part"), ends(parts).alias("end"))


def inner(parts: Column) -> Column:
    """The boundaries between parts."""
    return F.slice(ends(parts), 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def boundary_scores(found: Column, true: Column, tokens: Column, morphemes: Column) -> Column:
    """precision, recall, f1 of boundaries, share of morphemes that are tokens, and over-segmentation."""
    tp = F.size(F.array_intersect(found, true)).cast("double")
    nf, nt = F.size(F.array_distinct(found)), F.size(F.array_distinct(true))
    precision = F.when(nf > 0, tp / nf).otherwise(0.0)
    recall = F.when(nt > 0, tp / nt).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    kept = F.size(F.filter(morphemes, lambda m: F.array_contains(tokens, m)))
    k, m = F.size(tokens), F.size(morphemes)
    over = F.when(m > 0, F.greatest(k - m, F.lit(0)) / m).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.when(m > 0, kept / m).otherwise(0.0).alias("preservation"), over.alias("over_segmentation"))


def direct_scores(words: DataFrame) -> DataFrame:
    """words (word, tokens, morphemes, ...) with scores, for tokens and morphemes that spell the word."""
    cleaned = words.withColumn("tokens", clean_tokens(F.col("tokens"))).where("size(tokens) > 0 and size(morphemes) > 0")
    spells = (F.lower(F.array_join("tokens", "")) == F.lower("word")) & (F.lower(F.array_join("morphemes", "")) == F.lower("word"))
    found, true = inner(F.col("tokens")), inner(F.col("morphemes"))
    return cleaned.where(spells).withColumn("scores", boundary_scores(found, true, F.col("tokens"), F.col("morphemes"))).select("*", "scores.*").drop("scores")


# -- the whole path, one word at a time ---------------------------------------------------------------
def _valid(found: list[tuple[int, int]], length: int) -> bool:
    last = 0
    for a, b in found:
        if not 0 <= a < b <= length or a < last:
            return False
        last = b
    return True


def _even(n: int, length: int) -> list[tuple[int, int]]:
    return [(int(i * length / n), int((i + 1) * length / n)) for i in range(n)] if n > 1 else [(0, length)]


def token_spans(word: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Where each token lies in the word: exactly, or greedily found, or evenly spread."""
    low, at, out = word.lower(), 0, []
    if "".join(tokens).lower() == low:
        for x in tokens:
            out.append((at, at + len(x)))
            at += len(x)
        return out
    for x in tokens:
        k = low.find(x.lower(), at)
        a, b = (k, k + len(x)) if k >= 0 else (at, min(at + len(x), len(word)))
        out.append((a, b))
        at = b
    return out if _valid(out, len(word)) else _even(len(tokens), len(word))


def morpheme_spans(word: str, morphemes: list[str]) -> list[tuple[int, int]]:
    """As token_spans; morphemes that aren't found are left out."""
    low, at, out = word.lower(), 0, []
    if "".join(morphemes).lower() == low:
        return token_spans(word, morphemes)
    for m in morphemes:
        k = low.find(m.lower(), at)
        if k >= 0 and m:
            out.append((k, k + len(m)))
            at = k + len(m)
    return out if out and _valid(out, len(word)) else _even(len(morphemes), len(word))


def full_scores(words: DataFrame) -> DataFrame:
    """words (word, tokens, morphemes, ...) with scores, whether or not tokens spell the word.

    A batch is scored at once over its flat arrays; only words that tokens or morphemes don't spell exactly are aligned
    one at a time.
    """
    schema = StructType([*words.schema.fields, *(StructField(n, DoubleType()) for n in SCORES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scored(batch)

    return words.where("size(tokens) > 0 and size(morphemes) > 0").mapInArrow(run, schema)


def _scored(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a batch that have cleaned tokens and morphemes, with SCORES."""
    lists = batch.column("tokens")
    tokens = _cleaned(lists.flatten(), SPECIAL)
    has = pc.fill_null(pc.not_equal(tokens, ""), False)
    at = np.concatenate(([0], np.cumsum(has.to_numpy(zero_copy_only=False))))[_bounds(lists)]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), tokens.filter(has))
    batch = batch.set_column(batch.schema.get_field_index("tokens"), "tokens", lists.cast(batch.schema.field("tokens").type))
    batch = batch.filter(pa.array(np.diff(at) > 0))
    word, size = batch.column("word"), batch.num_rows
    flat = [batch.column(c).flatten() for c in ("tokens", "morphemes")]
    k, m = counts = [pc.list_value_length(batch.column(c)).to_numpy() for c in ("tokens", "morphemes")]
    rows = [np.repeat(np.arange(size), n) for n in counts]
    # where the parts spell the word as it is written, their ends are running sums
    lengths = [pc.fill_null(pc.utf8_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in flat]
    spells = [pc.fill_null(pc.equal(pc.binary_join(batch.column(c), ""), word), False).to_numpy(zero_copy_only=False) for c in ("tokens", "morphemes")]
    spells[1] &= np.bincount(rows[1], lengths[1] == 0, size) == 0
    other = np.flatnonzero(~(spells[0] & spells[1]))
    bounds = []
    for part in (0, 1):
        sums, first = np.cumsum(lengths[part]), np.concatenate(([0], np.cumsum(counts[part])))
        end = sums - np.concatenate(([0], sums))[first[:-1]][rows[part]]
        inside = np.ones(len(end), np.bool_)
        inside[first[1:] - 1] = False
        inside[np.isin(rows[part], other)] = False
        bounds.append([rows[part][inside] << 32 | end[inside]])
    if len(other):
        rest = batch.take(pa.array(other))
        for row, w, ts, ms in zip(other, *(rest.column(c).to_pylist() for c in ("word", "tokens", "morphemes"))):
            for part, found in enumerate((token_spans(w, ts), morpheme_spans(w, ms))):
                bounds[part].append(np.array(sorted({b for _, b in found} - {len(w)}), np.int64) | (int(row) << 32))
    found, true = (np.concatenate(x) for x in bounds)
    per_row = lambda keys: np.bincount(keys >> 32, minlength=size)
    tp, nf, nt = per_row(found[np.isin(found, true)]), per_row(found), per_row(true)
    same = pa.concat_arrays([x.cast(pa.string()) for x in flat]).dictionary_encode()
    code, kinds = same.indices.fill_null(-1).to_numpy(), len(same.dictionary)
    is_token, is_morpheme = rows[0] * kinds + code[: len(rows[0])], rows[1] * kinds + code[len(rows[0]) :]
    kept = np.bincount(rows[1][np.isin(is_morpheme, is_token) & (code[len(rows[0]) :] >= 0)], minlength=size)
    share = lambda a, b: np.divide(a, b, out=np.zeros(size), where=b > 0)
    precision, recall = share(tp, nf), share(tp, nt)
    scores = (precision, recall, share(2 * precision * recall, precision + recall), share(kept, m), share(np.maximum(k - m, 0), m))
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores)], [*batch.schema.names, *SCORES])


# -- words and tokens of whole texts ------------------------------------------------------------------
def align_words(tokenized: DataFrame) -> DataFrame:
    """tokenizer, lang, doc_id, word_index, word, tokens: which tokens make up each word of the text.

    A token that starts with a word-start mark begins a group; a group that is only punctuation joins its
    predecessor; groups and words go together by index, and tokens left over belong to the last word.

    A text's words and tokens are folded where they are, batch by batch: nothing is shuffled.  Texts without words, and
    words without tokens, give no rows.
    """
    key = ["tokenizer", "lang", "doc_id"]
    source = tokenized.select(*key, F.transform(split_words(F.lower("text")), strip_punctuation).alias("words"), "tokens")
    kinds = [source.schema[c] for c in key]
    schema = StructType([*kinds, StructField("word_index", IntegerType()), StructField("word", StringType()), StructField("tokens", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in ("words", "tokens"):
                batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(column)), 0), 0))
            if batch.num_rows:
                yield _fold(batch, key)

    return source.mapInArrow(run, schema)


def _bounds(lists: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))


def _fold(batch: pa.RecordBatch, key: list[str]) -> pa.RecordBatch:
    """The rows of align_words of a batch of texts that have words and tokens."""
    words, tokens = batch.column("words").flatten(), batch.column("tokens").flatten()
    word_at, token_at = _bounds(batch.column("words")), _bounds(batch.column("tokens"))
    starts = np.zeros(len(tokens), np.bool_)
    for mark in WORD_STARTS:
        starts |= pc.fill_null(pc.starts_with(tokens, mark), False).to_numpy(zero_copy_only=False)
    starts[token_at[:-1]] = True
    group = np.flatnonzero(starts)  # the first token of each group
    row = np.searchsorted(token_at, group, "right") - 1
    says = np.logical_or.reduceat(pc.fill_null(pc.match_substring_regex(_cleaned(tokens), NO_PUNCTUATION), False).to_numpy(zero_copy_only=False), group)
    counts = says | (group == token_at[row])  # groups that begin a word
    order = np.cumsum(counts)
    index = np.minimum(order - order[np.searchsorted(group, token_at[:-1])][row], np.diff(word_at)[row] - 1)
    heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (index[1:] != index[:-1]))))
    of = pa.array(row[heads])
    found = pa.ListArray.from_arrays(pa.array(np.append(group[heads], len(tokens)), pa.int32()), tokens)
    columns = [batch.column(c).take(of) for c in key]
    return pa.RecordBatch.from_arrays([*columns, pa.array(index[heads], pa.int32()), words.take(pa.array(word_at[row[heads]] + index[heads])), found], [*key, "word_index", "word", "tokens"])


def _cleaned(tokens: pa.Array, special: str = r"(?s)^(<\||\[).*(\|>|\])$") -> pa.Array:
    """clean_marker of each token."""
    start = pc.match_substring_regex(tokens, "^[Ġ▁ ]")
    more, end, split = pc.starts_with(tokens, "##"), pc.ends_with(tokens, "</w>"), pc.ends_with(tokens, "@@")
    special = pc.match_substring_regex(tokens, special)
    cut = lambda a, b: pc.utf8_slice_codeunits(tokens, a, b)
    return pc.case_when(pc.make_struct(start, more, end, split, special), cut(1, None), cut(2, None), cut(0, -4), cut(0, -2), pa.array([""] * len(tokens)), tokens)


def lookup_morphemes(words: DataFrame, lexicon: DataFrame, codes: DataFrame) -> DataFrame:
    """words with morphemes (and their dataset, if the lexicon names it): those of the first priority that has the lower-cased word.

    A language that the lexicon lacks is looked up under its other code (codes: lang, other).
    """
    have = lexicon.select("lang").distinct()
    best = lexicon.groupBy("lang", F.lower("word").alias("low")).agg(*(F.min_by(c, "priority").alias(c) for c in ("morphemes", "dataset") if c in lexicon.columns))
    known = codes.join(have, codes.other == have.lang, "left_semi").groupBy(codes.lang).agg(F.min("other").alias("other"))
    names = words.select("lang").distinct().join(have.withColumn("own", F.lit(True)), "lang", "left").join(known, "lang", "left")
    names = names.select("lang", F.when(F.col("own"), F.col("lang")).otherwise(F.col("other")).alias("in_lexicon"))
    renamed = best.withColumnRenamed("lang", "in_lexicon")
    return words.join(F.broadcast(names), "lang").withColumn("low", F.lower("word")).join(renamed, ["in_lexicon", "low"]).drop("in_lexicon", "low")


def infer_morphemes(base: Column, derived: Column, process: Column) -> Column:
    """[base, suffix], [prefix, base], [stem, rest] or [derived], from a derivation base -> derived.

    Where both begin alike and the longer derived ends as base goes on, what lies between is taken for the prefix.
    """
    b, d = F.lower(base), F.lower(derived)
    common = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(b), F.length(d)), F.lit(1))), lambda i: F.substring(b, F.lit(1), i) == F.substring(d, F.lit(1), i)))
    common = F.when((F.length(b) == 0) | (F.length(d) == 0), F.lit(0)).otherwise(common)
    after = lambda s, n: F.substring(s, n + 1, F.lit(1 << 30))
    return (
        F.when(d.startswith(b) & (F.length(d) > F.length(b)), F.array(b, after(d, F.length(b))))
        .when(b.startswith(d), F.array(d))
        .when(d.endswith(b), F.array(F.substring(d, F.lit(1), F.length(d) - F.length(b)), b))
        .when((common > 0) & (F.length(d) > F.length(b)) & after(d, common).endswith(after(b, common)), F.array(F.substring(d, common + 1, F.length(d) - F.length(b)), b))
        .when((common > 0) & (common < F.length(d)), F.array(F.substring(d, F.lit(1), common), after(d, common)))
        .otherwise(F.array(d))
    )


def summarise(scored: DataFrame) -> DataFrame:
    """tokenizer, lang, metric: count, mean and population std of each score."""
    figures = [F.struct(F.lit(n).alias("metric"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")) for n in SCORES]
    wide = scored.groupBy("tokenizer", "lang").agg(F.count("*").alias("count"), F.array(*figures).alias("x"))
    return wide.select("tokenizer", "lang", "count", F.explode("x").alias("x")).select("tokenizer", "lang", "x.metric", "count", "x.mean", "x.std")


MORPH_SCORES = ("morphscore_recall", "morphscore_precision", "micro_f1", "macro_f1")


def morph_score(scored: DataFrame, weighted: bool = True, exclude_single: bool = False, times: str | None = None, split: str | None = None, languages: Sequence[str] | None = None) -> DataFrame:
    """tokenizer, lang: recall, precision, micro and macro F1 of boundaries over word types, by frequency if weighted.

    times: the column that says how often a row counts (once without it).  split: the column by whose values the scores
    are given apart.  languages: only these, by either of their codes (see to_long_codes).
    """
    rows = scored.where("size(tokens) > 1") if exclude_single else scored
    if languages is not None:
        rows = rows.where(F.col("lang").isin([x for lang in languages for x in {lang, LONG_CODES.get(lang, lang)}]))
    by = ["tokenizer", "lang", *([split] if split else [])]
    n = F.sum(times) if times else F.count("*")
    types = rows.groupBy(*by, "word", "tokens", "morphemes", "precision", "recall", "f1").agg(n.alias("n"))
    w = F.col("n").cast("double") if weighted else F.lit(1.0)
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    p, r = mean("precision"), mean("recall")
    return types.groupBy(*by).agg(r.alias("morphscore_recall"), p.alias("morphscore_precision"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("micro_f1"), mean("f1").alias("macro_f1"), F.count("*").alias("num_samples"))


#: Two-letter codes and the codes of language and script that collections of parallel texts use.
LONG_CODES = dict(
    pair.split(":")
    for pair in (
        "af:afr_Latn ar:arb_Arab bg:bul_Cyrl bn:ben_Beng ca:cat_Latn cs:ces_Latn da:dan_Latn de:deu_Latn el:ell_Grek en:eng_Latn es:spa_Latn et:est_Latn eu:eus_Latn fa:pes_Arab fi:fin_Latn "
        "fr:fra_Latn ga:gle_Latn gu:guj_Gujr he:heb_Hebr hi:hin_Deva hr:hrv_Latn hu:hun_Latn hy:hye_Armn id:ind_Latn is:isl_Latn it:ita_Latn ja:jpn_Jpan ka:kat_Geor kk:kaz_Cyrl ko:kor_Hang "
        "lt:lit_Latn lv:lvs_Latn mk:mkd_Cyrl ml:mal_Mlym mr:mar_Deva nl:nld_Latn no:nob_Latn pl:pol_Latn pt:por_Latn ro:ron_Latn ru:rus_Cyrl sk:slk_Latn sl:slv_Latn sq:als_Latn sr:srp_Cyrl "
        "sv:swe_Latn sw:swh_Latn ta:tam_Taml te:tel_Telu th:tha_Thai tr:tur_Latn uk:ukr_Cyrl ur:urd_Arab uz:uzn_Latn vi:vie_Latn xh:xho_Latn yo:yor_Latn zh:zho_Hans zu:zul_Latn"
    ).split()
)


def to_long_codes(lang: Column) -> Column:
    """The long code of a language; one that isn't listed stays as it is."""
    codes = F.create_map(*(F.lit(x) for pair in LONG_CODES.items() for x in pair))
    return F.coalesce(codes[lang], lang)


def morph_score_summary(scores: DataFrame) -> DataFrame:
    """tokenizer: unweighted means over languages, their population std and standard error, languages and samples.

    One more row, with a null tokenizer, has the unweighted means over tokenizers.
    """
    stats = [x for c in MORPH_SCORES for x in (F.avg(c).alias(f"avg_{c}"), F.stddev_pop(c).alias(f"std_{c}"), (F.stddev_pop(c) / F.sqrt(F.count(c).cast("double"))).alias(f"std_err_{c}"))]
    own = scores.groupBy("tokenizer").agg(F.count("*").alias("languages_evaluated"), F.sum("num_samples").alias("total_samples"), *stats)
    every = own.agg(F.max("languages_evaluated").alias("languages_evaluated"), F.sum("total_samples").alias("total_samples"), *(F.avg(f"avg_{c}").alias(f"avg_{c}") for c in MORPH_SCORES))
    return own.unionByName(every.where("languages_evaluated is not null"), allowMissingColumns=True)
