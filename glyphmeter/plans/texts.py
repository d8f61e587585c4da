"""Text functions and tokenizers over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.functions import text as t
from glyphmeter.operators import tokenized as tk
from glyphmeter.operators.analysis import kept
from glyphmeter.plans import sql
from glyphmeter.plans.common import digest, tokens, totals
from glyphmeter.plans.registry import QUERIES, ORACLES, documents, query

_JOINED = "md5(array_to_string({}, '␟'))"


def _tokenizer_query(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tok = tk.tokenize(documents(spark, sf_dir), (name,))
        return tok.select("tokenizer", "lang", "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), digest(F.col("tokens")).alias("digest"))

    QUERIES[f"tokenize_{name}"] = run
    ORACLES[f"tokenize_{name}"] = f"WITH tok AS ({sql.tokens((name,))}) SELECT tokenizer, lang, doc_id, len(tokens)::BIGINT AS n_tokens, {_JOINED.format('tokens')} AS digest FROM tok"


for _name in tk.TOKENIZERS:
    _tokenizer_query(_name)


@query(
    f"""SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS characters, 1::BIGINT AS lines, len({sql.words("text")})::BIGINT AS words,
 len(string_split(text, ' '))::BIGINT AS spaces, len({sql.pieces("text")})::BIGINT AS pieces,
 len(list_filter(regexp_split_to_array(text, '{sql.WS_RUN}'), lambda q: {sql.strip("q")} <> ''))::BIGINT AS pattern_words,
 len(list_filter(regexp_split_to_array(text, '[,.]+'), lambda q: {sql.strip("q")} <> ''))::BIGINT AS custom_parts FROM documents WHERE text <> ''"""
)
def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to count units of a text."""
    text = F.col("text")
    kinds = {
        "bytes": t.BYTES,
        "characters": t.CHARACTERS,
        "lines": t.LINES,
        "words": t.WORDS,
        "spaces": t.Normalization(t.Unit.WORDS, keep_empty=True),
        "pieces": t.PIECES,
        "pattern_words": t.PATTERN_WORDS,
        "custom_parts": t.Normalization(t.Unit.WORDS, t.Splitter.CUSTOM, custom="[,.]+"),
    }
    return documents(spark, sf_dir).where(text != "").select("doc_id", *(n.count(text).alias(k) for k, n in kinds.items()))


@query(f"SELECT doc_id, (strlen(array_to_string({sql.pieces('text')}, '')) + len({sql.pieces('text')}))::BIGINT AS marked_bytes FROM documents WHERE text <> ''")
def marked_byte_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text <> ''").select("doc_id", t.MARKED_BYTES.count(F.col("text")).alias("marked_bytes"))


_TIDY = sql.strip("regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), chr(10) || ' +', chr(10), 'g'), ' +' || chr(10), chr(10), 'g')")


@query(f"SELECT doc_id, {_TIDY} AS tidy, array_to_string({sql.words('text')}, ' ') AS collapsed FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", t.tidy(text).alias("tidy"), t.collapse(text).alias("collapsed"))


def _parts_sql(parts: str) -> str:
    return f"SELECT doc_id, len(p)::BIGINT AS parts, {_JOINED.format('p')} AS digest FROM (SELECT doc_id, {parts} AS p FROM documents)"


def _long(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda q: {sql.strip('q')}), lambda q: length(q) >= 5)"


_PARAGRAPHS = f"CASE WHEN contains(text, chr(10) || chr(10)) THEN {_long('string_split(text, chr(10) || chr(10))')} ELSE []::VARCHAR[] END"
_LINES = _long("string_split(text, chr(10))")
_SENTENCES = _long(f"regexp_split_to_array(text, '[.!?]+[{t.WS}]+')")


def _chunks(size: str, most: int) -> str:
    return f"(list_filter(list_transform(range(1, greatest(length(text), 1) + 1, {size}), lambda i: {sql.strip(f'substr(text, i, {size})')}), lambda q: q <> ''))[1:{most}]"


def _parts(spark: SparkSession, sf_dir: str, how) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", how(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("bigint").alias("parts"), digest(F.col("p")).alias("digest"))


@query(_parts_sql(_PARAGRAPHS))
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t.paragraphs)


@query(_parts_sql(_LINES))
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t.lines)


@query(_parts_sql(_SENTENCES))
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t.sentences)


@query(_parts_sql(f"CASE WHEN length(text) <= 500 THEN [text] ELSE {_chunks('500', 100)} END"))
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t.chunks)


def _except(parts: str, seen: str) -> str:
    """The first occurrences among parts that aren't seen, in order."""
    return f"list_filter({parts}, lambda q, i: NOT list_contains({seen}, q) AND list_position({parts}, q) = i)"


@query(
    f"""WITH d AS (SELECT doc_id, {_TIDY} AS text FROM documents), s AS (SELECT doc_id, text, {_PARAGRAPHS} AS blocks, {_LINES} AS ls, {_SENTENCES} AS ss FROM d),
 l AS (SELECT *, CASE WHEN len(blocks) < 20 THEN list_concat(blocks, {_except("ls", "blocks")}) ELSE blocks END AS u FROM s),
 m AS (SELECT *, CASE WHEN len(u) < 10 THEN list_concat(u, {_except("ss", "u")}) ELSE u END AS v FROM l),
 c AS (SELECT *, CAST(least(500, length(text) // 20) AS BIGINT) AS w FROM m),
 p AS (SELECT doc_id, (CASE WHEN len(v) > 0 THEN v WHEN length(text) > 5 AND w > 0 THEN (CASE WHEN length(text) <= w THEN [text] ELSE {_chunks("greatest(w, 1)", 20)} END) ELSE []::VARCHAR[] END)[1:20] AS p FROM c)
 SELECT doc_id, len(p)::BIGINT AS parts, {_JOINED.format("p")} AS digest FROM p"""
)
def extract_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 text units of each tidied document by the fallback cascade."""
    return _parts(spark, sf_dir, lambda x: t.extract_units(t.tidy(x), 20))


@query(
    f"""WITH tok AS ({sql.tokens(("whitespace",))}), x AS (SELECT doc_id, tokens[1:64] AS cut FROM tok)
 SELECT doc_id, len(cut)::BIGINT AS kept, len(list_concat(cut, list_resize([]::VARCHAR[], 64 - len(cut), '<pad>')))::BIGINT AS padded,
 {_JOINED.format("list_concat(cut, list_resize([]::VARCHAR[], 64 - len(cut), '<pad>'))")} AS digest, len(cut)::BIGINT AS attended FROM x"""
)
def truncate_pad_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens cut or padded to 64, with the attention mask's sum."""
    cut = tokens(spark, sf_dir, ("whitespace",)).select("doc_id", tk.truncate(F.col("tokens"), 64).alias("cut"))
    padded = tk.pad(F.col("cut"), 64, F.lit("<pad>"))
    mask = F.aggregate(tk.attention_mask(F.col("cut"), 64), F.lit(0), lambda a, x: a + x)
    return cut.select("doc_id", F.size("cut").cast("bigint").alias("kept"), F.size(padded).cast("bigint").alias("padded"), digest(padded).alias("digest"), mask.cast("bigint").alias("attended"))


_VOCAB = f"{sql.TOK}, v AS (SELECT tokenizer, token, (dense_rank() OVER (PARTITION BY tokenizer ORDER BY token) - 1)::BIGINT AS token_id FROM (SELECT DISTINCT tokenizer, unnest(tokens) AS token FROM tok))"


@query(f"WITH {_VOCAB} SELECT tokenizer, token, token_id FROM v")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all tokens of each tokenizer."""
    return tk.vocabulary_of(totals(spark, sf_dir)).drop("n")


@query(f"WITH {_VOCAB} SELECT tokenizer, (max(token_id) + 1)::BIGINT AS vocab_size FROM v GROUP BY tokenizer")
def vocab_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least size of a vocabulary that holds every id."""
    return tk.least_sizes(totals(spark, sf_dir))


@query(f"WITH tok AS ({sql.tokens(('pieces',))}) SELECT tokenizer, doc_id, len(tokens)::BIGINT AS n_tokens, {_JOINED.format('tokens')} AS digest FROM tok")
def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids turned back to tokens: what was encoded comes back."""
    tok = tokens(spark, sf_dir, ("pieces",))
    vocab = kept(tk.vocabulary_of(tk.token_counts(tok, ("tokenizer",))))
    items = vocab.agg(F.sum("n")).first()[0] or 0
    decoded = tk.decode_ids(tk.encode_ids(tok, vocab, items=items), vocab, items=items)
    return decoded.select("tokenizer", "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), digest(F.col("tokens")).alias("digest"))


@query("SELECT source, split_part(source || '_' || lang, '_', 1) AS label, count(*) AS documents FROM documents GROUP BY ALL")
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels cut at the first underscore."""
    return documents(spark, sf_dir).groupBy("source", t.short_label(F.concat("source", F.lit("_"), "lang")).alias("label")).agg(F.count("*").alias("documents"))
