"""Common parts of the oracle queries."""

from __future__ import annotations

from glyphmeter.functions.text import WS

STANDARD = ("bytes", "pieces", "whitespace")
WS_RUN = f"[{WS}]+"
#: Word characters and punctuation, as RE2 sees them.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_RUN}'), lambda q: q <> '')"


def pieces(x: str) -> str:
    return f"regexp_extract_all({x}, '{PIECE}')"


def round6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


TOKENS = {
    "bytes": "regexp_extract_all(hex(encode(text)), '..')",
    "characters": "regexp_extract_all(text, '(?s).')",
    "pieces": pieces("text"),
    "trigrams": "regexp_extract_all(text, '(?s).{1,3}')",
    "whitespace": words("text"),
}


def tokens(names: tuple[str, ...] = STANDARD, source: str = "documents", keep: str = "lang, doc_id, text") -> str:
    """A CTE body: the tokenized table."""
    return " UNION ALL ".join(f"SELECT '{n}' AS tokenizer, {keep}, {TOKENS[n]} AS tokens FROM {source} WHERE text IS NOT NULL AND {strip('text')} <> ''" for n in names)


#: There are 256 bytes; other vocabularies are the tokens that the texts have.
SIZES = "SELECT tokenizer, CASE WHEN tokenizer = 'bytes' THEN 256 ELSE count(DISTINCT token) END::BIGINT AS vocab_size FROM counts GROUP BY tokenizer"
TOK = f"tok AS ({tokens()})"
STATS = f"""{TOK}, stats AS (SELECT tokenizer, lang, doc_id, len(tokens)::BIGINT AS n_tokens, length(text)::BIGINT AS n_chars, strlen(text)::BIGINT AS n_bytes,
 len({words("text")})::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM tok)"""
COUNTS = f"{TOK}, counts AS (SELECT tokenizer, lang, token, count(*) AS n FROM (SELECT tokenizer, lang, unnest(tokens) AS token FROM tok) GROUP BY ALL)"
TOTALS = f"{COUNTS}, total AS (SELECT tokenizer, token, sum(n)::BIGINT AS n FROM counts GROUP BY ALL)"
COSTS = f"{STATS}, costs AS (SELECT tokenizer, lang, sum(n_tokens)::DOUBLE / count(*) AS cost FROM stats GROUP BY ALL)"


def stats_of(x: str) -> str:
    return (
        f"round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round(stddev_pop({x}), 6) AS std, round(stddev_samp({x}) / sqrt(count({x})), 6) AS std_err, "
        f"round(min({x}), 6) AS min, round(max({x}), 6) AS max, count({x}) AS count, round(sum({x}), 4) AS sum"
    )


PAIRS = """SELECT a.tokenizer || '_vs_' || b.tokenizer AS pair, round(a.v, 6) AS value_1, round(b.v, 6) AS value_2, round(a.v - b.v, 6) AS difference,
 round(CASE WHEN b.v = 0 THEN 1.0 ELSE a.v / b.v END, 6) AS ratio, round(CASE WHEN a.v + b.v = 0 THEN 0.0 ELSE abs(a.v - b.v) / ((a.v + b.v) / 2) * 100 END, 6) AS percent_difference
 FROM vals a JOIN vals b ON a.tokenizer < b.tokenizer"""
#: Groups of languages: a language is in a family and in a size class.
GROUPS = """(VALUES ('family', 'germanic', 'en'), ('family', 'germanic', 'de'), ('family', 'romance', 'fr'), ('family', 'romance', 'es'),
 ('size', 'large', 'en'), ('size', 'medium', 'fr'), ('size', 'medium', 'de'), ('size', 'medium', 'es')) AS g(group_type, group_name, lang)"""
