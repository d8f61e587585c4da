"""The tokenized table and the two intermediates that every measure is computed from.

tokenized:    tokenizer, lang, doc_id, text, tokens (array<string>)
text_stats:   one row per tokenizer and text: n_tokens, n_chars, n_bytes, n_words, n_lines, not_blank
token_counts: tokenizer, lang, token, n

Texts are scanned once for all tokenizers: each row becomes an array of (tokenizer, tokens), exploded.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from glyphmeter.functions import text as t

#: Tokenizers that are expressions, and the sizes of their vocabularies.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "bytes": t.byte_tokens,
    "characters": t.characters,
    "pieces": t.pieces,
    "trigrams": t.trigrams,
    "whitespace": t.split_words,
}
#: How many tokens each gives, where that needs no list of them.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "bytes": F.octet_length,
    "characters": F.length,
    "trigrams": lambda text: F.ceil(F.length(text) / 3),
}
#: Those whose vocabulary is the same for every corpus; the others' is what they find (see vocabulary_sizes).
CLOSED = {"bytes": 256, "characters": 1114112}
#: Those that the standard reports compare.
STANDARD = ("bytes", "pieces", "whitespace")
#: A vocabulary up to this size is held by every worker.
HELD_BYTES = 32 << 20
#: With a larger one, tokens are looked up in blocks of about this many.
BLOCK_ITEMS = 1 << 20
STATS = ("n_tokens", "n_chars", "n_bytes", "n_words", "n_lines", "not_blank")


def tokenize(texts: DataFrame, names: tuple[str, ...] = STANDARD, keep: tuple[str, ...] = ("lang", "doc_id", "text")) -> DataFrame:
    """Every tokenizer applied to every text that isn't blank."""
    text = F.col("text")
    # (outer: else Spark tests that the array isn't empty, and tokenizes everything once more for that)
    each = F.explode_outer(F.array(*(F.struct(F.lit(n).alias("tokenizer"), TOKENIZERS[n](text).alias("tokens")) for n in names))).alias("x")
    return texts.where(t.not_blank(text)).select(*keep, each).select("x.tokenizer", *keep, "x.tokens")


def stats_columns(text: Column, tokens: Column) -> list[Column]:
    counts = {
        "n_tokens": F.size(tokens),
        "n_chars": F.length(text),
        "n_bytes": F.octet_length(text),
        "n_words": F.size(t.split_words(text)),
        "n_lines": t.count_lines(text),
    }
    return [c.cast("bigint").alias(n) for n, c in counts.items()] + [t.not_blank(text).alias("not_blank")]


def text_stats(tokenized: DataFrame) -> DataFrame:
    """One row per tokenized text; tokens and text themselves are gone."""
    return tokenized.select("tokenizer", "lang", "doc_id", *stats_columns(F.col("text"), F.col("tokens")))


def text_stats_of(texts: DataFrame, names: tuple[str, ...] = STANDARD, extra: tuple[str, ...] = ()) -> DataFrame:
    """text_stats(tokenize(texts)), with each text measured once however many tokenizers there are."""
    text = F.col("text")
    count = {n: COUNTERS[n](text) if n in COUNTERS else F.size(TOKENIZERS[n](text)) for n in names}
    sizes = F.array(*(F.struct(F.lit(n).alias("tokenizer"), count[n].cast("bigint").alias("n_tokens")) for n in names))
    measured = texts.where(t.not_blank(text)).select("lang", "doc_id", *extra, *stats_columns(text, F.array())[1:], sizes.alias("sizes"))
    return measured.select("*", F.explode_outer("sizes").alias("x")).select("x.tokenizer", "lang", "doc_id", *extra, "x.n_tokens", *STATS[1:])


def token_counts(tokenized: DataFrame, by: tuple[str, ...] = ("tokenizer", "lang")) -> DataFrame:
    """How often each token occurs; partial counts leave the map side, so the shuffle is as large as the vocabularies."""
    return tokenized.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def token_counts_of(texts: DataFrame, names: tuple[str, ...] = STANDARD, by: tuple[str, ...] = ("tokenizer", "lang")) -> DataFrame:
    """token_counts(tokenize(texts)), with bytes counted where they are: no string is made of each.

    by: tokenizer, and lang or not.
    """
    others = tuple(n for n in names if n != "bytes")
    counts = token_counts(tokenize(texts, others), by) if others else None
    if "bytes" not in names:
        return counts
    own = byte_counts(texts, tuple(c for c in by if c != "tokenizer")).select(*(F.lit("bytes").alias(c) if c == "tokenizer" else F.col(c) for c in by), "token", "n")
    return own if counts is None else counts.unionByName(own)


def byte_counts(texts: DataFrame, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """by, token, n: how often each byte, as two hexadecimal digits, occurs in the texts that aren't blank."""
    text, key = F.col("text"), F.struct(*by) if by else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}
        found: list[np.ndarray] = []
        for batch in batches:
            keys = batch.column("k").to_pylist() if by else [None] * batch.num_rows
            row = np.array([at.setdefault(tuple(k.values()) if k else (), len(at)) for k in keys], np.int64)
            found += [np.zeros(256, np.int64) for _ in range(len(at) - len(found))]
            order = np.argsort(row, kind="stable")
            texts = batch.column("b").take(pa.array(order))
            start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            cuts = np.flatnonzero(np.diff(row[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                found[row[order[a]]] += np.bincount(data[start[a] : start[b]], minlength=256)
        for k, own in zip(at, found):
            has = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(has), pa.string()) for x in k), pa.array([f"{x:02X}" for x in has], pa.string()), pa.array(own[has])], [*by, "token", "n"])

    schema = StructType([*(StructField(c, StringType()) for c in by), StructField("token", StringType()), StructField("n", LongType())])
    parts = texts.where(t.not_blank(text)).select(key.alias("k"), F.encode(text, "UTF-8").alias("b")).mapInArrow(run, schema)
    return parts.groupBy(*by, "token").agg(F.sum("n").alias("n"))


def vocabulary_sizes(counts: DataFrame, given: Mapping[str, int] = CLOSED) -> DataFrame:
    """tokenizer, vocab_size: as given, or the number of tokens that the counts (one row each) have."""
    known = F.coalesce(*(F.when(F.col("tokenizer") == n, F.lit(size)) for n, size in given.items()), F.lit(None)).cast("bigint")
    return counts.groupBy("tokenizer").agg(F.count("*").alias("found")).select("tokenizer", F.coalesce(known, "found").alias("vocab_size"))


def roll_up(counts: DataFrame) -> DataFrame:
    """Counts of each token over all languages."""
    return counts.groupBy("tokenizer", "token").agg(F.sum("n").alias("n"))


def least_sizes(tokens: DataFrame) -> DataFrame:
    """tokenizer, vocab_size: one more than the greatest id of vocabulary_of(tokens); ids begin at 0 without gaps, so none is made."""
    return tokens.groupBy("tokenizer").agg(F.count("*").alias("vocab_size"))


def vocabulary(tokenized: DataFrame) -> DataFrame:
    """tokenizer, token, token_id: ids from 0 in the order of the tokens' bytes.

    Ranks are taken inside buckets of the first two bytes, then shifted by the tokens of the buckets before:
    no task sorts a whole vocabulary.
    """
    return vocabulary_of(tokenized.select("tokenizer", F.explode("tokens").alias("token")).distinct())


def vocabulary_of(tokens: DataFrame) -> DataFrame:
    """vocabulary() of distinct tokens (tokenizer, token), as token_counts by tokenizer has them; their n stays."""
    more = [c for c in tokens.columns if c == "n"]
    tokens = tokens.select("tokenizer", "token", *more)
    bucket = tokens.withColumn("bucket", F.substring(F.hex(F.encode("token", "UTF-8")), 1, 4))
    before = Window.partitionBy("tokenizer").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = bucket.groupBy("tokenizer", "bucket").agg(F.count("*").alias("size")).withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    rank = F.row_number().over(Window.partitionBy("tokenizer", "bucket").orderBy("token"))
    return bucket.withColumn("rank", rank).join(shift, ["tokenizer", "bucket"]).select("tokenizer", "token", (F.col("rank") + F.col("shift") - 1).alias("token_id"), *more)


def _held(vocab: DataFrame, most_bytes: int, names: tuple[str, str]) -> dict[str, tuple[pa.Array, pa.Array]] | None:
    """The tokens and ids of each tokenizer, in the order of names, if they are few enough to be held by every worker."""
    kept = vocab.select("tokenizer", "token", F.col("token_id").cast("bigint").alias("token_id")).persist()
    size = kept.agg(F.sum(F.octet_length("token") + 24)).first()[0] or 0
    table = kept.toArrow() if size <= most_bytes else None
    kept.unpersist()
    if table is None:
        return None
    own = lambda n: table.filter(pc.equal(table.column("tokenizer"), pa.scalar(n)))
    return {n: tuple(own(n).column(c).combine_chunks() for c in names) for n in table.column("tokenizer").unique().to_pylist()}


def _changed(batch: pa.RecordBatch, own: Sequence[str], column: str, out: str, change: Callable[[str, pa.Array], pa.Array]) -> Iterator[pa.RecordBatch]:
    """The rows that have a list, in batches of one tokenizer, with the list changed as a whole."""
    batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(column)), 0), 0))
    for name in batch.column("tokenizer").unique().to_pylist():
        part = batch.filter(pc.equal(batch.column("tokenizer"), pa.scalar(name)))
        lists = part.column(column)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.ListArray.from_arrays(at, change(name, lists.flatten()))], [*own, out])


def _translated(rows: DataFrame, vocab: DataFrame, column: str, out: str, names: tuple[str, str], kind: pa.DataType, change: Callable[[pa.Array, pa.Array, pa.Array], pa.Array], most_bytes: int, keep: Sequence[str], items: int | None) -> DataFrame:
    """tokenizer, doc_id, the columns `keep` and the changed lists of a column.

    names: the columns of the vocabulary that are looked up and given.  A vocabulary of up to most_bytes is held by every
    worker and nothing is shuffled.  For a larger one, rows go to blocks of about BLOCK_ITEMS items; each block asks once
    for every distinct item that it has, and gets its own small vocabulary: no list is taken apart and put together
    again, and a frequent item counts once a block.
    """
    own, (key, value) = ("tokenizer", "doc_id", *keep), names
    schema = StructType([*(rows.schema[c] for c in own), StructField(out, ArrayType(StringType() if value == "token" else LongType()))])
    empty = (pa.array([], kind), pa.array([], pa.string() if value == "token" else pa.int64()))
    held = _held(vocab, most_bytes, names)
    if held is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _changed(batch, own, column, out, lambda name, items: change(items.cast(kind), *held.get(name, empty)))

        return rows.select(*own, column).mapInArrow(run, schema)
    if items is None:
        items = rows.agg(F.sum(F.greatest(F.size(column), F.lit(0)))).first()[0] or 0
    blocks = -(-items // BLOCK_ITEMS) or 1
    block = F.pmod(F.xxhash64("tokenizer", "doc_id", F.slice(column, 1, 8)), F.lit(blocks)).alias("block")
    placed = rows.select(block, *own, column).groupBy("block")

    def ask(table: pa.Table) -> pa.Table:
        made = []
        for batch in table.combine_chunks().to_batches():
            for name in batch.column("tokenizer").unique().to_pylist():
                asked = batch.filter(pc.equal(batch.column("tokenizer"), pa.scalar(name))).column(column).flatten().cast(kind).unique()
                made.append(pa.table([pa.repeat(batch.column("block")[0], len(asked)), pa.repeat(pa.scalar(name, pa.string()), len(asked)), asked], ["block", "tokenizer", key]))
        return pa.concat_tables(made).slice(0) if made else pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), empty[0]], ["block", "tokenizer", key])

    def answer(table: pa.Table, known: pa.Table) -> pa.Table:
        known = known.filter(pc.is_valid(known.column(value))).combine_chunks()

        def look(name: str, items: pa.Array) -> pa.Array:
            mine = known.filter(pc.equal(known.column("tokenizer"), pa.scalar(name))).combine_chunks()
            return change(items.cast(kind), *(pa.concat_arrays([*mine.column(c).chunks, none]) for c, none in zip(names, empty)))

        made = [x for batch in table.combine_chunks().to_batches() for x in _changed(batch, own, column, out, look)]
        return pa.Table.from_batches(made) if made else pa.table({c: table.column(c).slice(0, 0) for c in own} | {out: pa.array([], pa.list_(empty[1].type))})

    asked = placed.applyInArrow(ask, StructType([StructField("block", LongType()), StructField("tokenizer", StringType()), StructField(key, StringType() if key == "token" else LongType())]))
    # (left: then every block has an answer)
    known = asked.join(vocab.select("tokenizer", *names), ["tokenizer", key], "left").select("block", "tokenizer", key, F.col(value).cast("string" if value == "token" else "bigint").alias(value))
    return placed.cogroup(known.groupBy("block")).applyInArrow(answer, schema)


def encode_ids(tokenized: DataFrame, vocab: DataFrame, most_bytes: int = HELD_BYTES, keep: Sequence[str] = (), items: int | None = None) -> DataFrame:
    """tokenizer, doc_id, the columns `keep`, token_ids: tokens replaced by their ids, in order; unknown ones by -1.

    A vocabulary of up to most_bytes is held by every worker and nothing is shuffled.  A larger one is used twice, and
    should be kept; items: how many tokens there are, if that is known (else they are counted).
    """

    def change(tokens: pa.Array, known: pa.Array, ids: pa.Array) -> pa.Array:
        return pc.fill_null(ids.take(pc.index_in(tokens, known)), -1)

    return _translated(tokenized, vocab, "tokens", "token_ids", ("token", "token_id"), pa.string(), change, most_bytes, keep, items)


def decode_ids(encoded: DataFrame, vocab: DataFrame, most_bytes: int = HELD_BYTES, keep: Sequence[str] = (), items: int | None = None) -> DataFrame:
    """tokenizer, doc_id, the columns `keep`, tokens: ids replaced by their tokens, unknown ones by <UNK_id>; see encode_ids."""

    def change(ids: pa.Array, known: pa.Array, tokens: pa.Array) -> pa.Array:
        found = tokens.take(pc.index_in(ids, known))
        if not found.null_count:
            return found
        unknown = pc.binary_join_element_wise("<UNK_", ids.filter(pc.is_null(found)).cast(pa.string()), ">", "")
        return pc.replace_with_mask(found, pc.is_null(found), unknown)

    return _translated(encoded, vocab, "token_ids", "tokens", ("token_id", "token"), pa.int64(), change, most_bytes, keep, items)


def truncate(tokens: Column, most: int) -> Column:
    return F.slice(tokens, 1, most)


def pad(tokens: Column, length: int, filler: Column) -> Column:
    return F.concat(tokens, F.array_repeat(filler, F.greatest(F.lit(length) - F.size(tokens), F.lit(0))))


def attention_mask(tokens: Column, length: int) -> Column:
    """1 for each token and 0 for each filler."""
    return F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(tokens), F.lit(0))))


def encode_with_file(texts: DataFrame, path: str, name: str, add_special: bool = False, max_length: int | None = None, pad_to: int | None = None, pad_id: int = 0, details: bool = False) -> DataFrame:
    """tokenizer, lang, doc_id, text, tokens (ids) from a tokenizer file of the `tokenizers` library, batch by batch.

    Blank texts are skipped.  The file is read once, on the driver; tasks get its content.  pad_to: lists are filled up to
    this length with pad_id.  details: also attention_mask (0 for fillers) and offsets (start and end of each token in
    the text's characters; 0, 0 for fillers).  Where tiktoken is sure to give the same ids it encodes, six times as fast.
    """
    from tokenizers import Tokenizer

    from glyphmeter.sources.tokenizers import BYTE_LEVEL, alike, byte_ranks, load

    spec = load(name, path).spec
    plain = byte_ranks(spec) if not details and max_length is None and pad_to is None and importlib.util.find_spec("tiktoken") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tok = Tokenizer.from_str(spec)
        if max_length is not None:
            tok.enable_truncation(max_length)
        if pad_to is not None:
            tok.enable_padding(length=pad_to, pad_id=pad_id)
        encode = tok.encode_batch if details else tok.encode_batch_fast
        if plain:
            import tiktoken

            ranks, added = plain
            quick = tiktoken.Encoding(name, pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column("text").to_pylist()
                done = [quick.encode_ordinary(x) if plain and alike(x, added) else None for x in own]
                found = encode([x for x, ids in zip(own, done) if ids is None], add_special_tokens=add_special)
                rest = iter(found)
                ids = pa.array([next(rest).ids if ids is None else ids for ids in done], pa.list_(pa.int32()))
                more = {} if not details else {
                    "attention_mask": pa.array([e.attention_mask for e in found], pa.list_(pa.int32())),
                    "offsets": pa.array([[{"start": a, "end": b} for a, b in e.offsets] for e in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                }
                yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), *(part.column(c) for c in ("lang", "doc_id", "text")), ids, *more.values()], ["tokenizer", "lang", "doc_id", "text", "tokens", *more])

    rows = texts.where(t.not_blank(F.col("text"))).select("lang", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "tokenizer string, lang string, doc_id bigint, text string, tokens array<int>" + ", attention_mask array<int>, offsets array<struct<start: int, end: int>>" * details)
