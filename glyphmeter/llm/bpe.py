"""BPE encoding and decoding by tree concatenation.

`encode` gives exactly the ids that encoding the whole text at once gives.  A text of more than LEAF
characters is cut into leaves, in the middle again and again; the leaves are encoded independently (in
Spark: by different tasks) and neighbours are joined pairwise up the tree.  A join re-encodes a window
around the cut and grows it until both sides agree:

* pieces (what the tokenizer's pattern splits text into, left to right, with one character of lookahead):
  all pieces of the left side but its last ones are final.  Splitting starts again at one of the last left
  pieces, and once a new boundary falls on one of the right side's own, the rest of the right side is final
  as it stands, for the split after a boundary depends on nothing before it;
* inside a piece that runs across the cut, byte pairs: a token sequence is the encoding of its bytes if and
  only if each adjacent pair is the encoding of its own bytes.  Both halves of the piece are encoded, some
  tokens at the seam are encoded anew, and the window grows until its outermost tokens come out as they were.

Nulls encode to null, the empty text to no tokens; rows, repeated or not, are independent of each other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary of ranks: one line of base64 bytes and rank per token.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf; bytes from which one piece is encoded by halves.
LEAF = 1 << 14
PIECE = 1 << 10
_SURE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")
_cache: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    if path not in _cache:
        _cache[path] = Codec(path)
    return _cache[path]


class Codec:
    """Tokens are arrays of ids: a text's ids as Python numbers would take nine times the memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = tiktoken.Encoding("split", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        by_id = sorted((i, x) for x, i in ranks.items())
        self.size = np.zeros(by_id[-1][0] + 1 if by_id else 0, np.int64)
        self.size[[i for i, _ in by_id]] = [len(x) for _, x in by_id]
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.blob = np.frombuffer(b"".join(x for _, x in by_id), np.uint8)

    def raw(self, tokens: np.ndarray) -> np.ndarray:
        """The bytes of all tokens."""
        size = self.size[tokens]
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[tokens] - ends + size, size)]

    # -- one piece -------------------------------------------------------------------------------
    def piece(self, data: bytes) -> np.ndarray:
        """Bytes that no pattern splits, encoded directly."""
        return np.array(self.split._encode_single_piece(data), np.uint32)

    def join_piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of one piece from those of its halves."""
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            old = np.concatenate((left[len(left) - a :], right[:b]))
            new = self.piece(self.raw(old).tobytes())
            fits_left = a == len(left) or new[0] == old[0]
            fits_right = b == len(right) or new[-1] == old[-1]
            if fits_left and fits_right:
                return np.concatenate((left[: len(left) - a], new, right[b:]))
            a, b = a if fits_left else 2 * a, b if fits_right else 2 * b

    def encode_piece(self, data: bytes) -> np.ndarray:
        """A piece of any length: by halves, re-encoded around each join."""
        if len(data) <= PIECE:
            return self.piece(data)
        mid = len(data) // 2
        return self.join_piece(self.encode_piece(data[:mid]), self.encode_piece(data[mid:]))

    # -- texts -----------------------------------------------------------------------------------
    def leaf(self, text: str) -> np.ndarray:
        """Encoded directly, but for pieces of more than PIECE bytes."""
        if not self._has_long_runs(text):
            return self.split.encode_to_numpy(text)
        return self._pieces(self.pattern.findall(text))

    @staticmethod
    def _has_long_runs(text: str) -> bool:
        """Whether a piece may have more than PIECE bytes, of up to four per character."""
        words = text.split()
        sizes = list(map(len, words))
        spaces = len(text) - sum(sizes)
        return max(sizes, default=0) >= PIECE // 4 or spaces - len(words) >= PIECE // 4 - 1

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.encode_piece(p.encode("utf-8")) for p in pieces)])

    def join(self, left_text: str, left: np.ndarray, right_text: str, right: np.ndarray) -> np.ndarray:
        """The encoding of left_text + right_text from those of both."""
        if not left_text or not right_text:
            return right if not left_text else left
        reach = 64
        while True:
            start, ends = self._boundary(left_text, reach), self._ends(right_text, reach)
            pieces, cut = self._match(left_text[start:], right_text, ends, reach)
            if pieces:
                # what ends before the cut is final on the left; only the white space at its end waits for what follows
                final = len(left_text.rstrip())
                while pieces and start + len(pieces[0]) <= final:
                    start, pieces = start + len(pieces[0]), pieces[1:]
                keep_left = self._prefix(left, left_text[:start])
                keep_right = self._prefix(right, right_text[:cut])
                last = len(left_text) + cut - len("".join(pieces[-1:]))  # where the last piece starts
                if pieces and ends and cut == ends[0] and start <= last < len(left_text) and self.pattern.match(left_text, last).end() == len(left_text):
                    # the last piece of the left and the first of the right are one: only their seam is encoded anew
                    at = self._prefix(left, left_text[:last])
                    seam = self.join_piece(left[at:], right[:keep_right])
                    return np.concatenate((left[:keep_left], self._pieces(pieces[:-1]), seam, right[keep_right:]))
                return np.concatenate((left[:keep_left], self._pieces(pieces), right[keep_right:]))
            reach *= 4

    def _boundary(self, text: str, reach: int) -> int:
        """A place near the end, not among the last few characters, where a piece surely starts; 0 if there is none.

        Runs of letters, of digits and of other signs end where they end, whatever comes before; but an apostrophe
        may take letters along, and a space may belong to either side.
        """
        tail = max(0, len(text) - reach)
        if tail == 0:
            return 0
        for m in _SURE.finditer(text, tail):
            if m.start() < len(text) - 8:
                return m.start()
        return 0 if len(text) <= reach else self._boundary(text, reach * 4)

    def _ends(self, text: str, reach: int) -> list[int]:
        """The ends of the right side's own first pieces, so far as what follows can't change them."""
        part = text[: reach + 16]
        ends = [m.end() for m in self.pattern.finditer(part)]
        if len(part) < len(text):
            ends = [e for e in ends if e < len(part) - 16]
        return ends

    def _match(self, window: str, right: str, ends: list[int], reach: int) -> tuple[list[str], int]:
        """The pieces from window's start to the first boundary that both splits share, and its place; none if reach is too short."""
        part = right[: reach + 16]
        own, n, pieces = {0, *ends}, len(window), []
        for m in self.pattern.finditer(window + part):
            pieces.append(m[0])
            if m.end() >= n and m.end() - n in own:
                return pieces, m.end() - n
        return (pieces, len(right)) if len(part) == len(right) else ([], 0)

    def _prefix(self, tokens: np.ndarray, text: str) -> int:
        """How many of the tokens encode text, the beginning of what they encode."""
        want = len(text.encode("utf-8"))
        if not want:
            return 0
        size = np.cumsum(self.size[tokens])
        at = int(np.searchsorted(size, want, "left")) + 1
        assert size[at - 1] == want
        return at

    def tree(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Neighbours are joined until one is left."""
        while len(parts) > 1:
            parts = [
                (parts[i][0] + parts[i + 1][0], self.join(*parts[i], *parts[i + 1])) if i + 1 < len(parts) else parts[i]
                for i in range(0, len(parts), 2)
            ]
        return parts[0][1] if parts else np.zeros(0, np.uint32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self.leaf(text) if len(text) <= leaf else self.tree([(t, self.leaf(t)) for t in leaves(text, leaf)])

    def decode(self, tokens: np.ndarray | list[int]) -> str:
        return self.raw(np.asarray(tokens, np.int64)).tobytes().decode("utf-8", errors="replace")


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """text halved until no part has more than leaf characters."""
    count = 1
    while len(text) > leaf * count:
        count *= 2
    at = [len(text) * i // count for i in range(count + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    """An Arrow list per array; null for None."""
    sizes = [0 if v is None else len(v) for v in values]
    at = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.array([*(v is None for v in values), False]))
    flat = np.concatenate([np.zeros(0, np.uint32), *(v for v in values if v is not None)])
    return pa.ListArray.from_arrays(at, pa.array(flat.astype(np.int32)))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The ids of each row of a list column."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at, flat = whole.offsets.to_numpy(), whole.values.to_numpy(zero_copy_only=False).astype(np.uint32)
    return [flat[a:b] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, path: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, tokens, n_tokens, n_bytes, round_trip of each row of documents.

    Texts of up to `leaf` characters are encoded where they are read.  The leaves of longer ones are spread
    over all tasks and come back to one task a text, which joins them.  round_trip: decoding gives the text
    again.  Null text: all null; empty text: no tokens; empty table: no rows.  Repeated rows stay repeated, rows
    with one id and different texts are independent; other columns are left out, whatever they are called.
    """
    schema = "doc_id bigint, tokens array<int>, n_tokens int, n_bytes bigint, round_trip boolean"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def rows(ids: pa.Array, texts: list, tokens: list, c: Codec) -> pa.RecordBatch:
        data = [None if t is None else t.encode("utf-8") for t in texts]
        back = [None if x is None else c.raw(t).tobytes() == x for x, t in zip(data, tokens)]
        columns = [
            ids,
            _lists(tokens),
            pa.array([None if t is None else len(t) for t in tokens], pa.int32()),
            pa.array([None if x is None else len(x) for x in data], pa.int64()),
            pa.array(back, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "n_tokens", "n_bytes", "round_trip"])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                yield rows(part.column("doc_id"), texts, [None if t is None else c.leaf(t) for t in texts], c)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                parts = leaves(text, leaf)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("doc_id")[row].as_py()] * n, pa.int64()), pa.array([batch.column("key")[row].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())],
                    ["doc_id", "key", "leaf", "text"],
                )

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists([c.leaf(t) for t in part.column("text").to_pylist()])], [*part.schema.names, "tokens"])

    def joined(group: pa.Table) -> pa.Table:
        c = codec(path)
        group = group.sort_by("leaf")
        number, texts, tokens = group.column("leaf").to_pylist(), group.column("text").to_pylist(), _arrays(group.column("tokens"))
        copies = number.count(0)  # equal rows: their leaves are equal, so one of each is enough
        parts = list(zip(texts, tokens))[::copies]
        text, ids = "".join(t for t, _ in parts), c.tree(parts)
        one = rows(pa.array([group.column("doc_id")[0].as_py()] * copies, pa.int64()), [text] * copies, [ids] * copies, c)
        return pa.Table.from_batches([one])

    long = docs.where(F.length("text") > leaf)
    short = docs.where(F.col("text").isNull() | (F.length("text") <= leaf)).mapInArrow(direct, schema)
    pieces = long.withColumn("key", F.xxhash64("doc_id", "text", F.md5("text"))).mapInArrow(spread, "doc_id bigint, key bigint, leaf int, text string")
    spread_out = pieces.repartition("key", "leaf").mapInArrow(encode_leaves, "doc_id bigint, key bigint, leaf int, text string, tokens array<int>")
    return short.unionByName(spread_out.groupBy("doc_id", "key").applyInArrow(joined, schema))


def decode(encoded: DataFrame, path: str = VOCABULARY, column: str = "tokens") -> DataFrame:
    """encoded with the text of its token ids as decoded_text (null for null; bytes that are no UTF-8 as U+FFFD)."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([f for f in encoded.schema if f.name != "decoded_text"] + [StructField("decoded_text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            text = pa.array([None if t is None else c.decode(t) for t in batch.column(column).to_pylist()], pa.string())
            kept = [n for n in batch.schema.names if n != "decoded_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), text], [*kept, "decoded_text"])

    return encoded.mapInArrow(run, schema)
