"""Benchmark decontamination: which documents hold WINDOW words in a row of a benchmark item.

Texts are compared as lower-cased runs of letters and digits with one space between, so punctuation, case
and white space play no part.  The test strings are the windows of WINDOW words of each item (the whole
item if it has fewer), found by Wu-Manber search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmeter.llm import text as tx
from glyphmeter.llm.wu_manber import Searcher

WINDOW = 13
#: To drop a document for, an item of fewer words is no passage: it would be found by chance.  Unless it has this many
#: characters of scripts without spaces (where a clause is one word), or that many of any.
PASSAGE_WORDS = 5
PASSAGE_UNSPACED = 15
PASSAGE_CHARACTERS = 64
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Bytes of benchmark text that one Finder takes (about ten times as many in memory), and Finders of one scan of the documents.
GROUP_BYTES = 16 << 20
SCAN_GROUPS = 4
#: Patterns are searched together with those of about their length, so that short ones don't keep long ones from skipping.
LENGTHS = (0, 8, 32, 1 << 62)
Items = tuple[tuple[int | None, str], ...]


def is_passage(words: list[str], least_words: int) -> bool:
    """Whether an item of these words is long enough: always, if it has any word and least_words is 1 or less."""
    letters = "".join(words)
    return bool(words) and (len(words) >= least_words or len(letters) >= PASSAGE_CHARACTERS or len(_UNSPACED.findall(letters)) >= PASSAGE_UNSPACED)


class Finder:
    """The test strings of one group of items, as places in the items' own words, ready for the search."""

    def __init__(self, items: Items, window: int = WINDOW, least_words: int = 1) -> None:
        at, raw = tx.flat(pa.array([t for _, t in items], pa.large_string()))
        space = np.flatnonzero(raw == 32)  # before and behind each word
        first = np.searchsorted(space, at)
        words = np.diff(first) - 1
        width = np.minimum(words, window)
        long = words >= max(1, least_words)
        for k in np.flatnonzero((words > 0) & ~long).tolist():
            long[k] = is_passage(raw[at[k] : at[k + 1]].tobytes().decode("utf-8").split(), least_words)
        count = np.where(long, words - width + 1, 0)
        owner = np.repeat(np.arange(len(words)), count)
        j = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start, end = space[j], space[j + width[owner]] + 1
        _, one, number = np.unique(tx.span_hashes(raw, start, end), return_index=True, return_inverse=True)
        pairs = np.unique(number.astype(np.int64) * len(items) + owner) if len(owner) else np.zeros(0, np.int64)
        self.items = [i for i, _ in items]
        self.owner = pairs % max(1, len(items))
        self.first = np.searchsorted(pairs // max(1, len(items)), np.arange(len(one) + 1))
        self.total = np.bincount(self.owner, minlength=len(items)).tolist()
        self.length = (end - start)[one]
        self.searchers = []
        for low, high in zip(LENGTHS, LENGTHS[1:]):
            own = np.flatnonzero((self.length >= low) & (self.length < high))
            if len(own):
                self.searchers.append((own, Searcher(raw, start[one[own]], self.length[own])))

    def find(self, column: pa.Array) -> dict[tuple[int, int], set[int]]:
        """(row, item): the item's test strings that the row's text holds."""
        out: dict[tuple[int, int], set[int]] = {}
        for at, part in tx.slices(column):
            offsets, raw = tx.flat(part)
            for own, searcher in self.searchers:
                found = searcher.search(raw)
                if not found:
                    continue
                start = np.array([s for s, _ in found])
                number = own[[k for _, k in found]]
                row = np.searchsorted(offsets, start, "right") - 1
                inside = start + self.length[number] <= offsets[row + 1]
                for k, r in zip(number[inside].tolist(), row[inside].tolist()):
                    for item in self.owner[self.first[k] : self.first[k + 1]].tolist():
                        out.setdefault((at + r, item), set()).add(k)
        return out


@lru_cache(SCAN_GROUPS)
def finder(items: Items, window: int, least_words: int) -> Finder:
    """Built once per Python worker, not once per task."""
    return Finder(items, window, least_words)


def item_groups(benchmark: DataFrame, group_bytes: int = GROUP_BYTES) -> Iterator[list[Items]]:
    """The benchmark's items, SCAN_GROUPS groups of about group_bytes of text at a time."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // group_bytes))
    groups: list[Items] = []
    for g in range(count):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == g) if count > 1 else items
        groups.append(tuple(sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))
        if len(groups) == SCAN_GROUPS or g == count - 1:
            yield groups
            groups = []


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, least_words: int = 1) -> DataFrame:
    """doc_id, item_id, windows_found, windows_total: a row for each document and item that share a test string.

    windows_found: the item's distinct test strings that occur in the document, of windows_total.  Every item of
    least_words words and more is searched (see is_passage for shorter ones).  Null, empty and wordless texts match
    nothing; a repeated document gives repeated rows, a repeated item counts once; items with equal ids but different
    texts give a row each; null ids stay null.  Empty tables give no rows; texts are searched whole; other columns
    play no part.  The documents are scanned once for each SCAN_GROUPS * group_bytes of benchmark text.
    """

    def searched(groups: list[Items]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finders = [finder(items, window, least_words) for items in groups]
            for batch in batches:
                for found in finders:
                    hits = sorted(found.find(batch.column("text")).items())
                    rows = pa.array([r for (r, _), _ in hits], pa.int64())
                    columns = [
                        batch.column("doc_id").take(rows),
                        pa.array([found.items[i] for (_, i), _ in hits], pa.int64()),
                        pa.array([len(k) for _, k in hits], pa.int64()),
                        pa.array([found.total[i] for (_, i), _ in hits], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "windows_found", "windows_total"])

        narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        return narrow.mapInArrow(run, "doc_id bigint, item_id bigint, windows_found bigint, windows_total bigint")

    out = None
    for groups in item_groups(benchmark, group_bytes):
        found = searched(groups)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs without the rows that hold a test string of an item that is a passage (see is_passage).

    Null and empty texts stay; repeated rows stay or go together; empty tables are fine; other columns stay as they
    are.  Nothing is joined or shuffled.
    """
    for groups in item_groups(benchmark, group_bytes):

        def run(batches: Iterator[pa.RecordBatch], groups: list[Items] = groups) -> Iterator[pa.RecordBatch]:
            finders = [finder(items, window, least_words) for items in groups]
            for batch in batches:
                for found in finders:
                    hit = sorted({r for r, _ in found.find(batch.column("text"))})
                    if hit:
                        keep = np.ones(batch.num_rows, np.bool_)
                        keep[hit] = False
                        batch = batch.filter(pa.array(keep))
                yield batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: The same rows by brute force in SQL: every window of every document against every window of every item.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
    SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(len(w), 13) AS k FROM b WHERE len(w) >= 1))),
total AS (SELECT item_id, count(*) AS windows_total FROM bw GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k))
SELECT any_value(dw.doc_id) AS doc_id, bw.item_id AS item_id, CAST(count(DISTINCT bw.s) AS BIGINT) AS windows_found, CAST(any_value(total.windows_total) AS BIGINT) AS windows_total
FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s JOIN total ON total.item_id = bw.item_id GROUP BY dw.r, bw.item_id
"""
