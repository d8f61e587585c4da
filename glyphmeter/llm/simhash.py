"""SimHash near-duplicates through covering locality-sensitive hashing.

A text has LANES independent fingerprints of 64 bits: each of its distinct words votes with 1 + ln(count), in
every lane with other bits.  One more, the mark, is of its pairs of adjacent words: it tells apart texts that
only share the frequent words of a language.  Two texts are near if their marks are equal, or if at most CHECK
bits of the marks and at most `radius` bits of the fingerprints of some lane differ.  (Of two texts whose
fingerprints are expected to differ in 6 bits, 4 lanes of radius 5 find 0.92, one lane of radius 7 finds 0.77,
with as many tables.)

Candidates of a lane come from 2**(radius + 1) - 1 bit masks (Pagh's covering construction): each bit gets a
random vector of radius + 1 bits, and mask v keeps the bits whose vector has an odd inner product with v.
Whatever bits a pair differs in, if they are no more than radius some v is orthogonal to all their vectors, so
under that mask the pair is equal: none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmeter.llm import text as tx
from glyphmeter.llm.shared import checkpoint, small

RADIUS = 5
LANES = 4
#: Unrelated texts differ in 32 +- 4 bits of the mark.  A pair within the radius whose marks differ in more than `check`
#: bits is no near pair (at sf0.1: 27 of the 1,131 pairs of different texts within the radius, one of which has a five-word
#: Jaccard similarity of 0.7 or more, as 298 of all these pairs do); check=64 leaves it to the fingerprints alone.
CHECK = 18
PRINTS = [f"fp{k}" for k in range(LANES)]
#: Bytes of entries that one task compares; of one entry (fingerprint, mark and table); of a message without its entries.
TASK_BYTES = 12 << 20
ENTRY = 17
MESSAGE = 64
#: Fingerprints that a task spreads at once, at least over all tables and at most over one.
SPREAD = 1 << 13
MOST_BATCH = 1 << 20
#: Up to this many fingerprints under one mask and value all pairs are edges; above, a spanning forest.
ALL_PAIRS = 8
SEED = 20250711


def _votes(row: np.ndarray, hashes: np.ndarray, rows: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have any feature, and the bits that the features of each vote for: a row of numbers per lane."""
    bits = np.uint64(max(1, rows.bit_length()))
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    key.sort()
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    weight = (1 + np.log(np.diff(np.append(heads, len(key))))).astype(np.float32)
    key = key[heads]
    row = (key >> (np.uint64(64) - bits)).astype(np.int64)
    # the top 40 bits of the hash, however many rows there are
    feature = (key & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1))) >> (np.uint64(24) - bits)
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    total = np.add.reduceat(weight, starts)
    value = np.zeros((lanes, len(starts)), np.uint64)
    for lane in range(lanes):
        vote = tx.mix(feature + np.uint64(lane << 40))
        for b in range(64):
            ones = np.add.reduceat(weight * ((vote >> np.uint64(b)) & np.uint64(1)).astype(np.float32), starts)
            value[lane] |= (2 * ones > total).astype(np.uint64) << np.uint64(b)
    return row[starts], value


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's fingerprints (a row per lane), its mark, and whether it has any: texts without words have none."""
    prints, mark, has = np.zeros((LANES, len(column)), np.uint64), np.zeros(len(column), np.uint64), np.zeros(len(column), np.bool_)
    for at, part in tx.slices(column):
        w = tx.words(part)
        if not len(w.hash):
            continue
        row = w.row()
        to, value = _votes(row, w.hash, len(part), LANES)
        prints[:, at + to], has[at + to] = value, True
        mark[at + to] = value[0]  # of a text of one word, which has no pair
        pair = row[1:] == row[:-1]
        if pair.any():
            to, value = _votes(row[1:][pair], tx.mix(w.hash[:-1][pair] * np.uint64(3) + w.hash[1:][pair]), len(part), 1)
            mark[at + to] = value[0]
    return prints, mark, has


def masks(radius: int, seed: int = SEED) -> np.ndarray:
    """The 2**(radius + 1) - 1 masks over 64 bits."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64, dtype=np.uint64)
    v = np.arange(1, 1 << (radius + 1), dtype=np.uint64)[:, None]
    odd = (np.bitwise_count(v & vectors[None, :]) & 1).astype(np.uint64)
    return (odd << np.arange(64, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


def edges_of(fp: np.ndarray, mark: np.ndarray, mask: np.uint64, radius: int, check: int = CHECK) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that agree under the mask and are near.

    In a group of more than ALL_PAIRS, only a spanning forest of its near pairs: it connects the same ones.
    """
    key = fp & mask
    order = np.argsort(key, kind="stable")
    key, fp, mark = key[order], fp[order], mark[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(heads, len(key)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (np.bitwise_count(mark[i] ^ mark[j]) <= check)

    for head, size in zip(heads[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS]):
        rest = np.arange(head, head + size)
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                here = front.pop()
                hit = near(rest, here)
                if hit.any():
                    found, rest = rest[hit], rest[~hit]
                    left.append(np.full(len(found), here))
                    right.append(found)
                    front.extend(found)
    heads, sizes = heads[(sizes > 1) & (sizes <= ALL_PAIRS)], sizes[(sizes > 1) & (sizes <= ALL_PAIRS)]
    for j in range(1, ALL_PAIRS):
        at = heads[sizes > j]
        for i in range(j if len(at) else 0):
            hit = at[near(at + i, at + j)]
            left.append(hit + i)
            right.append(hit + j)
    return order[np.concatenate(left)], order[np.concatenate(right)]


@dataclass(frozen=True)
class Layout:
    """How the entries of all tables are dealt to tasks, from the number of fingerprints alone.

    A task takes about TASK_BYTES: several tables if they are small, one of `parts` parts of a table if it is large.
    A batch of `batch` fingerprints is dealt `step` tables at a time: with more parts batches grow and steps shrink,
    so that a message holds dozens of entries and a task's memory stays the same, however many fingerprints there are.
    """

    together: int
    parts: int
    batch: int
    step: int

    @classmethod
    def of(cls, count: int, tables: int) -> Layout:
        entries = TASK_BYTES // ENTRY
        parts = max(1, -(-count // entries))
        batch = min(MOST_BATCH, max(SPREAD, 64 * parts))
        return cls(max(1, min(tables, entries // max(1, count))), parts, batch, max(1, SPREAD * tables // batch))

    def message_bytes(self) -> float:
        """Bytes that an entry costs on its way, with its share of its message."""
        return ENTRY + MESSAGE / (self.batch * self.together / self.parts)


def near_pairs(prints: DataFrame, count: int, radius: int = RADIUS, check: int = CHECK) -> DataFrame:
    """a, b: edges between marks that connect exactly what the near pairs of the distinct rows (PRINTS, mark) connect.

    A fingerprint goes, with its mark, to the task of its table and of its value under that table's mask; only these
    16 bytes and the table's number travel, since the receiver masks again.
    """
    tables = [(lane, mask) for lane in range(LANES) for mask in masks(radius)]
    layout = Layout.of(count, len(tables))
    tasks = max(1, min(-(-count * len(tables) * ENTRY // TASK_BYTES), count // layout.batch))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _gathered(batches, layout.batch):
            prints, mark = columns[:-1], columns[-1]
            for low in range(0, len(tables), layout.step):
                own = tables[low : low + layout.step]
                to = np.empty((len(own), len(mark)), np.int32)
                for k, (lane, mask) in enumerate(own):
                    part = tx.mix((prints[lane] & mask) + np.uint64(low + k)) % np.uint64(layout.parts)
                    to[k] = (low + k) // layout.together * layout.parts + part.astype(np.int32)
                to = to.ravel()
                order = np.argsort(to, kind="stable")  # by part, then by table
                ends = np.flatnonzero(np.concatenate(([True], np.diff(to[order]) != 0, [True]))) if len(order) else np.zeros(1, np.int64)
                t, k = order // len(mark) if len(mark) else order, order % max(1, len(mark))
                lanes = np.array([lane for lane, _ in own])[t]
                fp, marked, number = prints[lanes, k], mark[k], (t + low).astype(np.uint8)
                spans = [slice(a, b) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to[order][ends[:-1]], pa.int32()),
                        pa.array([number[x].tobytes() for x in spans], pa.binary()),
                        pa.array([fp[x].tobytes() for x in spans], pa.binary()),
                        pa.array([marked[x].tobytes() for x in spans], pa.binary()),
                    ],
                    ["part", "tables", "fp", "mark"],
                )

    def compare(group: pa.Table) -> pa.Table:
        number, fp, mark = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("tables", np.uint8), ("fp", np.uint64), ("mark", np.uint64)))
        order = np.argsort(number, kind="stable")
        number, fp, mark = number[order], fp[order], mark[order]
        pairs = [np.zeros((0, 2), np.int64)]
        for t in np.unique(number).tolist():
            x = slice(*np.searchsorted(number, [t, t + 1]))
            i, j = edges_of(fp[x], mark[x], tables[t][1], radius, check)
            a, b = mark[x][i].view(np.int64), mark[x][j].view(np.int64)
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
        both = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    sent = prints.select(*PRINTS, "mark").repartition(tasks).mapInArrow(spread, "part int, tables binary, fp binary, mark binary")
    return sent.groupBy("part").applyInArrow(compare, "a bigint, b bigint").distinct()


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The fingerprints (a row per lane) and, as the last row, the marks, of about `size` texts at a time."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            held.append(np.stack([part.column(c).to_numpy() for c in (*PRINTS, "mark")]).view(np.uint64))
            n += part.num_rows
            if n >= size:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
    if n:
        yield np.concatenate(held, axis=1)


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node of the edges, the least node that it is connected with.

    Alternating large and small stars; every round is a checkpoint, so the plan stays short and a lost
    executor costs one round at most.
    """
    edges = checkpoint(edges.where("a <> b").select("a", "b"))
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small_star = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = checkpoint(small_star.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def groups(docs: DataFrame, radius: int = RADIUS, check: int = CHECK) -> tuple[DataFrame, int]:
    """doc_id, text_hash, copies, group_rows, kept_id, distance, keep of each distinct (doc_id, text) in a group of more than one row; and how many.

    copies: how many equal rows there are.  keep: it is the one of its group with the least doc_id (nulls
    last), then text_hash.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, mark, has = fingerprints(batch.column("text"))
            columns = [pa.array(x.view(np.int64), mask=~has) for x in (*prints, mark)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], ["doc_id", "text_hash", *PRINTS, "mark"])

    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    read_rows = hashed.mapInArrow(read, f"doc_id bigint, text_hash bigint, {', '.join(f'{c} bigint' for c in PRINTS)}, mark bigint").where("mark is not null")
    rows = checkpoint(read_rows.groupBy("doc_id", "text_hash", *PRINTS, "mark").agg(F.count("*").alias("copies")))
    prints = checkpoint(rows.select(*PRINTS, "mark").distinct())
    roots = components(near_pairs(prints, prints.count(), radius, check))
    joined = rows.join(small(roots, roots.count(), 16), F.col("mark") == F.col("node"), "left").select("doc_id", "text_hash", *PRINTS, "copies", F.coalesce("root", "mark").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), *PRINTS)
    best = joined.groupBy("root").agg(F.min(order).alias("best"), F.sum("copies").alias("group_rows")).where("group_rows > 1")
    distance = F.least(*(F.bit_count(F.col(c).bitwiseXOR(F.col(f"best.{c}"))) for c in PRINTS))
    found = joined.join(best, "root").select("doc_id", "text_hash", "copies", "group_rows", F.col("best.d").alias("kept_id"), distance.alias("distance"), (order == F.col("best")).alias("keep"))
    found = checkpoint(found)
    return found, found.count()


def duplicates(docs: DataFrame, radius: int = RADIUS, check: int = CHECK) -> DataFrame:
    """doc_id, duplicate_of, distance (the least of any lane), group_rows of each document that another one of its group stands for.

    Groups are the connected components of the near pairs; the member with the least doc_id stays.  Null,
    empty and wordless texts are in no group.  A row that repeats another one entirely is its duplicate.
    Empty tables give no rows; columns other than doc_id and text play no part.
    """
    found, _ = groups(docs, radius, check)
    repeats = F.explode(F.array_repeat(F.lit(1), (F.col("copies") - F.col("keep").cast("int")).cast("int")))
    return found.select("*", repeats).select("doc_id", F.col("kept_id").alias("duplicate_of"), "distance", "group_rows")


def dedup(docs: DataFrame, radius: int = RADIUS, check: int = CHECK) -> DataFrame:
    """docs with one row of each group; rows in no group all stay.  Columns and their order are those of docs.

    Null, empty and wordless texts are in no group.  Of equal rows one stays.  An empty table stays empty; columns
    other than doc_id and text play no part, whatever they are called.
    """
    found, count = groups(docs, radius, check)
    decided = found.where("not keep or copies > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "keep")
    # docs' own columns travel as one, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    near = rows.join(small(decided, count), F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left")
    stays = near.where("keep is null").select("row.*")
    if not found.where("keep and copies > 1").isEmpty():  # repeated rows of which one stays
        stays = stays.union(near.where("keep").dropDuplicates(["id", "hash"]).select("row.*"))
    return stays
