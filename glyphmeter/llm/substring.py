"""Substring dedup with a count-min prefilter.

Every window of WINDOW words is counted in a sketch of ROWS rows of counters that saturate at 2.  A window's hash
chooses its slice and, in each row of that slice, its counter.  Texts are dealt to origins; an origin sends each
slice which counters it raises (gap-coded), one task a slice and row merges what all origins send, and answers each
with one bit a counter: whether it reached 2.  So no task holds more than one slice, however large the corpus, and
slices grow in number with it.  Merged counts never underestimate: each window that occurs twice has all its counters
at 2.  In the second pass only windows estimated repeated are grouped, exactly, by 96 bits of hash.

A window travels as its hash and its place in its origin; what really repeats goes back to the origin and becomes
maximal spans.  Within an origin equal windows are counted first, so a window that very many texts share costs its
task one entry an origin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmeter.llm import text as tx

WINDOW = 50
ROWS = 2
#: Counters per window and row, and counters of a slice's row.
LOAD = 4
SLICE = 1 << 26
#: Bytes of windows' hashes that one task groups.
TASK_BYTES = 12 << 20
#: Bytes of an origin's texts: more where there are many slices, so that a message still holds many counters.
ORIGIN_BYTES = 8 << 20
MOST_ORIGIN_BYTES = 64 << 20
_POWERS = tx.Powers(0xD6E8FEB86659FD93)
_SALT = 0xA0761D6478BD642F
SCHEMA = "doc_id bigint, text_hash bigint, start_word int, end_word int, words int, occurrences bigint"


def windows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each row (rows + 1, counted through the column), and of each window its first word and its hash."""
    w = tx.words(column)
    h, at = tx.window_hashes(w, width, _POWERS)
    return w.first, at, h


def shape(estimate: int) -> tuple[int, int, int]:
    """For about so many windows: slices, counters of a slice's row, and bytes of an origin's texts."""
    size = max(1 << 16, LOAD * estimate)
    slices = -(-size // SLICE)
    return slices, -(-size // slices // 8) * 8, min(MOST_ORIGIN_BYTES, max(ORIGIN_BYTES, slices << 13))


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (tx.mix(h + np.uint64(_SALT)) % np.uint64(slices)).astype(np.int64)


def cells(h: np.ndarray, row: int, span: int) -> np.ndarray:
    """The counter of each window in one row of its slice."""
    return (tx.mix(h + np.uint64(_SALT * (row + 2) % 2**64)) % np.uint64(span)).astype(np.int64)


def gaps(sorted_cells: np.ndarray) -> bytes:
    """Distinct ascending numbers as their gaps, in the unsigned type that takes the fewest bytes; the type's greatest value adds up."""
    if not len(sorted_cells):
        return b""
    gap = np.diff(sorted_cells.astype(np.int64), prepend=-1)
    kind = min((1, 2, 4, 8), key=lambda k: k * (len(gap) + (int((gap // (256**k - 1)).sum()) if k < 8 else 0)))
    if kind == 8:
        return b"\x08" + gap.astype("<u8").tobytes()
    most = 256**kind - 1
    more = gap // most
    out = np.full(len(gap) + int(more.sum()), most, f"<u{kind}")
    out[np.arange(len(gap)) + np.cumsum(more)] = gap % most
    return bytes([kind]) + out.tobytes()


def ungaps(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    kind = data[0]
    values = np.frombuffer(data, f"<u{kind}", offset=1)
    total = np.cumsum(values, dtype=np.int64) - 1
    return total if kind == 8 else total[values != 256**kind - 1]


def narrowest(values: np.ndarray) -> bytes:
    """Non-negative numbers in the narrowest unsigned type, named by the first byte."""
    top = int(values.max(initial=0))
    kind = next(k for k in (1, 2, 4, 8) if top < 256**k)
    return bytes([kind]) + values.astype(f"<u{kind}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def raised(h: np.ndarray, slices: int, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice and row: the distinct counters of these windows, whether two of them raise it, and of each of the slice's windows which it is."""
    part = slice_of(h, slices)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(slices + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        own = order[ends[p] : ends[p + 1]]
        for row in range(ROWS):
            cell, which, n = np.unique(cells(h[own], row, span), return_inverse=True, return_counts=True)
            yield p, row, cell, n > 1, which


def hashes(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of an origin's texts: where each text's words begin, the place of each window, and its hash."""
    firsts, places, found, base = [], [], [np.zeros(0, np.uint64)], 0
    for _, part in tx.slices(texts):
        first, at, h = windows(part, width)
        firsts.append(base + first[:-1])
        places.append(base + at)
        found.append(h)
        base += int(first[-1])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + firsts), np.concatenate(none + places), np.concatenate(found)


def repeated_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, start_word, end_word (exclusive), words, occurrences of each maximal repeated span.

    A window repeats if its words occur twice or more in the corpus, in one text or in several; spans are
    unions of overlapping or adjoining repeated windows, occurrences the most that any of its windows has.
    Words are runs of letters and digits of the lower-cased whole text.  Texts under `width` words, nulls and
    empty ones have none; each of several equal rows has its spans; a null doc_id stays null; an empty table gives
    no rows.  Columns other than doc_id and text play no part.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    size_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    estimate = max(1, size_of // 6)  # words; the sketch's size is a matter of efficiency only
    slices, span, origin_bytes = shape(estimate)
    origins = max(1, -(-size_of // origin_bytes))
    parts = max(1, -(-estimate * 12 // 3 // TASK_BYTES))
    # equal rows of different splits go to different origins, so that no origin has all copies of one row
    dealt = docs.withColumn("origin", F.pmod(F.xxhash64("doc_id", "text_hash", F.spark_partition_id()), F.lit(origins)))

    def count(group: pa.Table) -> pa.Table:
        origin = group.column("origin")[0].as_py()
        rows = [
            {"slice": p, "row": row, "origin": origin, "cells": gaps(cell), "twice": np.packbits(twice).tobytes() if twice.any() else None}
            for p, row, cell, twice, _ in raised(hashes(group.column("text"), width)[2], slices, span)
        ]
        return pa.Table.from_pylist(rows, sent_schema)

    def merge(group: pa.Table) -> pa.Table:
        reached = np.zeros(span, np.uint8)
        sent = list(zip(group.column("cells").to_pylist(), group.column("twice").to_pylist()))
        for data, twice in sent:
            at = ungaps(data)
            reached[at] = np.minimum(reached[at] + 1, 2)
            if twice is not None:
                reached[at[np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at)).astype(np.bool_)]] = 2
        bits = [np.packbits(reached[ungaps(data)] > 1).tobytes() for data, _ in sent]
        return pa.table([group.column("origin"), group.column("slice"), group.column("row"), pa.array(bits, pa.binary())], ["origin", "slice", "row", "bits"])

    def candidates(texts: pa.Table, answers: pa.Table) -> pa.Table:
        firsts, places, h = hashes(texts.column("text"), width)
        bits = {(p, row): x for p, row, x in zip(*(answers.column(c).to_pylist() for c in ("slice", "row", "bits")))}
        part, keep = slice_of(h, slices), np.ones(len(h), np.bool_)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(slices + 1))
        for p, row, cell, _, which in raised(h, slices, span):
            reached = np.unpackbits(np.frombuffer(bits[p, row], np.uint8), count=len(cell)).astype(np.bool_)
            keep[order[ends[p] : ends[p + 1]]] &= reached[which]
        place, h = places[keep], h[keep]
        if not len(place):
            return pa.Table.from_pylist([], candidate_schema)
        origin = texts.column("origin")[0].as_py()
        used = np.unique(np.searchsorted(firsts, place, "right") - 1)
        ids, hashed = (texts.column(c).take(pa.array(used)).to_pylist() for c in ("doc_id", "text_hash"))
        rows = [{"part": origin % parts, "origin": origin, "ids": ids, "texts": hashed, "firsts": firsts[used].tobytes()}]
        to = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            k = order[ends[p] : ends[p + 1]]
            own, one, which, n = np.unique(h[k], return_index=True, return_inverse=True, return_counts=True)
            message = {"part": p, "origin": origin, "place": gaps(place[k])}
            if len(own) < len(k):  # equal windows of this origin as one
                message |= {"which": narrowest(which), "times": narrowest(n)}
            else:
                own = h[k]
            check = (tx.mix(own * np.uint64(_SALT)) >> np.uint64(32)).astype(np.uint32)
            rows.append(message | {"hash": own.tobytes(), "check": check.tobytes()})
        return pa.Table.from_pylist(rows, candidate_schema)

    def confirm(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sent = [r for r in rows if r["hash"] is not None]
        out = [r for r in rows if r["hash"] is None]  # an origin's texts, on their way
        if sent:
            h = np.concatenate([np.frombuffer(r["hash"], np.uint64) for r in sent])
            check = np.concatenate([np.frombuffer(r["check"], np.uint32) for r in sent])
            sizes = [len(r["check"]) // 4 for r in sent]
            n = np.concatenate([np.ones(k, np.int64) if r["times"] is None else unpacked(r["times"]) for r, k in zip(sent, sizes)])
            order = np.lexsort((check, h))
            h, check = h[order], check[order]
            heads = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))))
            occurs = np.empty(len(h), np.int64)
            occurs[order] = np.repeat(np.add.reduceat(n[order], heads), np.diff(np.append(heads, len(h))))
            at = 0
            for r, k in zip(sent, sizes):
                times, place = occurs[at : at + k], ungaps(r["place"])
                at += k
                times = times if r["which"] is None else times[unpacked(r["which"])]
                if (times > 1).any():
                    out.append({"origin": r["origin"], "place": gaps(place[times > 1]), "occurs": narrowest(times[times > 1])})
        return pa.Table.from_pylist(out, confirmed_schema)

    def spans(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        texts = next(r for r in rows if r["firsts"] is not None)
        places = [r for r in rows if r["firsts"] is None]
        if not places:
            return pa.Table.from_pylist([], span_schema)
        first = np.frombuffer(texts["firsts"], np.int64)
        place = np.concatenate([ungaps(r["place"]) for r in places])
        order = np.argsort(place)
        place, occurs = place[order], np.concatenate([unpacked(r["occurs"]) for r in places])[order]
        row = np.searchsorted(first, place, "right") - 1
        position = place - first[row]
        heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (position[1:] > position[:-1] + width))))
        last = np.append(heads[1:], len(row)) - 1
        of = pa.array(row[heads])
        columns = [
            pa.array(texts["ids"], pa.int64()).take(of),
            pa.array(texts["texts"], pa.int64()).take(of),
            pa.array(position[heads], pa.int32()),
            pa.array(position[last] + width, pa.int32()),
            pa.array(position[last] + width - position[heads], pa.int32()),
            pa.array(np.maximum.reduceat(occurs, heads), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, schema=span_schema)

    longs = [("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64())), ("firsts", pa.binary())]
    sent_schema = pa.schema([("slice", pa.int32()), ("row", pa.int32()), ("origin", pa.int64()), ("cells", pa.binary()), ("twice", pa.binary())])
    candidate_schema = pa.schema([("part", pa.int32()), ("origin", pa.int64()), *((c, pa.binary()) for c in ("place", "which", "times", "hash", "check")), *longs])
    confirmed_schema = pa.schema([("origin", pa.int64()), ("place", pa.binary()), ("occurs", pa.binary()), *longs])
    span_schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("words", pa.int32()), ("occurrences", pa.int64())])
    texts = "ids array<bigint>, texts array<bigint>, firsts binary"
    sent = dealt.groupBy("origin").applyInArrow(count, "slice int, row int, origin bigint, cells binary, twice binary")
    answers = sent.groupBy("slice", "row").applyInArrow(merge, "origin bigint, slice int, row int, bits binary")
    both = dealt.groupBy("origin").cogroup(answers.groupBy("origin"))  # the texts are dealt once: both passes read one exchange
    found = both.applyInArrow(candidates, f"part int, origin bigint, place binary, which binary, times binary, hash binary, check binary, {texts}")
    sure = found.groupBy("part").applyInArrow(confirm, f"origin bigint, place binary, occurs binary, {texts}")
    return sure.groupBy("origin").applyInArrow(spans, SCHEMA)
