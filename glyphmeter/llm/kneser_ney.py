"""Two class-conditional Kneser-Ney models over byte n-grams that share their lower orders.

P_c(w|h) = max(n_c(hw) - D, 0) / n_c(h) + D * N_c(h.) / n_c(h) * P(w|h'), where the lower order P(w|h')
is the usual recursion over continuation counts, pooled over both classes.  So an expression that
neither class has seen cancels, and one that is rare is drawn towards the shared estimate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmeter.llm import text as tx

DISCOUNT = 0.75
_BYTE = np.uint64(8)


def keys(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The first key of each row (rows + 1) and the n-grams of its words, packed big-endian; a text starts with spaces."""
    at, raw = tx.flat(column, pad=order - 1)
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(len(at), np.int64), np.zeros(0, np.uint64)
    packed = raw[:n].astype(np.uint64)
    for j in range(1, order):
        packed <<= _BYTE
        packed |= raw[j : n + j]
    counts = np.diff(at) - order + 1
    first = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=first[1:])
    return first, packed[np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], counts)]


def tally(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with each count summed."""
    if not len(key):
        return (key, *counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return (key[heads], *(np.add.reduceat(c[order], heads) for c in counts))


def _sums(c: str) -> dict[str, Column]:
    return {f"{c}_total": F.sum(c), f"{c}_kinds": F.sum((F.col(c) > 0).cast("bigint"))}


def _with_contexts(grams: DataFrame, counts: Sequence[str]) -> DataFrame:
    """grams with the sums over all that have their context; a context has 256 grams at most."""
    w = Window.partitionBy(F.shiftright("gram", 8))
    return grams.select("*", *(x.over(w).alias(n) for c in counts for n, x in _sums(c).items()))


def _shared(grams: DataFrame, models: Sequence[str], order: int) -> DataFrame:
    """gram and P(w|h) of each model (named as it is), from grams of this order with each model's continuation counts."""
    known = _with_contexts(grams, models)
    if order == 1:
        lower = {m: F.lit(1 / 256) for m in models}
    else:
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
        below = grams.groupBy(suffix.alias("gram")).agg(*(F.sum((F.col(m) > 0).cast("bigint")).alias(m) for m in models))
        low = _shared(below, models, order - 1).select(F.col("gram").alias("suffix"), *(F.col(m).alias(f"{m}_low") for m in models))
        known = known.join(low, suffix == F.col("suffix"))
        lower = {m: F.col(f"{m}_low") for m in models}
    share = lambda m: (F.greatest(F.col(m) - F.lit(DISCOUNT), F.lit(0.0)) + F.lit(DISCOUNT) * F.col(f"{m}_kinds") * lower[m]) / F.col(f"{m}_total")
    return known.select("gram", *(F.when(F.col(f"{m}_total") > 0, share(m)).alias(m) for m in models))


def fit(counted: DataFrame, models: Sequence[str], order: int) -> tuple[DataFrame, DataFrame]:
    """Log-ratios of all models: of each gram, and of any other after each context (gram). null: the model has none.

    counted: gram and, of each model m, how often the toxic texts (m_t) and the ordinary ones (m_p) have it.  Sums by
    context and by suffix are aggregates and small windows, so any number of tasks takes part.
    """
    suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
    kinds = lambda m: ((F.col(f"{m}_t") > 0).cast("bigint") + (F.col(f"{m}_p") > 0).cast("bigint")).alias(m)
    below = counted.select(suffix.alias("gram"), *map(kinds, models)).groupBy("gram").agg(*(F.sum(m).alias(m) for m in models))
    shared = _shared(below, models, order - 1).withColumnRenamed("gram", "suffix")
    sides = [f"{m}_{side}" for m in models for side in "tp"]

    def weight(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, F.lit(DISCOUNT) * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(F.lit(1.0))

    def log(c: str, m: str) -> Column:
        seen = F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - F.lit(DISCOUNT), F.lit(0.0)) / F.col(f"{c}_total")).otherwise(F.lit(0.0))
        return F.log(seen + weight(c) * F.col(m))

    known = _with_contexts(counted, sides).join(shared, suffix == F.col("suffix"))
    value = lambda m: F.when(F.col(f"{m}_t") + F.col(f"{m}_p") > 0, log(f"{m}_t", m) - log(f"{m}_p", m)).cast("float").alias(m)
    context = counted.groupBy(F.shiftright("gram", 8).alias("gram")).agg(*(x.alias(n) for c in sides for n, x in _sums(c).items()))
    back = lambda m: F.when(F.col(f"{m}_t_total") + F.col(f"{m}_p_total") > 0, F.log(weight(f"{m}_t")) - F.log(weight(f"{m}_p"))).cast("float").alias(m)
    return known.select("gram", *map(value, models)), context.select("gram", *map(back, models))


class Lookup:
    """uint64 keys to float32 values: one hashed slot each, and a sorted overflow."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        """key: distinct, sorted."""
        self.bits = max(4, int(len(key)).bit_length() + 1)
        slot = self._slot(key)
        owner = np.full(1 << self.bits, -1, np.int64)
        owner[slot[::-1]] = np.arange(len(key))[::-1]
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, np.nan, np.float32)
        used = owner >= 0
        self.key[used], self.value[used] = key[owner[used]], value[owner[used]]
        rest = np.flatnonzero(owner[slot] != np.arange(len(key)))
        self.rest, self.rest_value = key[rest], value[rest].astype(np.float32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """Values; nan where a key is unknown."""
        slot = self._slot(key)
        value = self.value[slot]
        other = np.flatnonzero(self.key[slot] != key)
        value[other] = np.nan
        if len(self.rest) and len(other):
            at = np.minimum(np.searchsorted(self.rest, key[other]), len(self.rest) - 1)
            hit = self.rest[at] == key[other]
            value[other[hit]] = self.rest_value[at[hit]]
        return value


@dataclass
class Model:
    """toxic minus ordinary log-probability of each seen n-gram, and of any other after each seen context."""

    order: int
    gram: Lookup
    context: Lookup

    @classmethod
    def of(cls, order: int, name: str, grams: pa.Table, contexts: pa.Table) -> Model:
        """One of the models of the tables that fit() gives."""
        return cls(order, *(Lookup(*_known(t, name)) for t in (grams, contexts)))

    def ratios(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the sum of the log-ratios over its bytes, and how many there are."""
        first, key = keys(column, self.order)
        n = np.diff(first)
        out = np.zeros(len(n))
        if len(key):
            value = self.gram(key)
            new = np.flatnonzero(np.isnan(value))
            value[new] = np.nan_to_num(self.context(key[new] >> _BYTE))
            full = np.flatnonzero(n)
            out[full] = np.add.reduceat(value.astype(np.float64), first[:-1][full])
        return out, n


def _known(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    value = table.column(name).to_numpy()  # nan for null
    key = table.column("gram").to_numpy().view(np.uint64)[~np.isnan(value)]
    order = np.argsort(key)
    return key[order], value[~np.isnan(value)][order]
