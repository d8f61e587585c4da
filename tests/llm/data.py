"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string"
#: Names that operators use inside, and the labels' and benchmark's columns.
CLASHING = "doc_id bigint, text string, lang string, item_id string, toxic string, node string, fp string, key string, part string, h string, label_id string, text_hash string, pii_values string, tokens string, n_tokens string, __id string, __keep string, __hash string, __hash_of_row string, row string, id string, hash string, keep string, row_id string, row_hash string, origin string, copies string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("".join(rng.choice("abcdeéghilmnorstu") for _ in range(2 + rng.randrange(6) + k % 2)) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}x" for k in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(spark, rows):
    """The rows with extra columns whose names operators might use."""
    extra = CLASHING.count(",") - 1
    return spark.createDataFrame([(*r, "en", *["x"] * (extra - 1)) for r in rows], CLASHING)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
