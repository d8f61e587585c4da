"""Readers of raw texts: Parquet, JSON, JSON lines and plain text, by file, by directory and by language."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glyphmeter.functions import text as t
from glyphmeter.sources import files as fl

TEXT_COLUMNS = ("text", "content", "sentence", "document", "passage")
HEAD = 1 << 20
_SCHEMA = "text string, rank int, file string, pos bigint"


def _clean(rows: DataFrame, rank: int) -> DataFrame:
    """text, rank, file, pos of the texts that aren't blank, in the order of file and position."""
    return rows.select(t.strip(F.col("text").cast("string")).alias("text"), F.lit(rank).alias("rank"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")).where("text is not null and text <> ''")


def text_column(df: DataFrame) -> str:
    """The first of the usual names, else the first string column."""
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    strings = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not strings:
        raise ValueError(f"no text column among {df.columns}")
    return strings[0]


def read_parquet(spark: SparkSession, path: str | list[str], rank: int = 1) -> DataFrame:
    """The text column of a Parquet file; only that column is read.  Nulls and 'nan' are dropped."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return _clean(df.select(F.col(text_column(df)).alias("text"), "_metadata"), rank).where("text <> 'nan'")


def _one_value(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one array or object, not lines of objects, as its first megabyte tells."""
    text, complete = fl.head(spark, path, HEAD)
    text = text.lstrip("\ufeff \t\r\n")
    if text[:1] != "{":
        return text[:1] == "["

    def is_object(x: str) -> bool:
        try:
            return isinstance(json.loads(x), dict)
        except ValueError:
            return False

    return complete and is_object(text) or not any(is_object(x) for x in text.split("\n"))


def read_json(spark: SparkSession, path: str | list[str], rank: int = 0) -> DataFrame:
    """The text field of a JSON array or object, however it is laid out, or of JSON lines; lines that are no JSON are skipped."""
    paths = [path] if isinstance(path, str) else path
    rows = None
    for p in paths:
        df = spark.read.schema("text string").json(p, multiLine=_one_value(spark, p))
        own = _clean(df.select("text", "_metadata"), rank)
        rows = own if rows is None else rows.unionByName(own)
    return rows


def read_text(spark: SparkSession, path: str | list[str], most: int = 1000, rank: int = 2) -> DataFrame:
    """The units of whole text files (see functions.text.extract_units)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), t.extract_units(t.tidy(F.col("value")), most).alias("units"))
    return files.select(F.posexplode("units").alias("pos", "text"), "file").select("text", F.lit(rank).alias("rank"), "file", F.col("pos").cast("bigint").alias("pos"))


def read_file(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """One file by its extension; an unknown one as JSON if it is some, else as text."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".parquet":
        return read_parquet(spark, path)
    if ext in (".json", ".jsonl"):
        return read_json(spark, path)
    if ext in (".txt", ".text"):
        return read_text(spark, path, most)
    rows = read_json(spark, path)
    return read_text(spark, path, most) if rows.isEmpty() else rows


def read_path(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """text, text_id of a file, or of a directory's JSON, then Parquet, then text files: the first `most`."""
    if path.endswith(".parquet") or fl.is_file(spark, path):
        rows = read_file(spark, path, most) if fl.exists(spark, path) else None
    else:
        kinds = [(read_json, "*.json"), (read_parquet, "*.parquet"), (lambda s, p: read_text(s, p, most), "*.txt")]
        rows = None
        for read, pattern in kinds:
            files = fl.matching(spark, f"{path}/{pattern}")
            if files:
                found = read(spark, files)
                rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = spark.createDataFrame([], _SCHEMA)
    # the head of the whole order; ids are positions in it
    head = rows.orderBy("rank", "file", "pos").limit(most)
    order = F.row_number().over(Window.orderBy("rank", "file", "pos"))
    return head.select("text", (order - 1).cast("bigint").alias("text_id"))


def read_languages(spark: SparkSession, paths: Mapping[str, str], most: int = 1000, only: DataFrame | None = None) -> DataFrame:
    """lang, text_id, text of every language; missing paths give nothing.  only: a table of languages to read."""
    chosen = set(paths) if only is None else {r[0] for r in only.select("lang").distinct().collect()}
    out = spark.createDataFrame([], "lang string, text_id bigint, text string")
    for lang in sorted(chosen & set(paths)):
        out = out.unionByName(read_path(spark, paths[lang], most).select(F.lit(lang).alias("lang"), "text_id", "text"))
    return out
