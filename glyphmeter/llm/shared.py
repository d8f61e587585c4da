"""The shared folder (spark.checkpoint.dir), lineage cuts, size-checked broadcasts and whole-row maps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes (its rows times their estimated width).
BROADCAST_BYTES = 32 << 20


def _own_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and Spark runs on this machine alone, a folder of our own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="glyphmeter-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def folder(spark: SparkSession, name: str) -> str:
    """A new subfolder of the shared folder as a URI; it is deleted when the application ends."""
    uri = f"{_own_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if "://" not in uri:
        uri = ("file:" + uri[5:]) if uri.startswith("file:/") else "file://" + os.path.abspath(uri)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return uri


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: no executor's loss costs more than its running tasks."""
    _own_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Of a Hadoop URI, for Python workers: Hadoop's names for S3 are s3a and s3n, Arrow's is s3."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def read_table(uri: str, column: str | None = None, among: list | None = None, columns: list[str] | None = None) -> pa.Table:
    """A Parquet folder of the shared folder, in a task; with `column`, its rows whose value is among these; of all columns or some."""
    fs, path = file_system(uri)
    table = pads.dataset(path, format="parquet", filesystem=fs)
    return table.to_table(columns, filter=None if column is None else pads.field(column).isin(among))


def small(df: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """df with a broadcast hint if rows * width bytes are few enough; else the join shuffles."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def map_rows(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | object | None = None) -> DataFrame:
    """mapInArrow batch by batch; without a schema the columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch)

    return df.mapInArrow(run, schema or df.schema)


def replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """batch with the values of one column changed."""
    k = batch.schema.get_field_index(name)
    return pa.RecordBatch.from_arrays([column.cast(c.type) if i == k else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
