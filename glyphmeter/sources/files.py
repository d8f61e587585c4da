"""Small files and folders of any Hadoop file system, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession | None, path: str, text: str) -> None:
    """One UTF-8 file, replaced if there is one; its folders are made."""
    spark = spark or SparkSession.getActiveSession()
    fs, at = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file."""
    return spark.read.text(path, wholetext=True).first()[0]


def head(spark: SparkSession, path: str, size: int) -> tuple[str, bool]:
    """The first bytes of a file as text, and whether that is all of it."""
    fs, at = _path(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return "", False
    length = fs.getFileStatus(at).getLen()
    return _start(spark, fs, at, size).decode("utf-8", errors="replace"), length <= size


def _start(spark: SparkSession, fs, at, size: int) -> bytes:
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches, in order."""
    fs, at = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(at) or []))
